"""Column expressions: text parsing and cleaning, and statistics that agree with bias-adjusted definitions."""
