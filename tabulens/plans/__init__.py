"""Plans and rules: plain Python over profiles; cleaning plans, chart candidates, evidence, reports."""
