"""Operators over one table: structure, profiles, cleaning, comparison, statistics, transforms."""
