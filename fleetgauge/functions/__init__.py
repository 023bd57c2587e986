"""Column functions: units, fluid and mechanical formulas, verdict expressions."""
