"""Column functions: text, matching costs, geometry."""
