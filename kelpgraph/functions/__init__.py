"""Part of the code-graph engine."""
