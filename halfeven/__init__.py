"""Exact-SQL analytics on Spark: strict types, checked arithmetic, half-even rounding."""
