"""Reusable relational operators: exact distributed ranks, pool statistics, joins, matching."""
