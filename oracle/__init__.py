"""DuckDB statements that recompute every registered query independently."""
