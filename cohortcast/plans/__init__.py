"""Query registry (driver contract), DuckDB oracle SQL and the batch pipeline."""
