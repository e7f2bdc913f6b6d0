"""Query catalog (Spark plans) and the matching DuckDB oracle SQL."""
