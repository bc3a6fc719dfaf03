"""The SQL front end: PostgreSQL text to Spark SQL text."""
