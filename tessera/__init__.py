"""Tessera: a PostgreSQL-flavoured analytics engine on PySpark."""
