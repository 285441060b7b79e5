"""A SQL-92 analytics engine on PySpark."""
