"""SQL-92 front end: text to syntax tree to Spark SQL."""
