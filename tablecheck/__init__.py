"""Looking at, checking, comparing and converting tables with PySpark."""
