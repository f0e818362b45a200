"""litsieve: bibliographic queries and corpus preparation on PySpark."""
