"""Spark-native analytics over a document library: relational operators, text ETL, search, streaming."""
