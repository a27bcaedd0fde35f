"""lodestone: a Parquet dataset engine expressed in Spark DataFrames."""
