"""Document knowledge-base analytics on Spark: DataFrame in, DataFrame out."""
