"""Log-pattern analytics on Spark: DataFrame in, DataFrame out."""
