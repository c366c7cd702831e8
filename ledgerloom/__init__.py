"""Rule-driven double-entry bookkeeping on Spark: DataFrame in, DataFrame out."""
