"""Page-corpus analytics on Spark: every operator is DataFrame in, DataFrame out."""
