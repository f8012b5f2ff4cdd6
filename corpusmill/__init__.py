"""Corpus analytics on Spark: DataFrame in, DataFrame out."""
