"""Text analytics on Spark: tokens, collocations, term weights, vectors, search, models and evaluation."""
