"""Training-data operators: ten large-scale corpus jobs built on Spark.

Nothing outside this package imports it, so it can be removed whole.
"""
