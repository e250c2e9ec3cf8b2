"""Operators of a training-data pipeline on Spark: each module is one operator, ``queries`` registers them."""
