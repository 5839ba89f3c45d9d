"""Operators for preparing training text, each written as a Spark job."""
