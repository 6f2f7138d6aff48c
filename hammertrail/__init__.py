"""Listing history and price intelligence as Spark DataFrame operators."""
