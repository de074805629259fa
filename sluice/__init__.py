"""Declarative dataflow graphs over Spark DataFrames."""
