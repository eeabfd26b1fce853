"""Tessera: a Spark-first analytics engine built on DataFrames and Catalyst."""
