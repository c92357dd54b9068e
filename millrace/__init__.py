"""Keyed, order-aware dataflow analytics on Spark DataFrames."""
