"""Retrieval, conversation and corpus analytics on Spark DataFrames."""
