"""Retrieval, index, evaluation and game operators over DataFrames."""
