"""tessera: retrieval, index maintenance, ranking evaluation and game analytics on Spark DataFrames."""
