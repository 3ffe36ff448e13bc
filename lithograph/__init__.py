"""lithograph: columnar property graphs, hybrid retrieval and incremental maintenance on Spark DataFrames."""
