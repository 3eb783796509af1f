"""quire: document-data processing on Spark DataFrames."""
