"""Analytics over agent runs, documents and evaluation data, expressed as Spark DataFrames."""
