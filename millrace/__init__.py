"""Analytics on Spark DataFrames: market reporting, review mining and, in ``llm``, training-data pipelines."""
