"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; Python runs only inside Arrow batches that Spark deals out.
"""
