"""ledgerlens: disclosure-text analytics expressed as Spark DataFrame jobs.

Layout
------
sources/    table loaders, derived test views, file readers and sinks
functions/  column-expression builders (regex chains, token rules, fixed word tables)
operators/  DataFrame -> DataFrame operators (parse, chunk, vocabulary, topics, tables)
plans/      composed jobs and the query registry used by ``__spark_entry__``
streaming/  incremental (Structured Streaming) form of the clean-filing job
"""

__version__ = "0.1.0"
