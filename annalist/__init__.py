"""annalist: a timeline of public events of public figures, as Spark jobs over tables.

Sub-packages
    functions   column expressions (text, urls, times, similarity)
    sources     tables of fetched bodies -> document rows, and table sinks
    operators   document preparation, extraction, resolution, queries, digests, repairs
    streaming   the same jobs as Structured Streaming queries
    plans       stand-in views on the star schema, the query catalogue and its SQL twins
"""
