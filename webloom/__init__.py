"""webloom: web-graph analytics as Spark DataFrame jobs.

Crawl inputs (index lines, archives, page tables) -> cleaned text and links ->
PageRank -> inverted index and keyword / phrase / BM25 search -> ranked result
tables, seed-and-neighbour graphs and k-means groupings.

Packages: ``functions`` (Column -> Column), ``sources`` (readers, writers,
keyed stores), ``operators`` (DataFrame -> DataFrame), ``plans`` (end-to-end
jobs and the registered queries), ``streaming`` (incremental ingestion).
"""

__version__ = "0.1.0"
