"""vecspark: vector retrieval and retrieval evaluation as Spark DataFrame jobs.

Layout
------
functions/   column expressions (vector math, text cleanup, seeded hashing)
sources/     readers: driver tables, nested examples, passages, queries, synthetic data
operators/   k-NN (exact, inverted lists, hyperplane LSH), IR metrics, perf stats, embedder
plans/       composed views over the driver tables and report tables
sinks/       vector-table writes (overwrite, upsert, dimension check)
streaming/   incremental ingest and streamed search
"""

__version__ = "0.1.0"
