"""Distributed operators: k-NN (exact / IVF / LSH), IR metrics, perf stats, embedder."""
