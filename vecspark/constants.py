"""Fixed values that must equal the benchmark being re-implemented.

Everything here is a published constant of the original benchmark (word lists,
templates, id formats, default parameters).  Keep them verbatim and together.
"""

# --- fixed values: corpus preparation ---------------------------------------
PASSAGE_MIN_CHARS = 10          # passages kept when stripped length > 10
QUERY_MIN_CHARS = 5             # queries kept when stripped length > 5
INDEX_FRACTION = 0.8            # first 80 % of vectors are indexed
RANDOM_SEED = 42
VECTOR_DIM = 1024               # encoder output size of the original setup
ENCODE_BATCH = 32               # encoder batch size
TEXT_FIELDS = ["passage", "text", "content", "body", "document"]
PASSAGE_ID_FMT = "p_%d"
QUERY_ID_FMT = "q_%d"
SYNTHETIC_TEXT_FMT = "synthetic_text_%d"
SYNTHETIC_QUERY_FMT = "synthetic_query_%d"
DOCUMENT_TEXT_FMT = "Document %d"

# --- fixed values: synthetic corpus word lists and template -----------------
TOPICS = [
    "artificial intelligence", "machine learning", "data science", "computer vision",
    "natural language processing", "deep learning", "neural networks", "robotics",
    "automation", "technology", "software engineering", "algorithms", "statistics",
    "mathematics", "physics", "chemistry", "biology", "medicine", "healthcare",
    "finance", "economics", "business", "marketing", "education", "research",
]
ACTIONS = [
    "analyzing", "processing", "implementing", "developing", "creating", "building",
    "designing", "optimizing", "improving", "enhancing", "studying", "investigating",
    "exploring", "discovering", "understanding", "learning", "teaching", "training",
]
OBJECTS = [
    "data", "models", "algorithms", "systems", "applications", "solutions",
    "techniques", "methods", "approaches", "strategies", "frameworks", "tools",
    "platforms", "services", "products", "technologies", "concepts", "theories",
]
# format arguments: topic, action, object in this order for every sentence
SYNTHETIC_TEMPLATE = (
    "This document discusses {topic} and its applications in {action} {obj}. "
    "The research focuses on advanced {topic} techniques for {action} complex {obj}. "
    "Recent developments in {topic} have shown significant improvements in {action} {obj}. "
    "The methodology involves {action} large-scale {obj} using state-of-the-art {topic} approaches."
)

# --- fixed values: search / index parameters ---------------------------------
DEFAULT_K = 10
IVF_LISTS = 100                 # inverted lists of the SQL store
HNSW_M = 32                     # graph stores (not built as a graph; see README)
HNSW_EF_CONSTRUCTION = 200
HNSW_EF = 100
FULL_SCAN_THRESHOLD = 10000     # exact scan below this many index rows
INGEST_BATCH = 100              # rows per upsert call

# --- fixed values: measurement vocabulary ------------------------------------
QUALITY_KS = [1, 5, 10]
EVALUATION_KS = [1, 5, 10, 20]
WORKER_COUNTS = [1, 4, 8, 16]
LATENCY_METRICS = ["p50_ms", "p95_ms", "p99_ms", "mean_ms", "std_ms", "min_ms", "max_ms"]
ENGINE_NAMES = ["postgres", "weaviate", "qdrant"]
RECALL_THRESHOLD = 0.9          # "high quality" line of the latency/quality chart
LATENCY_THRESHOLD_MS = 10.0     # "low latency" line of the latency/quality chart

# heatmap rows: (label, operation, metric), in display order
HEATMAP_METRICS = [
    ("Index Time (s)", "index", "total_time"),
    ("Memory (MB)", "memory", "usage_mb"),
    ("P50 Latency (ms)", "latency", "p50_ms"),
    ("P95 Latency (ms)", "latency", "p95_ms"),
    ("P99 Latency (ms)", "latency", "p99_ms"),
    ("Max QPS", "throughput", "qps"),
    ("Recall@1", "quality", "recall@1"),
    ("Recall@10", "quality", "recall@10"),
    ("mAP@10", "quality", "mAP@10"),
]
HEATMAP_HIGHER_BETTER = ["Max QPS", "Recall@1", "Recall@10", "mAP@10"]
