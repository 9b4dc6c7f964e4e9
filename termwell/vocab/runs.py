"""Constants of the trace, cost and traffic analytics.

Fixed values: results only agree with the published behaviour when these
tables hold exactly these entries.
"""

# (model name, USD per million input tokens, USD per million output tokens)
PRICES = [
    ("claude-sonnet-4-20250514", 3.00, 15.00),
    ("claude-sonnet-4", 3.00, 15.00),
    ("claude-opus-4-20250514", 15.00, 75.00),
    ("claude-opus-4", 15.00, 75.00),
    ("claude-3-7-sonnet-20250219", 3.00, 15.00),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-5-haiku-20241022", 0.80, 4.00),
    ("claude-3-opus-20240229", 15.00, 75.00),
    ("claude-3-sonnet-20240229", 3.00, 15.00),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("claude-haiku-4-5-20251001", 0.80, 4.00),
]
DEFAULT_PRICE = (3.00, 15.00)
FLAT_TOKEN_PRICE = 0.000006

# stage, agent, recovery strategy, retries allowed
STAGES = [
    ("planning", "PlannerChain", "broaden_shards", 2),
    ("search", "SearchChain", "direct_llm", 2),
    ("ranking", "RankingChain", "bm25_only", 1),
    ("enrichment", "EnrichmentChain", "skip_enrichment", 1),
    ("summary", "SummaryChain", "truncate_summary", 1),
]

FAILURE_THRESHOLD = 5
RECOVERY_SECONDS = 60
SUCCESS_THRESHOLD = 2

RATE_WINDOW_SECONDS = 60
SEARCH_RATE_LIMIT = 20
GENERAL_RATE_LIMIT = 100

SKIPPED_PATHS = ["/health", "/", "/docs", "/redoc", "/openapi.json"]

# Extra fields a log record may carry.
LOG_EXTRAS = [
    "request_id", "agent", "duration_ms", "rag_source", "query",
    "exam", "shards", "hits", "exam_count", "rank_source",
    "shard_query", "candidates", "error", "status_code", "method",
    "path", "client_ip", "phase", "cache_hit", "llm_calls_saved",
]

QUERY_TTL_HOURS = 24
NEAR_DUPLICATE_JACCARD = 0.80
