"""Fixed values and defaults, in one place."""

from __future__ import annotations

# --- Fixed values: results depend on these matching the catalog service. ---

# Image keys, best first.
IMAGE_KEYS = ("hi_res", "large", "thumb", "url")

# Attributes stored with a product vector; ratings are kept as text.
VECTOR_TEXT_ATTRIBUTES = (
    "title",
    "category",
    "description",
    "image_url",
    "image_blob",
)
PRODUCT_ATTRIBUTES = (
    "asin",
    "title",
    "description",
    "category",
    "image_url",
    "image_blob",
    "avg_rating_txt",
    "rating_cnt_txt",
)

# Stages that count as neither waiting nor in flight.
SETTLED_STAGES = ("pending", "indexed", "completed", "complete", "failed")

# Trending reduce.
MAX_QUERY_CHARS = 160
SAMPLE_TOP_IDS = 5
TRENDING_MIN_COUNT = 2
TRENDING_TOP_N = 12
TRENDING_WINDOW_HOURS = 24
TRENDING_READ_LIMIT = 50

# Vector search.
SEARCH_TOP_K = 10
MAX_TOP_K = 200
DEFAULT_RADIUS = 0.4
MAX_RADIUS = 2.0

# Rank fusion: 1 / (RRF_CONSTANT + rank + 1) with rank counted from 0.
RRF_CONSTANT = 60
FUSION_MAX_SEEDS = 16
FUSION_MIN_SEEDS = 2
FUSION_PER_SEED = 8
FUSION_TOP_K = 8

# Personal history.
MAX_VIEWS = 12
RAIL_SEEDS = 6
MAX_RECENT_SEARCHES = 8

# Lexical ranking.
LEXICAL_TOP_K = 24
SIMILAR_TOP_K = 6

# Featured blend.
FEATURED_PER_QUERY = 6
FEATURED_TOTAL = 12

# Drops and checkpoints.
CHECKPOINT_LOOKUP = 100
DROPS_DEFAULT = 7
DROPS_MAX = 100
FACET_MAX_DISTINCT = 10_000

# Ingest.
SLICE_ROWS = 10_000
REFRESH_ROWS = 10_000
EMBED_BATCH = 16
BLOB_BUDGET_BYTES = 22 * 1024**3

# Rotation hash: h = (h * 31 + code) mod 997.
SEED_FACTOR = 31
SEED_MODULUS = 997

# --- Spark-side bounds. ---

# A request table with at most this many rows is gathered and broadcast; a
# larger one goes through the shuffled block path.
BROADCAST_REQUESTS = 4096
# Rows above which a small lookup table is no longer hinted for broadcast.
BROADCAST_LOOKUP_ROWS = 100_000
# Documents and requests per block on the shuffled path.
BLOCK_DOCS = 32_768
BLOCK_REQUESTS = 4096
# Rows that meet in one task there: bands of whole blocks. Few documents or requests
# are still dealt into so many bands, if they have as many blocks.
BAND_DOCS = 65_536
BAND_REQUESTS = 32_768
LEAST_DOC_BANDS = 4
LEAST_REQUEST_BANDS = 8
# Cells of a score matrix held at once inside a task.
MATRIX_CELLS = 4_000_000
# Cells and requests of a tile scored in single precision; small enough for a cache.
TILE_CELLS = 1 << 20
TILE_REQUESTS = 1024
# Places kept in distances and scores before ranking.
DIST_PLACES = 6
