"""Fixed values that results depend on.

These must equal the behaviour being reproduced, so they are stated plainly
here, together, and every operator takes them as overridable defaults.
"""

# --- fixed values: ranking -------------------------------------------------
INITIAL_RANK = 1.0
DAMPING = 0.85
TELEPORT = 0.15          # rank = TELEPORT + DAMPING * sum(contributions)
DEFAULT_ROUNDS = 1

# --- fixed values: search request ------------------------------------------
RANK_CUTOFF = 2.0        # strict: rank > cutoff
RANK_DECIMALS = 6        # ranks are compared and reported at this precision
MAX_LOOKUPS = 10000      # hits looked up, in relevance order, before the cutoff
TABLE_ROWS = 100         # rows of the result table
BASE_TERM = "wiki"       # hits of this term are the percentage base
SHARE_CHARS = 5          # the percentage is cut (not rounded) to 5 characters
SHARE_SUFFIX = "% of wikipedia pages"   # caption: "<query>" in <pct><suffix>

# Density preset label -> node budget; seeds = budget // SEEDS_DIVISOR.
DENSITY_PRESETS = {
    "Max (1000 nodes)": 1000,
    "High (500 nodes)": 500,
    "Medium (200 nodes)": 200,
    "Low (100 nodes)": 100,
    "Very Low (50 nodes)": 50,
}
SEEDS_DIVISOR = 10

# --- fixed values: graph document ------------------------------------------
LINKS_PER_SEED = 10      # seed edges first, neighbours fill up to this many
SEED_EDGE_VALUE = 1
NEIGHBOUR_EDGE_VALUE = 4
SEED_GROUP = 0
COLOUR_GROUPS = 20       # neighbour group = seed index mod 20, 0 becomes 19
COLOUR_ZERO_SUBSTITUTE = 19

# --- fixed values: crawl production ----------------------------------------
URL_DESCRIPTOR = "en.wikipedia"
SITE_BASE = "http://en.wikipedia.org"
SITE_PREFIX = "/wiki"
TEXT_DIR_SWAP = ("/warc/", "/wet/")
TEXT_SUFFIX_SWAP = ("warc.gz", "warc.wet.gz")
META_DIR_SWAP = ("/warc/", "/wat/")
META_SUFFIX_SWAP = ("warc.gz", "warc.wat.gz")
INDEX_KEY = "filename"
STATUS_LOADED = "uploaded"
STATUS_MISSING = "NOTuploaded"

# --- fixed values: clustering ----------------------------------------------
KMEANS_K = 4
KMEANS_MAX_ITER = 100
SCATTER_MIN = 2
SCATTER_MAX = 500
ANALYSIS_TAG = "analysis_data"

# --- fixed values: relevance (BM25, published defaults) --------------------
BM25_K1 = 1.2
BM25_B = 0.75

# Token rule: lower-cased text split on runs of anything that is not a
# Unicode letter or digit (same result in Spark's Java regex and RE2).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# --- scale guards -----------------------------------------------------------
# A key is "hot" when it holds more than max(HOT_MIN_ROWS, total/HOT_MAX_KEYS)
# rows. By construction fewer than HOT_MAX_KEYS keys can be hot, which is the
# proven bound that makes broadcasting the hot side safe.
HOT_MIN_ROWS = 100_000
HOT_MAX_KEYS = 100_000
CHECKPOINT_EVERY = 4     # PageRank rounds between reliable checkpoints
