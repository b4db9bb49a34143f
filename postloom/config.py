"""Configuration: weights, quotas, prices, intervals, limits.

Everything here is a small, closed set of constants, so the DataFrames built from
it have a size bound that does not grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the source pipeline's for equal results)
# ---------------------------------------------------------------------------

# Generation model weights in percent, in listed order; weight 0 = disabled.
MODEL_WEIGHTS = [
    ("gpt54_nano", 33.0),
    ("gpt41_mini", 33.0),
    ("claude", 20.0),
    ("gemini", 0.0),
    ("llama", 14.0),
    ("deepseek", 0.0),
]

# Few-shot examples per prompt, and the random example count range.
SAMPLES_PER_PROMPT = 12
MIN_EXAMPLES, MAX_EXAMPLES = 8, 15

# Declared (never enforced upstream) spending cap in USD.
MAX_BUDGET_USD = 50.0

# Sample pool quality filter (characters, inclusive).
MIN_TEXT_LENGTH, MAX_TEXT_LENGTH = 10, 1000

# Length buckets (lo, hi, share) per platform; the last bucket takes the rest.
LENGTH_BUCKETS = {
    "bluesky": [("short", 10, 100, 0.3), ("medium", 101, 250, 0.4), ("long", 251, 300, None)],
    "default": [("short", 10, 100, 0.3), ("medium", 101, 400, 0.4), ("long", 401, 1000, None)],
}

# Temperature range per model family.
TEMPERATURE_RANGES = {"claude": (0.9, 1.0), "azure": (0.9, 1.1), "other": (1.0, 1.2)}
AZURE_MODELS = ("gpt54_nano", "gpt41_mini")

# Poll interval in minutes per platform; a platform without an entry polls every 15.
POLL_INTERVALS = {"twitter": 7, "reddit": 12, "bluesky": 7, "threads": 15}
DEFAULT_POLL_MINUTES = 15

# Request ceiling per platform: (requests, period seconds).
RATE_LIMITS = {"twitter": (450, 900), "reddit": (60, 60), "bluesky": (3000, 300)}

# Scrape job id and display name formats.
JOB_ID_FORMAT = "{platform}_{query}"
JOB_NAME_FORMAT = "Scrape {platform}: {query}"

# At most this many posts per fetch.
MAX_POSTS_PER_FETCH = 100

# Model prices, USD per million tokens: (model, mode, input, output).
PRICES = [
    ("claude", "realtime", 3.00, 15.00),
    ("claude", "batch", 1.50, 7.50),
    ("gpt-5.4-nano", "realtime", 0.10, 0.40),
    ("gpt-4.1-mini", "realtime", 0.075, 0.30),
    ("gemini-1.5-flash", "realtime", 0.075, 0.30),
    ("gemini-1.5-flash-8b", "realtime", 0.0375, 0.15),
    ("llama", "free_tier", 0.0, 0.0),
    ("llama", "paid", 0.05, 0.10),
    ("deepseek-chat", "realtime", 0.27, 1.10),
    ("deepseek-reasoner", "realtime", 0.55, 2.19),
]

# Contractions expanded by the cleaner, applied in this order.
CONTRACTIONS = [
    ("don't", "do not"), ("can't", "cannot"), ("won't", "will not"),
    ("it's", "it is"), ("i'm", "i am"), ("you're", "you are"),
    ("they're", "they are"), ("we're", "we are"), ("isn't", "is not"),
    ("aren't", "are not"), ("wasn't", "was not"), ("weren't", "were not"),
]

# Tokenizer / encoder sizes and the perplexity window of the source pipeline.
ENCODER_BATCH_SIZE = 32
MAX_SEQUENCE_TOKENS = 512
EMBEDDING_DIM = 768
PERPLEXITY_WINDOW = 1024

# Split shares and seed.
SPLIT_SEED = 42

PLATFORMS = ("twitter", "reddit", "bluesky")

# ---------------------------------------------------------------------------
# Our own values (not fixed by the source pipeline)
# ---------------------------------------------------------------------------

# Price used when a model has no row in PRICES (upstream fell back to a missing key).
DEFAULT_PRICE = (0.10, 0.40)

# Map of generation model key -> price-table model name.
MODEL_PRICE_KEY = {
    "gpt54_nano": "gpt-5.4-nano",
    "gpt41_mini": "gpt-4.1-mini",
    "claude": "claude",
    "gemini": "gemini-1.5-flash",
    "llama": "llama",
    "deepseek": "deepseek-chat",
}


def bucket_quotas(n: int) -> tuple[int, int]:
    """Quotas of the short and medium bucket for ``n`` examples; long takes the rest."""
    return max(1, (3 * n) // 10), max(1, (4 * n) // 10)
