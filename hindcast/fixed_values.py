"""Names, thresholds and wire formats the results depend on.

FIXED VALUES: everything in this file is data that other systems read or that
changes a result, so it is stated once, as is.
"""

# Symbols a news event may carry.
UNIVERSE = ("AAPL", "MSFT", "NVDA", "GOOGL", "AMZN", "META", "SPY", "QQQ")
BENCHMARK = "SPY"

# Renames allowed on archive rows: rule id, archive symbol, universe symbol.
ARCHIVE_ALIASES = (
    ("fb_meta_v1", "FB", "META"),
    ("goog_googl_v1", "GOOG", "GOOGL"),
)
ALIASES_OFF = "off"

EVENT_SOURCES = ("fixture", "rss", "kaggle", "csv")
HIT_SOURCES = ("qdrant", "fixture")
ACTIONS = ("BUY", "HOLD", "PASS")
DECISIONS = ("approve", "reject")
RATIONALE_MAX_CHARS = 2000

# Model inputs; the order is part of the model contract.
FEATURE_NAMES = (
    "finbert_sentiment",
    "volatility_20d",
    "return_5d_prior",
    "return_20d_prior",
    "spy_return_5d",
)
SCORE_KIND = "proba_high_risk"

TRAINING_COLUMNS = (
    "event_id",
    "headline",
    "ticker",
    "published_at",
    "feature_as_of",
    "finbert_sentiment",
    "volatility_20d",
    "return_5d_prior",
    "return_20d_prior",
    "spy_return_5d",
    "fwd_return_5d",
    "label_high_risk",
    "source_dataset_id",
    "source_row_hash",
    "builder_version",
)

EXCHANGE_ZONE = "America/New_York"
OPEN_CLOCK = "09:30:00"
SHORT_RETURN_SESSIONS = 5
LONG_RETURN_SESSIONS = 20
FORWARD_SESSIONS = 5
SESSIONS_PER_YEAR = 252
LABEL_THRESHOLD = -0.03

PAYLOAD_VERSION = "1"
NEWS_TOPIC = "news.raw"
DLQ_TOPIC = "news.raw.dlq"
MAX_ATTEMPTS = 3

TOP_K = 5
OVERFETCH = 3
MAX_FEED_ITEMS = 10
POLL_INTERVAL = "120 seconds"

TRAIN_FRACTION = 0.8
TIME_FOLDS = 3
MIN_FOLD_ROWS = 10
SAMPLE_SEED = 42
SAMPLE_TARGET = 500
F1_GAP_WARNING = 0.25
THRESHOLD_POINTS = 19
THRESHOLD_FIRST = 0.05
THRESHOLD_LAST = 0.95

GRID_DEPTH = (2, 3)
GRID_STEP = (0.05, 0.1)
GRID_ROUNDS = (40, 60)
ROW_SUBSAMPLE = 0.8
FEATURE_SUBSAMPLE = 0.8

# Required keys of each expectation kind.
EXPECTATION_KEYS = {
    "schema": ("action", "confidence"),
    "identity": ("llm_ticker", "input_ticker", "llm_event_id", "input_event_id"),
    "asof": ("published_at", "hits"),
    "gate": ("action", "force_score"),
    "oou": ("ticker",),
}
SCORE_AT_THRESHOLD = "eq_threshold"
SCORE_BELOW_THRESHOLD = "just_below_threshold"
SCORE_EPSILON = 1e-6
EXPECTATION_VETO = 0.05
EXPECTATION_VOLATILITY = 0.1

# Prompt layout.
NO_CONTEXT_LINE = "(no retrieval context after as-of filter)"
HIT_LINE = "- [%s] score=%s available_at=%s :: %s"
PROMPT_BODY = "event_id: %s\nticker: %s\npublished_at: %s\nheadline: %s\ncontext:\n%s\n"
REPAIR_NOTE = "\nPrevious output was invalid: %s\nFix and return valid JSON only.\n"

# Policy reasons.
REASON_NO_RISK = "%s always approve under policy_version=%s"
REASON_SCORE = "BUY rejected: downside_risk_score=%s >= score_threshold=%s"
REASON_VETO = "BUY rejected by vol veto: volatility_20d=%s >= vol_veto_threshold=%s"
REASON_APPROVED = "BUY approved: downside_risk_score=%s < score_threshold=%s"
