"""Fixed values that results depend on.

They must equal what the moderated services expect, so they are stated plainly here
and nowhere else.
"""

from __future__ import annotations

# Rule fields.
CATEGORIES = ("harassment", "hate", "sexual", "threat", "spam")
MATCH_TYPES = ("exact", "contains", "regex", "fuzzy")
SEVERITIES = (1, 2, 3)
PACK_LANGUAGE = r"[a-z]{2,3}(?:-[A-Za-z0-9]{2,8})*"
RULE_ID = r"[a-z0-9][a-z0-9._-]{0,127}"
MAX_RULES = 1000
MAX_VARIANTS = 64
MAX_PATTERN_CHARS = 256
MAX_ALLOW_TERMS = 512

# Fuzzy comparison.
FUZZY_MIN_CHARS = 4
FUZZY_WIDE_BUDGET_CHARS = 6
FUZZY_MAX_EXTRA_CHARS = 6
VOWELS = "aeiouy"
LEET_VOWELS = {"0": "o", "1": "i", "3": "e", "4": "a"}

# Requests.
MAX_REQUEST_LANGUAGES = 25
MAX_PREROLL_SAMPLES_48K = 384_000
REPLAY_TTL_SECONDS = 120
RATE_WINDOW_SECONDS = 60
CREDENTIAL_LANGUAGE = r"[a-z]{2,8}"
SERVER_ID = r"[A-Za-z0-9._-]{1,64}"
PLAN = r"[a-z0-9-]{1,32}"
MAX_RATE_LIMIT = 100_000
SELFHOST_SCOPE = "selfhost"

# Refusals that end a request before anything is metered.
UNMETERED_OUTCOMES = (
    "unauthorized",
    "invalid_request_id",
    "invalid_player_id",
    "invalid_language",
    "invalid_preroll",
    "invalid_partial",
)

# Feeds.
SAMPLES_PER_SECOND = 16_000
USAGE_INTERVAL = "60 seconds"
EVENT_BATCH_ROWS = 200
EVENT_RETENTION_ROWS = 2_000
EVENT_TRANSCRIPT_CHARS = 1_000
EVENT_MATCH_CHARS = 200
CLASSIFIER_RULE_ID = "tier2a.local-toxicity"

# Language catalog.
PACK_STATUSES = ("none", "draft", "reviewed", "verified")
EVIDENCE_LEVELS = ("unmeasured", "pilot", "verified")
