"""Fixed values that decide results: character classes, word lists and name rules.

They are data, not logic, and are stated here in one place, in natural order.
"""

# --- fixed values: character classes -------------------------------------------
# Java spellings of "word character" and "whitespace" as comment tools commonly
# define them: letters, digits and underscore (no combining marks); and Unicode
# whitespace including the separators U+001C..U+001F and U+0085.
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\s\x1c-\x1f\x{85}\p{Z}"
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"

# --- fixed values: thresholds ---------------------------------------------------
MIN_TEXT_LENGTH = 3
MIN_LANGUAGE_TEXT_LENGTH = 5
MIN_TOKEN_LENGTH = 3
MAX_SENTIMENT_TEXT = 500
TRUNCATION_MARK = "..."
BLANK_TEXT_WORD = "empty"
LANGUAGE_CONFIDENCE = 0.8
UNKNOWN_LANGUAGE = "und"
NEUTRAL_LABEL = "NEUTRAL"
NEUTRAL_SCORE = 0.5
DEFAULT_TOPICS = 10
SAMPLE_SEED = 42
MODEL_BATCH = 32
SENTIMENT_BATCH = 100

# --- fixed values: supported languages -------------------------------------------
LANGUAGE_NAMES = {
    "ar": "Arabic",
    "bg": "Bulgarian",
    "de": "German",
    "el": "Greek",
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "hi": "Hindi",
    "it": "Italian",
    "ja": "Japanese",
    "nl": "Dutch",
    "pl": "Polish",
    "pt": "Portuguese",
    "ru": "Russian",
    "sw": "Swahili",
    "th": "Thai",
    "tr": "Turkish",
    "ur": "Urdu",
    "vi": "Vietnamese",
    "zh": "Chinese",
}

# --- fixed values: English stop words ---------------------------------------------
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "when", "where",
    "how", "all", "with", "is", "are", "was", "were", "be", "have", "has", "had", "do",
    "does", "did", "of", "for", "by", "to", "in", "at", "on", "this", "that", "these",
    "those", "it", "its", "their", "they",
]

# --- fixed values: tourism phrases ------------------------------------------------
TOURISM_PHRASES = [
    "puerto rico", "visit", "vacation", "tourist", "tourism", "travel",
    "destination", "beach", "island", "resort", "hotel", "trip",
    "visit puerto rico", "beautiful place", "san juan", "caribbean",
    "beautiful country", "paradise", "place to visit", "vacation spot",
    "landscape", "scenery", "venue", "location", "la perla", "old san juan",
]

# --- fixed values: words read as missing in CSV ------------------------------------
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: column-name rules of type coercion -------------------------------
BOOLEAN_COLUMNS = ["is_reply", "is_spam", "is_deleted", "is_popular", "is_approved", "is_enabled"]
BOOLEAN_NAME_PARTS = ["is_", "has_", "_flag", "_enabled"]
EPOCH_COLUMNS = ["published_at_unix", "timestamp", "unix_timestamp", "created_at_unix"]
EPOCH_NAME_PARTS = ["_unix", "timestamp", "epoch"]
COUNT_COLUMNS = ["like_count", "dislike_count", "reply_count", "view_count", "subscriber_count"]
COUNT_NAME_PARTS = ["count", "_id"]
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]

# --- fixed values: Parquet codecs ----------------------------------------------------
CODECS = ("snappy", "gzip", "brotli", "zstd", "none")
