"""Patterns, word lists and thresholds that results must agree on."""

# Text patterns
SUFFIX_CODE = r"-[hdpl]\d+$"
VIEW_IN_URL = r"_([hdpl])_\d+_"
SHOT_IN_URL = r"_[hdpl]_(\d+)_"
SIZE_SUFFIX = r"_(high|med|low)\.jpg$"
SIZES = ["med", "high", "low"]
TITLE_CODE = r"(casent[0-9][\w().-]*|antweb\d+)"
TITLE_VIEW = r"\b(profile|dorsal|head|label)\b(?:\s+(\d+))?"
VIEW_LETTER = {"profile": "p", "dorsal": "d", "head": "h", "label": "l"}
YEAR_RANGE = r"(\d{4})\s*-\s*(\d{4})"
YEAR_SINGLE = r"(\d{4})"
MISSING_SHOT = 9999

# Block-page markers
CHALLENGE_MARKERS = ["Just a moment", "cf-chl", "challenges.cloudflare.com"]

# Boxes (pixels at width 1,024)
BOX_REFERENCE_WIDTH = 1024
BOX_PAD_X = 20
BOX_ABOVE = 10
BOX_BELOW = 50
BOX_TRUNCATED_MIN = 0.12
BOX_TRUNCATED_THICKNESS = 6

# Evidence tiers
SIGNAL_MIN_DB = 30.0
FINGERPRINT_MAX = 6
ASPECT_TOLERANCE = 0.01
MARGIN = 0.10

# Logs and limits
PAUSE_GAP_S = 60
STREAK_STOP = 10
RATE_LIMIT = 10
RATE_WINDOW_S = 60
MAX_HISTORY = 12

# Words for a missing value in CSV files
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Evaluation and display
ECE_BINS = 10
LOW_CONFIDENCE = 0.5
SUPPORT_SIMILARITY = 0.85
SUPPORT_MIN = 3
RELIABLE_MIN_TESTS = 5
RELIABLE_MIN_F1 = 0.8
DOMINANT_SHARE = 0.90
CLUSTER_ABOVE = 200
CELL_PX = 56
