"""Fixed values. These must equal the behaviour being reproduced; they are
defaults of the operators, every one of which can be overridden by argument.
"""

# --- fixed values (event model) ---------------------------------------------
EVENT_VIEW = "view"
EVENT_ADD = "addtocart"
EVENT_TXN = "transaction"
KEPT_EVENTS = ("view", "addtocart", "transaction")

# --- fixed values (sessions) --------------------------------------------------
SESSION_GAP_MINUTES = 30          # a gap strictly over 30 whole minutes opens a session
SESSION_KEY_SEP = "-"             # session_id = visitorid + "-" + session number

# --- fixed values (item properties) ------------------------------------------
PIVOT_KEYS = ("categoryid", "available", "price")
PRICE_STRIP_PATTERN = r"[^0-9.]"  # characters removed from a price before the cast

# --- fixed values (features and training) -------------------------------------
CAT_COLS = ("categoryid",)
NUM_COLS = ("views", "adds", "unique_items", "duration_min",
            "u_events", "u_views", "u_adds", "u_txn",
            "i_views", "i_adds", "i_txn")
FILL_ZERO_COLS = ("u_events", "u_views", "u_adds", "u_txn",
                  "i_views", "i_adds", "i_txn",
                  "duration_min", "views", "adds", "unique_items")
SPLIT_QUANTILE = 0.8
SPLIT_RELATIVE_ERROR = 0.001
SESSION_COLS = ("views", "adds", "distinct_products", "session_hour")   # session-level intent model
NEG_TO_POS_RATIO = 3.0
SEED = 42
THRESHOLD = 0.5
TOP_K = 5
TEST_RATIO = 0.2

# --- fixed values (random forest) --------------------------------------------
RF_NUM_TREES = 200
RF_MAX_DEPTH = 20
RF_MAX_BINS = 128
RF_SUBSET = "auto"
RF_SUBSAMPLING = 0.8

# --- fixed values (app surface) -----------------------------------------------
DEFAULT_VIEW = "dataset"
HIST_BINS = 20
HIST_SAMPLE_FRACTION = 0.05
LABEL_COL_GENERIC = "__label"
