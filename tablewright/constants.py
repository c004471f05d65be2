"""Fixed values shared by the operators."""

# Splits
TEST_FRACTION = 0.2
SEED = 42
CLASSIFICATION_MAX_CLASSES = 20

# Redundancy and importance
CORRELATION_THRESHOLD = 0.90
LOW_IMPORTANCE = 0.001

# Profiling
OUTLIER_FENCE = 1.5
LOW_VARIANCE_STD = 0.01
HIGH_MISSING_PCT = 50.0
OUTLIER_COLUMN_PCT = 5.0

# Drift
PSI_BINS = 10
PSI_CLIP = 1e-6
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25

# Feature engineering
ONEHOT_TOP_N = 20
DATE_PARSE_MIN_SUCCESS = 0.5

# Leakage
LEAKAGE_THRESHOLD = 0.95
LEAKAGE_FOLDS = 3
LEAKAGE_MIN_ROWS = 10
LEAKAGE_TREE_DEPTH = 3

# Explanation
PDP_GRID = 20
PDP_SAMPLE = 200
PDP_SPAN = 0.05
SHAP_ROWS = 500
SHAP_BACKGROUND = 100
SHAP_TOP_PER_ROW = 5
SHAP_PAIR_CORR = 0.7

# Findings
OVERFIT_SEVERE_PCT = 10.0
OVERFIT_MODERATE_PCT = 5.0
PRUNE_GAP_PCT = 5.0
MIN_MODELS = 5
MIN_ROWS_PER_FEATURE = 10
SMALL_TEST_ROWS = 100
IMBALANCE_SEVERE = 10.0
IMBALANCE_MODERATE = 3.0

# Residual histogram
RESIDUAL_BINS = 50
