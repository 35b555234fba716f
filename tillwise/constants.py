"""Fixed values.

Labels, weights, thresholds and column lists below are part of the results
(they appear in, or decide, the output) and must keep these exact values.
"""

# Column names of the transaction and customer tables.
CUSTOMER_KEY = "CustomerID"
RFM_FEATURES = [
    "Recency",
    "Tenure",
    "Frequency",
    "Monetary",
    "FreeTransactionRatio",
    "AvgOrderValue",
]

# Churn weights, risk thresholds and labels.
CHURN_WEIGHTS = {"Recency": 0.50, "Frequency": 0.30, "Monetary": 0.20}
HIGH_RISK_FROM = 0.65
MEDIUM_RISK_FROM = 0.35
HIGH_RISK = "High Risk"
MEDIUM_RISK = "Medium Risk"
LOW_RISK = "Low Risk"
RISK_LABELS = [HIGH_RISK, MEDIUM_RISK, LOW_RISK]

# Absolute bands as (upper bound, score); the last has no bound.
RECENCY_BANDS = [(30, 0.10), (90, 0.30), (180, 0.55), (365, 0.80), (None, 1.00)]
FREQUENCY_BANDS = [(1, 1.00), (3, 0.70), (10, 0.45), (25, 0.20), (None, 0.10)]
MONETARY_BANDS = [(100, 1.00), (500, 0.70), (2000, 0.45), (5000, 0.20), (None, 0.10)]

# Preprocessing.
CAP_PERCENTILE = 0.95
CAPPED_FOR_TRAINING = ["Monetary", "Frequency", "Recency"]
CAPPED_FOR_SCORING = ["Monetary", "Frequency", "Recency", "Tenure", "AvgOrderValue"]
LOGGED_FEATURES = ["Monetary", "Frequency", "AvgOrderValue", "Tenure"]
TEST_RATIO = 0.2

# Clustering and segment names by falling mean Monetary.
SEED = 42
RESTARTS = 10
K_RANGE = range(3, 9)
SEGMENT_LABELS = ["High Value", "Frequent Buyer", "Regular", "At Risk"]
SEGMENT_LABEL_BEYOND = "Regular"
SCORING_INPUTS = ["Recency", "Tenure", "Frequency", "Monetary", "AvgOrderValue"]

# KPI thresholds, chart bins and buckets.
ACTIVE_WITHIN_DAYS = 90
HIGH_FREQUENCY_ABOVE = 10
TOP_SHARE_PERCENTILE = 0.90
PARETO_LINE_PCT = 80
SAMPLE_ROWS = 3000
HISTOGRAM_BINS = {
    "ChurnScore": 30,
    "Monetary": 40,
    "Recency": 35,
    "Tenure": 35,
    "Frequency": 40,
    "AvgOrderValue": 35,
}
RECENCY_BUCKETS = [
    (0, 30, "0–30d"),
    (30, 90, "31–90d"),
    (90, 180, "91–180d"),
    (180, 365, "181–365d"),
    (365, None, "365d+"),
]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
