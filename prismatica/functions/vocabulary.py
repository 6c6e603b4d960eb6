"""Names, thresholds' labels and formats that results depend on."""

# --- fixed values: column-name vocabularies --------------------------------
IDENTIFIER_NAMES = [
    "id", "code", "zip", "zipcode", "pincode", "pin_code", "phone", "mobile",
    "account", "customer_id", "product_id", "order_id", "transaction_id",
]
IDENTIFIER_SUFFIXES = ["_id", " id"]
DATE_NAME_WORDS = ["date", "time", "timestamp", "datetime", "year", "month", "day"]
DATE_PROMOTION_WORDS = ["date", "time"]
TREND_DATE_WORDS = ["date", "time", "month", "year"]
PREFERRED_TARGETS = ["sales", "revenue", "profit", "income", "amount", "target", "y"]
TARGET_WORDS = [
    "sales", "revenue", "profit", "amount", "income",
    "price", "value", "target", "score", "quantity",
]
PREDICTION_TARGET_WORDS = [
    "sales", "revenue", "profit", "price", "demand", "target", "churn", "class", "score",
]
KPI_REVENUE_WORDS = ["sales", "revenue", "amount"]
KPI_PROFIT_WORDS = ["profit"]
METRICS_REVENUE_NAMES = ["sales", "revenue", "total_sales", "amount", "turnover"]
METRICS_PROFIT_NAMES = ["profit", "net_profit", "gross_profit", "operating_profit"]
METRICS_QUANTITY_NAMES = ["quantity", "qty", "units", "volume"]
FINDING_REVENUE_WORDS = ["revenue", "sales", "turnover", "income"]
FINDING_PROFIT_WORDS = ["profit", "earnings", "net_income", "net profit"]
FINDING_QUANTITY_WORDS = ["quantity", "units", "volume", "qty"]
FINDING_SEGMENT_WORDS = ["revenue", "sales", "profit", "income"]
FINDING_TREND_WORDS = ["revenue", "sales", "profit"]
ANSWER_REVENUE_WORDS = ["revenue", "sales", "turnover", "income"]
ANSWER_PROFIT_WORDS = ["profit", "earnings", "net_income"]
ANSWER_MARGIN_REVENUE_WORDS = ["revenue", "sales", "turnover"]
ANSWER_RANKING_WORDS = ["revenue", "sales", "profit", "income"]

# --- fixed values: date formats tried after the ISO forms -------------------
# (shape of the text, format). Ambiguous day/month pairs are read month first.
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
]
# Text of any other shape is tried only as an ISO form, which starts so.
ISO_SHAPE = r"^\d{4}(-\d{1,2}.*)?$"

# --- fixed values: label for a missing segment ------------------------------
MISSING_SEGMENT = "<missing>"
