"""Parameters of the registered queries: the driver's tables are smaller and shaped differently."""

import datetime as dt

MONTHLY_START = dt.date(1996, 1, 1)
MONTHLY_END = dt.date(2001, 1, 1)
PEAK_RATE = 0.45
MIN_ROUTE_ORDERS = 15
PARTIAL_MONTH = 100
CUTOFF = dt.date(2000, 1, 1)
QUANTILE = 0.93
RISKY_MIN_ORDERS = 15
RISKY_RATE = 0.40
MARGIN = 5
CURVE_DAYS = 60
ROLLING_START = dt.date(2000, 1, 1)
ROLLING_END = dt.date(2001, 8, 1)
ROLLING_DAYS = 14
ROLLING_MIN_DELIVERIES = 10
FOCUS_MONTH = 3
DATA_END = dt.date(2001, 8, 1)
REPEAT_DAYS = 180
MIN_LATE = 20
SELLER_MIN_ORDERS = 30
SELLER_TIMES = 1.1
SELLER_MIN_EXCESS = 2
LATE_SHARE = 0.5
RATIO_MIN_LATE = 100
TOLERANCE = 0.05
IMPOSSIBLE_ALLOWED = 189
MISMATCH_ALLOWED = 260
ROUTE_STATE = "ASIA"
HOT_ROUTE_RATE = 0.42
# One payment covers a whole order, so it can be larger than any single price.
PAYMENT_TYPE = "decimal(20,2)"
