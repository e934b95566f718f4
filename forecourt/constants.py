"""Fixed values. Results depend on them exactly, so they are stated once, here."""

from __future__ import annotations

# --- fixed values: header aliases -> column names ---------------------------------
HEADER_ALIASES = {
    "id": "listing_id",
    "city": "city",
    "name": "name",
    "make": "make",
    "model": "model",
    "variant": "variant",
    "year": "year",
    "km driven": "kms",
    "kms driven": "kms",
    "k m driven": "kms",
    "km_driven": "kms",
    "kms_driven": "kms",
    "ownership": "ownership",
    "transmission": "transmission",
    "fuel": "fuel",
    "bodytype": "body_type",
    "body type": "body_type",
    "body_type": "body_type",
    "price (₹)": "price",
    "price(₹)": "price",
    "price (â‚¹)": "price",
    "price(â‚¹)": "price",
    "price": "price",
    "registration": "registration",
    "image": "image",
    "fetched on": "fetched_on",
    "date": "fetched_on",
}

# Headers the programs add themselves.
DERIVED_HEADERS = {"reg state": "reg_state", "car age": "car_age"}

# The same names in the snake_case frame of the two-week programs.
SNAKE_NAMES = {
    "listing_id": "car_id",
    "fetched_on": "date_posted",
    "kms": "kms_driven",
}

ODOMETER_ALIASES = ("kms", "kmsdriven", "km driven", "kms driven", "odometer")

# --- fixed values: word lists ------------------------------------------------------
MULTI_WORD_MAKES = (
    "MARUTI SUZUKI",
    "LAND ROVER",
    "ASTON MARTIN",
    "ROLLS ROYCE",
    "FORCE MOTORS",
    "MINI COOPER",
)

TRANSMISSION_CODES = {
    "M": "Manual",
    "m": "Manual",
    "MANUAL": "Manual",
    "manual": "Manual",
    "A": "Automatic",
    "a": "Automatic",
    "AUTOMATIC": "Automatic",
    "automatic": "Automatic",
}

OWNER_WORDS = (
    ("first", 1), ("1st", 1), ("one", 1),
    ("second", 2), ("2nd", 2), ("two", 2),
    ("third", 3), ("3rd", 3), ("three", 3),
    ("fourth", 4), ("4th", 4), ("four", 4),
)

BODY_TYPES = {
    "HATCHBACK": "Hatchback",
    "SEDAN": "Sedan",
    "SUV": "SUV",
    "MUV": "MUV",
    "CROSSOVER": "Crossover",
    "COUPE": "Coupe",
    "CONVERTIBLE": "Convertible",
    "WAGON": "Wagon",
    "VAN": "Van",
    "PICKUP": "Pickup",
    "PICKUP TRUCK": "Pickup",
}

FUEL_ALIASES = {
    "PETROL + CNG": "PETROL+CNG",
    "PETROL/CNG": "PETROL+CNG",
    "CNG + PETROL": "PETROL+CNG",
    "HYBRID ELECTRIC": "HYBRID",
    "HYBRID PETROL": "HYBRID",
}

UNIT_WORDS = ("km", "kms", "owner", "owners", "yr", "yrs", "year", "years")

UNKNOWN = "Unknown"
OTHER = "other"
OTHER_LEVEL = "__OTHER__"

# --- fixed values: thresholds -------------------------------------------------------
MARKET_EPOCH = "2020-01-01 00:00:00"
MIN_YEAR = 2005
MAX_KMS = 400_000.0
PRICE_SEGMENT_EDGES = (500_000.0, 1_000_000.0, 2_000_000.0)
PRICE_SEGMENT_LABELS = ("<=5L", "5-10L", "10-20L", ">20L")
REPORT_PRICE_EDGES = (300_000.0, 700_000.0, 1_200_000.0, 2_000_000.0)
REPORT_PRICE_LABELS = ("<=3L", "3-7L", "7-12L", "12-20L", ">20L")
REPORT_KMS_EDGES = (20_000.0, 40_000.0, 60_000.0, 100_000.0, 150_000.0)
REPORT_KMS_LABELS = ("<=20k", "20k-40k", "40k-60k", "60k-100k", "100k-150k", ">150k")
REPORT_OWNER_EDGES = (1.0, 2.0, 3.0, 4.0)
REPORT_OWNER_LABELS = ("1", "2", "3", "4", "5+")

RECENCY_HALF_LIFE_DAYS = 90.0
RECENCY_MIN_WEIGHT = 0.35
TARGET_SMOOTHING = 50.0
TOP_VARIANTS = 250
OUTER_FOLDS = 5
INNER_FOLDS = 4
ANCHOR_MINIMUMS = {"model_city": 15, "model": 8, "make": 5}

MARKET_LEVELS = (
    (("make", "model", "variant_grouped", "city", "age_bucket"), 15),
    (("make", "model", "variant_grouped", "age_bucket"), 10),
    (("make", "model", "city", "age_bucket"), 8),
    (("make", "model", "age_bucket"), 5),
    (("make", "model"), 3),
)

# --- fixed values: feature lists ----------------------------------------------------
BASE_NUMERIC = (
    "year", "kms", "car_age", "kms_per_year", "ownership", "log_kms",
    "age_x_ownership", "kms_x_ownership", "fetch_month", "market_days", "days_on_market",
)
CATEGORICAL = (
    "make", "model", "variant", "transmission", "fuel", "body_type", "city", "reg_state",
)
DYNAMICS = (
    "avg_drop_7d", "avg_drop_30d", "price_drop_rate", "time_to_first_drop",
    "time_to_sell", "price_volatility", "liquidity_score",
)
DYNAMICS_BOUNDS = {
    "avg_drop_7d": (0.0, None),
    "avg_drop_30d": (0.0, None),
    "price_drop_rate": (0.0, None),
    "time_to_first_drop": (0.0, None),
    "time_to_sell": (0.0, None),
    "price_volatility": (0.0, None),
    "liquidity_score": (0.0, 100.0),
}
PRESSURE_COMPONENTS = ("avg_drop_30d_raw", "sell_inverse_raw", "volatility_raw")
PRESSURE_WEIGHTS = (0.4, 0.3, 0.3)
MARKET_FEATURES = (
    "market_count_log", "market_median_price", "market_pressure_mean",
    "market_avg_drop_30d", "market_sell_speed", "market_volatility",
)
STATIC_NUMERIC = (
    "car_age", "kms", "kms_per_year", "log_kms", "ownership", "age_x_ownership", "kms_x_ownership",
)
MAIN_NUMERIC = STATIC_NUMERIC + ("pressure_score",) + MARKET_FEATURES + ("model_te", "variant_te")
ANCHORED_NUMERIC = STATIC_NUMERIC + ("price_anchor", "model_te", "variant_te")
MAIN_CATEGORICAL = (
    "make", "variant_grouped", "transmission", "fuel", "body_type", "city", "reg_state",
)
PRESSURE_CATEGORICAL = (
    "make", "model", "variant_grouped", "transmission", "fuel", "body_type", "city", "reg_state",
)
ANCHORED_CATEGORICAL = MAIN_CATEGORICAL + ("price_segment",)

LEAKAGE_COLUMNS = (
    "days_since_listing", "price_change_count", "expected_avg_drop_7d",
    "expected_avg_drop_30d", "expected_time_to_first_drop", "expected_price_volatility",
    "expected_time_to_sell", "expected_price_drop_rate", "expected_market_liquidity_score",
    "market_days", "days_on_market", "fetch_month",
)
LEAKAGE_PATTERNS = (
    "days_since", "time_to_", "avg_drop", "price_change", "volatility",
    "market_day", "days_on_market", "fetch_month",
)
TWO_WEEK_KEEP = (
    "car_id", "date_posted", "price", "make", "model", "variant",
    "kms_driven", "ownership", "city", "car_age",
)

SOURCE_GLOBS = ("normalized_table.*", "normalized_table_*.*", "Cars24_*.*", "Spinny_*.*")

SPECIALISTS = (
    # column, value, min train rows, min validation rows, min gain in MAPE points
    ("fuel", "DIESEL", 2500, 150, 0.10),
    ("body_type", "SUV", 2500, 150, 0.05),
    ("body_type", "Sedan", 2500, 150, 0.05),
)

# --- fixed values: demand weights, clamp and trim multipliers ---------------------
DEMAND_WEIGHTS = {
    "car_age": 1.00,
    "kms_per_year": 0.95,
    "ownership": 0.80,
    "make": 0.80,
    "model": 0.85,
    "variant": 0.60,
    "fuel": 0.55,
    "transmission": 0.50,
    "body_type": 0.50,
    "city": 0.60,
    "reg_state": 0.30,
}
DEMAND_CLAMP = (0.70, 1.20)
SCORE_MULTIPLIERS = {5: 1.07, 4: 1.04, 3: 1.00, 2: 0.97, 1: 0.94}
