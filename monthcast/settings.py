"""Default parameters and table schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
HORIZON_MONTHS = 6
MIN_HISTORY_MONTHS = 6
MIN_COMPLETE_ROWS = 10
MIN_NEW_PRODUCT_ROWS = 4
COVID_PERIOD = ("2020-01-01", "2022-12-31")
COVID_FACTOR = 0.8
LAGS = (1, 3, 6, 12)
ROLLING_WINDOWS = (3, 6, 12)
PRICE_CHANGE_THRESHOLD = 0.1
STOCK_OUT_THRESHOLD = 0.05
SNAPSHOT_MAX_AGE_DAYS = 7
REGIONS = ("F01", "F02", "F03", "F04")
STEM_LENGTH = 8
SIZE_LENGTH = 4
COLOUR_LENGTH = 2
LABEL_LENGTH = 50
MIN_SUGGESTION_LENGTH = 3
SUGGESTIONS = 5
NULL_WORDS = ("NAN", "NONE", "")
SALES_FILE = "V2SC1010.csv"
UNKNOWN_PRODUCT = "Unknown Product"
DECOMPOSED_PRODUCTS = ("086L07", "004N12", "766L01", "588T01", "329A06")

SELECTED_FEATURES = (
    "anz_produkt_normalized",
    "PREIS",
    "unit_preis",
    "sales_rolling_max_6",
    "sales_rolling_max_12",
    "sales_cv_6",
    "category_seasonal_index",
    "trend_acceleration",
    "price_rolling_mean_3",
    "sales_norm_lag_6",
    "month",
    "trend_6",
    "sales_rolling_max_3",
    "sales_vs_category_3",
    "sales_rolling_mean_6",
)
# --- end of fixed values ----------------------------------------------------

# anz_produkt_normalized equals the target outside the covid window, and PREIS
# repeats unit_preis, so neither is a model input.
MODEL_FEATURES = tuple(
    f for f in SELECTED_FEATURES if f not in ("anz_produkt_normalized", "PREIS")
)

# Read after plain ISO dates, in this order.
DATE_FORMATS = ("dd.MM.yyyy", "yyyyMMdd", "yyyy/MM/dd")

# Columns of a sales file and the names each may have there.
SALES_COLUMNS = {
    "product_id": ("product_id",),
    "product_category_id": ("product_category_id",),
    "MONAT": ("MONAT",),
    "MENGE": ("MENGE", "anz_produkt"),
    "PREIS": ("PREIS", "unit_preis"),
}

SALES_RAW = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_id", T.StringType()),
        T.StructField("MONAT", T.StringType()),
        T.StructField("MENGE", T.DoubleType()),
        T.StructField("PREIS", T.DoubleType()),
    ]
)

SALES_MONTH = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_id", T.StringType()),
        T.StructField("MONAT", T.DateType()),
        T.StructField("anz_produkt", T.DoubleType()),
        T.StructField("unit_preis", T.DoubleType()),
    ]
)

DESCRIPTIONS = T.StructType(
    [
        T.StructField("NUMMER", T.StringType()),
        T.StructField("BANAME1", T.StringType()),
        T.StructField("BANAME2", T.StringType()),
    ]
)

SNAPSHOT_LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("arrived_records", T.LongType()),
        T.StructField("refitted_products", T.LongType()),
        T.StructField("training_date", T.TimestampType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("num_products", T.LongType()),
        T.StructField("num_records", T.LongType()),
        T.StructField(
            "date_range",
            T.StructType(
                [
                    T.StructField("start", T.DateType()),
                    T.StructField("end", T.DateType()),
                ]
            ),
        ),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField(
            "model_counts",
            T.StructType(
                [
                    T.StructField("product_models", T.LongType()),
                    T.StructField("category_models", T.LongType()),
                    T.StructField("global_model", T.LongType()),
                ]
            ),
        ),
        T.StructField("bytes_written", T.LongType()),
        T.StructField(
            "manifest",
            T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("folder", T.StringType())])),
        ),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("processing_time_seconds", T.DoubleType()),
        T.StructField("num_records", T.LongType()),
        T.StructField("num_products", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)
