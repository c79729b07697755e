"""Queries: feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.catalogue.registry import FACT, fact, query, rnd, shown
from monthcast.operators import features as T

COVID = ("1998-01-01", "1998-12-31")
KEYS = ["product_id", "MONAT"]


def roll(agg: str, column: str, k: int) -> str:
    return (
        f"{agg}({column}) OVER (PARTITION BY product_id ORDER BY MONAT "
        f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    )


def lag(column: str, k: int) -> str:
    return f"lag({column}, {k}) OVER (PARTITION BY product_id ORDER BY MONAT)"


FEATURES = (
    FACT
    + f""",
base AS (
  SELECT *, CASE WHEN MONAT BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN anz_produkt / 0.8
                 ELSE anz_produkt END AS norm,
         CAST(row_number() OVER (PARTITION BY product_id ORDER BY MONAT) AS DOUBLE) AS i
  FROM fact),
w AS (
  SELECT *, {", ".join(f"{lag('anz_produkt', k)} AS lag_{k}, {lag('norm', k)} AS norm_lag_{k}" for k in S.LAGS)},
         {", ".join(f"{roll('avg', 'anz_produkt', k)} AS mean_{k}, {roll('max', 'anz_produkt', k)} AS max_{k}, "
                    f"{roll('stddev_samp', 'anz_produkt', k)} AS std_{k}" for k in S.ROLLING_WINDOWS)},
         {roll('avg', 'unit_preis', 3)} AS price_3, {roll('regr_slope', 'anz_produkt, i', 6)} AS slope_6
  FROM base),
sloped AS (SELECT *, CASE WHEN NOT isnan(slope_6) THEN slope_6 END AS trend_6 FROM w),
accelerated AS (SELECT *, trend_6 - {lag('trend_6', 3)} AS acceleration FROM sloped),
category_month AS (
  SELECT product_category_id, MONAT, avg(anz_produkt) AS mean FROM fact GROUP BY ALL),
category_recent AS (
  SELECT product_category_id, MONAT, avg(mean) OVER (
           PARTITION BY product_category_id ORDER BY MONAT ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent
  FROM category_month),
category_index AS (
  SELECT product_category_id, m, mean / overall AS idx FROM (
    SELECT product_category_id, month(MONAT) AS m, avg(anz_produkt) AS mean FROM fact GROUP BY ALL)
  JOIN (SELECT product_category_id, avg(anz_produkt) AS overall FROM fact GROUP BY ALL)
    USING (product_category_id)),
features AS (
  SELECT a.*, idx, mean_3 / nullif(recent, 0) AS versus
  FROM accelerated a
  LEFT JOIN category_recent r ON r.product_category_id = a.product_category_id AND r.MONAT = a.MONAT
  LEFT JOIN category_index x ON x.product_category_id = a.product_category_id AND x.m = month(a.MONAT))"""
)


def select(columns: str) -> str:
    return f"{FEATURES} SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {columns} FROM features"


def base(spark, sf):
    return T.with_normalized_sales(fact(spark, sf), COVID)


@query(
    "t3_lags",
    select(
        ", ".join(
            f"lag_{k} AS sales_lag_{k}, {rnd(f'norm_lag_{k}')} AS sales_norm_lag_{k}" for k in S.LAGS
        )
    ),
)
def t3(spark, sf):
    df = T.lag_features(base(spark, sf))
    names = [f"sales_{kind}lag_{k}" for k in S.LAGS for kind in ("", "norm_")]
    return shown(df.select(*KEYS, *names))


@query(
    "t4_rolling_statistics",
    select(
        ", ".join(
            f"{rnd(f'mean_{k}')} AS sales_rolling_mean_{k}, max_{k} AS sales_rolling_max_{k}, "
            f"{rnd(f'std_{k}')} AS sales_rolling_std_{k}"
            for k in S.ROLLING_WINDOWS
        )
    ),
)
def t4(spark, sf):
    names = [f"sales_rolling_{s}_{k}" for k in S.ROLLING_WINDOWS for s in ("mean", "max", "std")]
    return shown(T.rolling_features(base(spark, sf)).select(*KEYS, *names))


@query(
    "t5_rolling_variation",
    select(", ".join(f"{rnd(f'std_{k} / nullif(mean_{k}, 0)')} AS sales_cv_{k}" for k in S.ROLLING_WINDOWS)),
)
def t5(spark, sf):
    names = [f"sales_cv_{k}" for k in S.ROLLING_WINDOWS]
    return shown(T.rolling_features(base(spark, sf)).select(*KEYS, *names))


@query("t6_price_rolling_mean", select(f"{rnd('price_3', 5)} AS price_rolling_mean_3"))
def t6(spark, sf):
    return shown(T.price_features(base(spark, sf)).select(*KEYS, "price_rolling_mean_3"))


@query("t7_trend", select(f"{rnd('trend_6')} AS trend_6, {rnd('acceleration')} AS trend_acceleration"))
def t7(spark, sf):
    return shown(T.trend_features(base(spark, sf)).select(*KEYS, "trend_6", "trend_acceleration"))


@query(
    "t8_category_seasonal_index",
    FEATURES
    + f"""
SELECT m.product_category_id, CAST(m.MONAT AS VARCHAR) AS MONAT, {rnd("mean")} AS category_mean,
       {rnd("recent")} AS category_rolling_mean_3, {rnd("idx")} AS category_seasonal_index
FROM category_month m JOIN category_recent r USING (product_category_id, MONAT)
JOIN category_index x ON x.product_category_id = m.product_category_id AND x.m = month(m.MONAT)""",
)
def t8(spark, sf):
    return shown(T.category_months(fact(spark, sf)))


@query(
    "t8_category_seasonal_index_trained",
    FACT
    + f""",
trained AS (SELECT * FROM fact WHERE MONAT <= DATE '2000-12-01')
SELECT product_category_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd("mean / overall")} AS category_seasonal_index
FROM (SELECT DISTINCT product_category_id, MONAT FROM fact)
JOIN (SELECT product_category_id, month(MONAT) AS m, avg(anz_produkt) AS mean FROM trained GROUP BY ALL)
  USING (product_category_id)
JOIN (SELECT product_category_id, avg(anz_produkt) AS overall FROM trained GROUP BY ALL) USING (product_category_id)
WHERE m = month(MONAT)""",
)
def t8_trained(spark, sf):
    df = T.category_months(fact(spark, sf), train_until="2000-12-01")
    return shown(df.select("product_category_id", "MONAT", "category_seasonal_index"))


@query("t9_sales_vs_category", select(f"{rnd('versus')} AS sales_vs_category_3"))
def t9(spark, sf):
    df = T.rolling_features(fact(spark, sf), (3,))
    df = T.category_features(df, T.category_months(fact(spark, sf)))
    return shown(df.select(*KEYS, "sales_vs_category_3"))


@query(
    "t10_calendar_features",
    select(
        "CAST(month(MONAT) AS INTEGER) AS month, CAST(quarter(MONAT) AS INTEGER) AS quarter, "
        "CAST(year(MONAT) AS INTEGER) AS year"
    ),
)
def t10(spark, sf):
    return shown(T.calendar_features(fact(spark, sf)).select(*KEYS, "month", "quarter", "year"))


SELECTED = f"""{rnd("norm")} AS anz_produkt_normalized, {rnd("unit_preis", 5)} AS "PREIS",
  {rnd("unit_preis", 5)} AS unit_preis, max_6 AS sales_rolling_max_6, max_12 AS sales_rolling_max_12,
  {rnd("std_6 / nullif(mean_6, 0)")} AS sales_cv_6, {rnd("idx")} AS category_seasonal_index,
  {rnd("acceleration")} AS trend_acceleration, {rnd("price_3", 5)} AS price_rolling_mean_3,
  {rnd("norm_lag_6")} AS sales_norm_lag_6, CAST(month(MONAT) AS INTEGER) AS month, {rnd("trend_6")} AS trend_6,
  max_3 AS sales_rolling_max_3, {rnd("versus")} AS sales_vs_category_3, {rnd("mean_6")} AS sales_rolling_mean_6"""


@query("t14_selected_features", select(SELECTED))
def t14(spark, sf):
    return shown(T.select_features(T.create_features(fact(spark, sf), COVID)))


COMPLETE = """trend_6 IS NOT NULL AND acceleration IS NOT NULL AND norm_lag_6 IS NOT NULL AND max_3 IS NOT NULL
  AND std_6 / nullif(mean_6, 0) IS NOT NULL AND price_3 IS NOT NULL AND idx IS NOT NULL AND versus IS NOT NULL
  AND unit_preis IS NOT NULL"""


@query("t15_complete_rows", select("anz_produkt") + f" WHERE {COMPLETE}")
def t15(spark, sf):
    rows = T.complete_rows(T.create_features(fact(spark, sf), COVID), min_rows=S.MIN_COMPLETE_ROWS)
    return shown(rows.select(*KEYS, "anz_produkt"))


@query(
    "m11_model_input",
    FEATURES
    + f"""
SELECT count(*) AS rows, {rnd("avg(unit_preis)", 5)} AS unit_preis, {rnd("avg(max_6)")} AS sales_rolling_max_6,
       {rnd("avg(trend_6)")} AS trend_6, {rnd("avg(mean_6)")} AS sales_rolling_mean_6
FROM features WHERE {COMPLETE}""",
)
def m11(spark, sf):
    """Columns checked and put in trained order, then averaged."""
    rows = T.complete_rows(T.create_features(fact(spark, sf), COVID))
    matrix = T.select_features(rows, S.MODEL_FEATURES, keys=())
    names = ("unit_preis", "sales_rolling_max_6", "trend_6", "sales_rolling_mean_6")
    return shown(matrix.agg(F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in names]))
