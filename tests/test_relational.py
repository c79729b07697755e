"""Search, quality, reports, merges and skewed lookups."""

from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from monthcast.functions.skew import salted_lookup
from monthcast.operators import merge, quality, reporting, search
from monthcast.operators.ensemble import most_specific
from monthcast.sources.sales import latest_descriptions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_and_suggestions(spark):
    ids = ["AB123456" + f"{i:02d}" for i in range(7)] + ["AB999999", "C1"]
    index = search.product_index(spark.createDataFrame([(i,) for i in ids], "product_id string"))
    terms = ["ab12", " ab123456 ", "AB12345603", "AB1234560", "zz", "c", "AB12345699", "   "]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    got = dict(rows(search.search_products(index, df.where("trim(term) <> ''"))))
    assert got == {
        "ab12": ids[0],
        " ab123456 ": ids[0],
        "AB12345603": ids[3],
        "AB1234560": None,
        "zz": None,
        "c": "C1",
        "AB12345699": None,
    }
    suggested = rows(search.suggest_products(index, df.where("trim(term) <> ''")))
    assert suggested == [("AB1234560", i + 1, ids[i]) for i in range(5)]


def test_labels(spark):
    names = spark.createDataFrame([("A1", "x" * 51), ("B1234567", "short")], "NUMMER string, BANAME1 string")
    df = spark.createDataFrame([("A1",), ("B123456799",), ("C",)], "product_id string")
    got = {r.product_id: r.label for r in search.product_labels(df, names).collect()}
    assert got == {"A1": "x" * 47 + "... (A1)", "B123456799": "short (B123456799)", "C": "C"}


def test_last_description_wins(spark):
    raw = [(" A ", "old", 1), ("A", " new ", 2), ("B", None, 3), (None, "x", 4)]
    df = spark.createDataFrame(raw, "NUMMER string, BANAME1 string, seq int")
    assert rows(latest_descriptions(df)) == [("A", "new")]


def test_fingerprint_sees_values_and_copies_but_not_order(spark):
    def print_of(data):
        return quality.content_fingerprint(spark.createDataFrame(data, "a int, b int")).first()[0]

    base = print_of([(1, 4), (2, 5), (3, 6)])
    assert len(base) == 32
    assert base == print_of([(3, 6), (1, 4), (2, 5)])
    assert base != print_of([(1, 4), (2, 5), (4, 6)])
    assert base != print_of([(1, 4), (2, 5), (3, 6), (3, 6)])
    assert print_of([(1, None)]) != print_of([(None, 1)])


def test_fingerprint_keeps_values_apart(spark):
    def print_of(*row):
        return quality.content_fingerprint(spark.createDataFrame([row], "a string, b string")).first()[0]

    assert print_of("a|b", "c") != print_of("a", "b|c")
    assert print_of(None, "x") != print_of("\\N", "x")
    assert print_of(None, "x") != print_of("-", "x")
    assert print_of("1:a", "") != print_of("", "1:a")
    assert print_of("1", "2") == print_of("1", "2")


def test_quality_reports(spark):
    df = spark.createDataFrame(
        [("P", "2023-01-01", 1.0), ("P", "2023-01-01", 1.0), (None, "bad", None)], "p string, MONAT string, q double"
    )
    report = quality.quality_report(df, ["p", "region"], {"q": "bigint", "p": "string"})
    assert {(r.measure, r.column_name): r.value for r in report.collect()} == {
        ("total_rows", None): "3", ("duplicate_rows", None): "1",
        ("missing_pct", "p"): "33.33", ("missing_pct", "MONAT"): "0.0", ("missing_pct", "q"): "33.33",
        ("start", "MONAT"): "2023-01-01", ("end", "MONAT"): "2023-01-01", ("span_months", "MONAT"): "0",
        ("data_type", "p"): "string", ("data_type", "MONAT"): "string", ("data_type", "q"): "double",
        ("missing_column", "region"): None, ("wrong_type", "q"): "double",
    }
    nothing = {(r.measure, r.column_name): r.value for r in quality.quality_report(df.where("false")).collect()}
    assert nothing["total_rows", None] == "0" and nothing["missing_pct", "p"] is None and ("start", "MONAT") not in nothing
    assert dict(rows(quality.missing_share(df))) == {"p": 33.33, "MONAT": 0.0, "q": 33.33}
    assert quality.duplicate_rows(df).first()[0] == 1
    assert tuple(quality.date_range(df).first()) == (date(2023, 1, 1), date(2023, 1, 1), 0)
    assert quality.date_range(df.select("p")).count() == 0
    empty = df.where("false")
    assert {r.missing_pct for r in quality.missing_share(empty).collect()} == {None}


def test_reports(spark, monthly):
    fact = monthly({"P": range(1, 15), "S": [5, None, 7]})
    kpis = {r.product_id: (r.total_sales, r.avg_monthly_sales, r.data_months) for r in reporting.product_kpis(fact).collect()}
    assert kpis == {"P": (105.0, 7.5, 14), "S": (12.0, 6.0, 2)}
    profile = rows(reporting.calendar_profile(fact))
    assert ("P", 1, (1 + 13) / 2) in profile and {p for p, _, _ in profile} == {"P"}
    recent = {r.product_id: r.recent_sales for r in reporting.range_and_recent(fact).collect()}
    assert recent == {"P": [9, 10, 11, 12, 13, 14], "S": [5, 7]}
    forecast = spark.createDataFrame([("S", date(2020, 4, 1), 0, 4.5), ("S", date(2020, 5, 1), 1, 4.4)],
                                     "product_id string, MONAT date, step int, forecast double")
    summary = reporting.forecast_summary(forecast, reporting.product_kpis(fact)).first()
    assert (summary.total_forecast_shown, summary.avg_forecast_shown) == (8, 4)
    assert abs(summary.change_pct - (4.45 - 6) / 6 * 100) < 1e-9


def test_new_records_and_merge(spark):
    schema = "product_id string, MONAT int, q int"
    old = spark.createDataFrame([("P", 1, 10)], schema)
    current = spark.createDataFrame([("P", 1, 99), ("P", 2, 5), ("P", 2, 4), ("N", 1, 1)], schema)
    fresh = merge.new_records(current, old)
    assert rows(fresh) == [("N", 1, 1), ("P", 2, 4), ("P", 2, 5)]
    assert merge.new_records(current, None).count() == 4
    assert rows(merge.merge_first_wins(old, current, order=["q"])) == [("N", 1, 1), ("P", 1, 10), ("P", 2, 4)]
    assert rows(merge.new_products(current, old)) == [("N",)]


def test_merge_ranks_before_the_shuffle(spark):
    schema = "product_id string, MONAT int, q int"
    df = spark.createDataFrame([("P", 1, 10)], schema)
    plan = merge.merge_first_wins(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_salted_lookup_spreads_a_hot_key(spark):
    facts = spark.range(30_000).select(
        F.col("id").alias("product_id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 97).alias("k")
    )
    table = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = facts.join(table, "k", "left")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        salted = salted_lookup(facts, table, ["k"], ["product_id"])
        assert salted.count() == 30_000
        assert salted.exceptAll(plain.select(salted.columns)).count() == 0
        largest = salted.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        hot_only = salted_lookup(facts, table, ["k"], ["product_id"], hot=F.col("k") == 1)
        assert hot_only.exceptAll(plain.select(hot_only.columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert largest < 30_000 / 3


def test_most_specific_model(spark):
    data = pd.DataFrame({"product_id": ["P", "Q", "R", "S"], "product_category_id": ["C", "C", "D", None]})
    sold = spark.createDataFrame(data)
    models = spark.createDataFrame(
        [("product", "P", 1), ("category", "C", 2), ("global", "all", 3)], "level string, key string, m int"
    )
    got = {r.product_id: (r.model_level, r.m) for r in most_specific(sold, models).collect()}
    assert got == {"P": ("product", 1), "Q": ("category", 2), "R": ("global", 3), "S": ("global", 3)}
