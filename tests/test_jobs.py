"""Files, snapshots, builds, updates, streamed ingest and the run log."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.operators import members as B
from monthcast.operators.features import complete_rows, create_features
from monthcast.operators.quality import content_fingerprint
from monthcast.plans import runs
from monthcast.plans.build import fold, full_build, incremental_update, load_hierarchy
from monthcast.plans.forecasts import export_all
from monthcast.session import scratch_path
from monthcast.sources import exports, sales
from monthcast.sources.snapshots import SnapshotStore
from monthcast.sources.files import children, data_files, overwrite, remove
from monthcast.streaming.ingest import KeyedTable, ingest, sales_stream

NOW = datetime(2024, 5, 1, 12)


def forest():
    parameters = B.TreeParameters(forest={"numTrees": 3, "maxDepth": 3, "seed": 1})
    return {"forest": B.tree_estimators(parameters)["forest"]}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


def test_regional_files_and_integration(spark, tmp_path):
    head = "product_id,product_category_id,MONAT,MENGE,PREIS\n"
    write(tmp_path / "CSV/F01/V2SC1010.csv", head + "A1 ,,2023-01-05,2,10\nA1,,bad,5,10\n")
    write(tmp_path / "CSV/F02/V2SC1010.csv", head + "A1,,2023-01-09,3,20\nB2,,2023-02-01,1,5\n")
    write(tmp_path / "master.csv", "BANUMMER,WARENGR\nA1, SHOES\n")
    lines = sales.read_regional_sales(spark, sales.region_paths(str(tmp_path), ("F01", "F02")))
    assert {(r.product_id, r.region) for r in lines.collect()} == {
        ("A1 ", "F01"), ("A1", "F01"), ("A1", "F02"), ("B2", "F02"),
    }
    fact = sales.integrated_dataset(lines, sales.read_article_master(spark, str(tmp_path / "master.csv")))
    assert rows(fact) == [
        ("A1", "SHOES", date(2023, 1, 1), 5.0, 15.0),
        ("B2", None, date(2023, 2, 1), 1.0, 5.0),
    ]
    assert sales.monthly_by_region(lines).count() == 3


def test_descriptions(spark, tmp_path):
    text = "NUMMER,BANAME1,BANAME2\n A1,alt,\nA1, Größe ,x\nB2,,\n"
    write(tmp_path / "d.csv", text, "latin-1")
    assert rows(sales.read_descriptions(spark, str(tmp_path / "d.csv"))) == [("A1", "Größe")]
    assert sales.read_descriptions(spark, str(tmp_path / "none.csv")).count() == 0


def test_export(spark, monthly, tmp_path):
    fact = monthly({"A1": [1, 2]})
    forecast = spark.createDataFrame([("A1", date(2020, 3, 1), 0, 3.5)],
                                     "product_id string, MONAT date, step int, forecast double")
    names = spark.createDataFrame([], "NUMMER string, BANAME1 string")
    table = export_all(fact, forecast, names)
    exports.write_export(table, str(tmp_path / "all"))
    exports.write_export_by_product(table, str(tmp_path / "each"))
    back = spark.read.csv(str(tmp_path / "all"), header=True)
    assert back.columns == ["Month", "Sales_Volume", "Data_Type", "Product_ID", "Product_Name", "Stamm_Product"]
    assert rows(back)[-1] == ("2020-03", "3.5", "Forecast", "A1", "Unknown Product", "A1")
    assert (tmp_path / "each" / "Product_ID=A1").exists()


@pytest.fixture(scope="module")
def sold():
    rng = np.random.default_rng(5)
    return {f"P{i}": rng.integers(1, 40, 20).tolist() for i in range(6)}


@pytest.fixture(scope="module")
def store(spark, monthly, sold):
    """A store built on a part of the data: fewer months, and one product less."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    early = {p: v[:17] for p, v in sold.items() if p != "P5"}
    full_build(store, lambda: monthly(early), NOW, estimators=forest())
    return store


def test_build_describes_its_snapshot(store, spark):
    entry = store.log().first()
    assert (entry.version, entry.num_products, entry.num_records) == (1, 5, 85)
    assert entry.date_range.start == date(2020, 1, 1) and entry.feature_columns == list(S.MODEL_FEATURES)
    assert entry.model_counts.product_models == 5 and len(entry.fingerprint) == 32
    assert store.is_fresh(NOW + timedelta(days=7))
    assert not store.is_fresh(NOW + timedelta(days=7, seconds=1))
    assert not SnapshotStore(spark, store.root + "/elsewhere").is_fresh(NOW)


def test_fresh_snapshot_is_used_and_a_failed_load_falls_back(store):
    def broken():
        raise OSError("no sources")

    features, _ = full_build(store, broken, NOW + timedelta(days=1))
    assert features.count() == 85
    features, model = full_build(store, broken, NOW + timedelta(days=30))
    assert features.count() == 85 and model.counts()["product_models"] == 5
    with pytest.raises(OSError):
        full_build(SnapshotStore(store.spark, store.root + "/empty"), broken, NOW)


def test_update_equals_a_build_from_scratch(store, monthly, sold):
    later = NOW + timedelta(days=1)
    features, model = incremental_update(store, lambda: monthly(sold), later)
    assert store.current_version() == 2
    fresh = create_features(monthly(sold))
    names = ["product_id", "MONAT", *S.SELECTED_FEATURES]
    got = features.select(names).orderBy("product_id", "MONAT").toPandas()
    want = fresh.select(names).orderBy("product_id", "MONAT").toPandas()
    assert got.product_id.tolist() == want.product_id.tolist()
    for name in S.SELECTED_FEATURES:
        assert np.allclose(got[name].astype(float), want[name].astype(float), equal_nan=True), name
    assert model.counts()["product_models"] == 6
    again, _ = incremental_update(store, lambda: monthly(sold), later)
    assert store.current_version() == 2 and again.count() == 120
    assert load_hierarchy(store, 1).counts()["product_models"] == 5


@pytest.mark.parametrize("damage", ["nodes gone", "nodes damaged", "metadata gone"])
def test_an_update_that_finds_a_damaged_tree_member_builds_anew(spark, monthly, sold, damage):
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    full_build(store, lambda: monthly({p: s[:17] for p, s in sold.items()}), NOW, estimators=forest())
    member = f"{store.part_path(1, 'models')}/members/forest/stages"
    stage = next(c for c in children(spark, member) if "RandomForest" in c)
    if damage == "nodes damaged":
        for path in data_files(spark, f"{stage}/data"):
            overwrite(spark, path, b"not a tree")
    else:
        remove(spark, f"{stage}/{'data' if damage == 'nodes gone' else 'metadata'}")
    features, model = incremental_update(store, lambda: monthly(sold), NOW + timedelta(days=1), estimators=forest())
    last = store.log().orderBy(F.desc("version")).first()
    assert (last.version, last.kind, last.num_products) == (2, "build", features.select("product_id").distinct().count())
    assert model.names == ["forest", "linear"] and model.predict(complete_rows(features)).count() > 0


def test_versions_add_up_fold_and_expire(spark, monthly, sold):
    """Updates write what arrived; many layers read as one table; folding and expiry change nothing that is read."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    months = (15, 17, 18, 20)
    full_build(store, lambda: monthly({p: v[: months[0]] for p, v in sold.items() if p != "P5"}), NOW, estimators={})
    for k, m in enumerate(months[1:], 1):
        some = {p: v[:m] for p, v in sold.items() if m == 20 or p in ("P1", "P2")}
        incremental_update(store, lambda some=some: monthly(some), NOW + timedelta(days=k))
    names = ["product_id", "MONAT", *S.SELECTED_FEATURES]
    want = sorted(map(str, create_features(monthly(sold)).select(names).collect()))
    seen = lambda: sorted(map(str, store.read_features().select(names).collect()))
    assert seen() == want and {p: len(f) for p, f in store.manifest().items()} == {
        "base": 4, "category": 1, "features": 4, "models": 4, "sums": 4,
    }
    log = {r.version: r for r in store.log().collect()}
    assert log[2].bytes_written < log[1].bytes_written and log[2].arrived_records == 4 and log[4].num_records == 120
    assert spark.read.parquet(store.part_path(2, "features")).select("product_id").distinct().count() == 2
    whole = {v: content_fingerprint(store.read_part("base", v)).first()[0] for v in log}
    assert {v: r.fingerprint for v, r in log.items()} == whole and len(set(whole.values())) == 4
    counts = load_hierarchy(store).counts()
    spark.range(1).write.parquet(store.part_path(3, "left"))  # what a job that died has left
    assert store.expire() == ["v00000001/category", "v00000002/category", "v00000003/category", "v00000003/left"]
    assert seen() == want and store.has_parts()
    assert fold(store, NOW) == 5 and seen() == want and load_hierarchy(store).counts() == counts
    assert len(store.expire(keep=2)) == 0 and len(store.expire()) == 17 and store.expire() == []
    assert seen() == want and store.has_parts() and not store.has_parts(4)
    with pytest.raises(ValueError):
        store.expire(0)


def test_fingerprint_of_an_update_with_another_column(spark, monthly, sold):
    """Rows of before get a null in it, so all are hashed again."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    full_build(store, lambda: monthly({p: v[:15] for p, v in sold.items()}), NOW, estimators={})
    incremental_update(store, lambda: monthly(sold).withColumn("note", F.lit("n")), NOW + timedelta(days=1))
    base = store.read_part("base")
    assert "note" in base.columns and len(store.manifest()["sums"]) == 1
    assert store.log().where("version = 2").first().fingerprint == content_fingerprint(base).first()[0]


def test_update_without_a_snapshot_builds_one(spark, monthly, sold):
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    features, _ = incremental_update(store, lambda: monthly(sold), NOW, estimators={})
    assert store.current_version() == 1 and features.count() == 120


HEAD = "product_id,product_category_id,MONAT,MENGE,PREIS\n"


def taken(keyed):
    return {(r.product_id, r.MONAT.month): (r.anz_produkt, r.unit_preis) for r in keyed.read().collect()}


def test_streamed_files_add_up(spark, tmp_path):
    keyed = KeyedTable(spark, str(tmp_path / "keyed"))

    def run():
        ingest(sales_stream(spark, str(tmp_path / "inbox")), keyed, str(tmp_path / "progress")).awaitTermination()
        return taken(keyed)

    write(tmp_path / "inbox/a.csv", HEAD + "A,,2023-01-05,2,10\nA,,07.01.2023,3,13\nA,,soon,9,9\n")
    assert run() == {("A", 1): (5.0, 11.5)}
    assert run() == {("A", 1): (5.0, 11.5)}
    write(tmp_path / "inbox/b.csv", HEAD + "A,,2023-01-09,9,10\nA,,2022-12-09,4,\nB,,2023-01-01,,1\n")
    assert run() == {("A", 1): (14.0, 11.0), ("A", 12): (4.0, None), ("B", 1): (0.0, 1.0)}


@pytest.mark.parametrize("files", [1, 2, None])
def test_files_per_batch_do_not_matter(spark, tmp_path, files):
    for k in range(3):
        write(tmp_path / f"inbox/{k}.csv", HEAD + f"A,,2023-01-0{k + 1},{k + 2},10\nB,,2023-0{k + 1}-01,1,1\n")
    keyed = KeyedTable(spark, str(tmp_path / "keyed"))
    stream = sales_stream(spark, str(tmp_path / "inbox"), files_per_batch=files)
    ingest(stream, keyed, str(tmp_path / "progress")).awaitTermination()
    assert taken(keyed) == {("A", 1): (9.0, 10.0), **{("B", m): (1.0, 1.0) for m in (1, 2, 3)}}


LINES = "product_id string, MONAT string, MENGE double, PREIS double, source_file string"


def test_a_repeated_batch_or_file_leaves_the_same_table(spark, tmp_path):
    keyed = KeyedTable(spark, str(tmp_path / "keyed"))
    lines = lambda data: spark.createDataFrame(data, LINES)
    keyed.add(lines([("A", "2023-01-01", 1.0, 2.0, "f1")]), 0)
    for _ in range(2):
        keyed.add(lines([("A", "2023-01-09", 9.0, 4.0, "f2"), ("B", "2023-01-01", 3.0, 1.0, "f2"), ("A", "2023-01-01", 1.0, 2.0, "f1")]), 1)
    keyed.add(lines([("B", "2023-01-01", 3.0, 1.0, "f2"), ("A", "2023-01-09", 9.0, 4.0, "f2")]), 2)
    assert taken(keyed) == {("A", 1): (10.0, 3.0), ("B", 1): (3.0, 1.0)}
    keyed.add(lines([("B", "2023-01-01", 4.0, 1.0, "f2")]), 2)  # the same name with other lines
    assert taken(keyed) == {("A", 1): (10.0, 3.0), ("B", 1): (7.0, 1.0)}


def units(keyed):
    return sum(r.anz_produkt for r in keyed.read().collect())


@pytest.mark.parametrize("fold", [False, True])
def test_a_fresh_checkpoint_loses_and_doubles_nothing(spark, tmp_path, fold):
    keyed = KeyedTable(spark, str(tmp_path / "keyed"))

    def run(inbox, progress):
        ingest(sales_stream(spark, str(tmp_path / inbox)), keyed, str(tmp_path / progress)).awaitTermination()
        if fold:
            keyed.compact()
            keyed.expire()
        return units(keyed)

    line = lambda n: HEAD + f"A,,2023-01-05,{n},10\n"
    write(tmp_path / "inbox/a.csv", line(2))
    assert run("inbox", "one") == 2
    write(tmp_path / "inbox/b.csv", line(3))
    assert run("inbox", "one") == 5
    assert run("inbox", "two") == 5  # the same files again
    write(tmp_path / "later/c.csv", line(7))  # the old files archived, one new
    assert run("later", "three") == 12
    write(tmp_path / "later/a.csv", line(2))  # an old file back under its name
    assert run("later", "three") == 12
    write(tmp_path / "later/d.csv", line(2))  # equal lines under another name are other sales
    assert run("later", "three") == 14


def test_a_batch_that_dies_between_its_writes_does_not_count(spark, tmp_path):
    keyed = KeyedTable(spark, str(tmp_path / "keyed"))
    lines = lambda data: spark.createDataFrame(data, LINES)
    batch = lines([("A", "2023-01-01", 1.0, 2.0, "f1")])
    keyed.add(lines([("A", "2023-01-01", 4.0, 2.0, "f0")]), 0, run="x")
    keyed.add(batch, 1, run="x")
    remove(spark, f"{keyed.path}/ledger/run=run-x/batch=1")  # its parts are there, its ledger row is not
    assert units(keyed) == 4
    keyed.compact()
    assert units(keyed) == 4
    keyed.add(batch, 1, run="x")
    assert units(keyed) == 5
    keyed.compact()
    spark.range(1).write.parquet(f"{keyed.path}/compacted/00000003/ledger")  # a compaction that died
    assert units(keyed) == 5
    assert keyed.expire() == 5 and units(keyed) == 5  # two batches of two folders, one compaction
    keyed.add(batch, 1, run="x")  # a folded batch runs again
    keyed.compact()
    assert units(keyed) == 5


def test_columns_are_taken_by_name(spark, tmp_path):
    write(tmp_path / "CSV/F01/V2SC1010.csv", "MONAT,product_id,product_category_id,PREIS,MENGE\n2023-01-01,A,C1,9.5,2\n")
    write(tmp_path / "CSV/F02/V2SC1010.csv", "unit_preis,x,anz_produkt,MONAT,product_id\n8.5,,3,20230106,B\n")
    lines = sales.read_regional_sales(spark, sales.region_paths(str(tmp_path), ("F01", "F02")))
    assert rows(lines.select("product_id", "product_category_id", "MONAT", "MENGE", "PREIS", "region")) == [
        ("A", "C1", "2023-01-01", 2.0, 9.5, "F01"), ("B", None, "20230106", 3.0, 8.5, "F02"),
    ]
    master = spark.createDataFrame([("B", "M")], "product_id string, product_category_id string")
    fact = sales.integrated_dataset(lines, master).select("product_id", "product_category_id", "anz_produkt")
    assert rows(fact) == [("A", "C1", 2.0), ("B", "M", 3.0)]
    write(tmp_path / "d.csv", "ID,NUMMER,X,BANAME1\n1,7,A1,Name\n")
    assert rows(sales.read_descriptions(spark, str(tmp_path / "d.csv"))) == [("7", "Name")]
    write(tmp_path / "CSV/F03/V2SC1010.csv", "MONAT,product_id,PREIS\n2023-01-01,A,9.5\n")
    with pytest.raises(ValueError, match="MENGE"):
        sales.read_regional_sales(spark, sales.region_paths(str(tmp_path), ("F03",)))


def test_run_log(spark, monthly, tmp_path):
    path = str(tmp_path / "runs")

    def failing():
        raise ValueError("disk full")

    runs.logged_run(spark, path, NOW, lambda: monthly({"A": [1, 2], "B": [3]}))
    runs.logged_run(spark, path, NOW, failing)
    log = {r.success: r for r in runs.read_run_log(spark, path).collect()}
    assert (log[True].num_records, log[True].num_products, log[True].error_message) == (3, 2, None)
    assert (log[False].num_records, log[False].error_message) == (0, "disk full")
    assert log[True].processing_time_seconds > 0
