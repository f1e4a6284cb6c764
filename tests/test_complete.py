"""Nothing is lost: old, empty, re-sent and hidden files, many slices, tables over sessions, copies gone."""

import json
import os
import re
import time

import pytest
from conftest import values
from pyspark.sql import functions as F

from forecourt import workspace
from forecourt.operators import geo, sales, stats
from forecourt.operators.ranking import last_per_key, number_rows
from forecourt.plans import cleaning
from forecourt.sinks import files as sinks
from forecourt.sinks import tables
from forecourt.sources.catalog import file_catalog
from forecourt.streaming import intake, state


def put(path, text, days_old=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    if days_old:
        moment = time.time() - 86_400 * days_old
        os.utime(path, (moment, moment))


def take(spark, zone, ledger, checkpoint, **options):
    intake.keep_ledger(intake.dropped_lines(spark, zone, max_files=1), ledger, checkpoint, **options).awaitTermination()
    return spark.read.parquet(ledger)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / d) for d in ("zone", "ledger", "checkpoint")]


def test_old_files_are_taken(spark, places):
    put(f"{places[0]}/new.csv", "a\n1\n")
    take(spark, *places)
    put(f"{places[0]}/old.csv", "a\n1\n2\n", days_old=400)
    assert values(take(spark, *places), "file_name", "data_count") == [("new.csv", 1), ("old.csv", 2)]


def test_empty_and_resent_files_get_records(spark, places):
    zone, ledger, _ = places
    put(f"{zone}/a b%+.csv", "h\n1\n2\n", days_old=2)
    put(f"{zone}/e.csv", "")
    put(f"{zone}/_hidden.csv", "h\n1\n")
    take(spark, *places)
    assert intake.reconcile(spark, zone, ledger) == 1
    assert intake.reconcile(spark, zone, ledger) == 0
    put(f"{zone}/a b%+.csv", "h\n1\n2\n3\n4\n5\n")
    assert intake.reconcile(spark, zone, ledger) == 1
    records = intake.current_records(spark.read.parquet(ledger))
    assert values(records, "file_name", "data_count", "upload_success") == [("a b%+.csv", 5, True), ("e.csv", 0, True)]


def test_reconciling_without_a_ledger(spark, places):
    put(f"{places[0]}/a.csv", "h\n1\n")
    put(f"{places[0]}/e.csv", "")
    assert intake.reconcile(spark, places[0], places[1]) == 2


def test_failed_uploads_get_a_record_with_an_error(spark, places):
    zone, ledger, _ = places
    put(f"{zone}/bad.csv", "h\n1\n")
    put(f"{zone}/good.csv", "h\n1\n2\n")

    def store(lines, batch_id):
        if lines.filter(F.col("file_name") == "bad.csv").count():
            raise OSError("disk")

    found = take(spark, *places, store=store)
    assert values(found, "file_name", "upload_success", "error") == [
        ("bad.csv", False, intake.UPLOAD_FAILED), ("good.csv", True, None)
    ]


def test_archived_files_leave_the_zone(spark, tmp_path, places):
    zone, archive = places[0], str(tmp_path / "archive")
    put(f"{zone}/a.csv", "id\n1\n")
    for name in ("b", "c"):
        rows = intake.dropped_rows(spark, zone, "id INT", archive=archive)
        intake.land(rows, places[1], places[2]).awaitTermination()
        put(f"{zone}/{name}.csv", "id\n2\n")
    rows = intake.dropped_rows(spark, zone, "id INT", archive=archive)
    intake.land(rows, places[1], places[2]).awaitTermination()
    assert spark.read.parquet(places[1]).count() == 3


def test_the_catalog_lists_every_file(spark, tmp_path):
    put(f"{tmp_path}/a.csv", "xyz")
    put(f"{tmp_path}/empty.csv", "")
    put(f"{tmp_path}/_u.txt", "1")
    put(f"{tmp_path}/.d", "12")
    put(f"{tmp_path}/sub/inside.csv", "1")
    found = file_catalog(spark, str(tmp_path))
    assert values(found, "name", "size") == [(".d", 2), ("_u.txt", 1), ("a.csv", 3), ("empty.csv", 0)]
    seconds = found.filter("name = 'a.csv'").select(F.unix_timestamp("modify_time")).first()[0]
    assert seconds == int(os.path.getmtime(f"{tmp_path}/a.csv"))


def test_listing_in_chunks_of_the_driver(spark, tmp_path, monkeypatch):
    from forecourt.sources import catalog

    monkeypatch.setattr(catalog, "_CHUNK", 3)
    for i in range(8):
        put(f"{tmp_path}/f{i}.{'ab'[i % 2]}", "x" * i)
    in_tasks = values(catalog.listed_files(spark, str(tmp_path)))
    of_type = values(catalog.listed_files(spark, str(tmp_path), ["B"]))
    monkeypatch.setattr(catalog, "can_list", lambda folder: False)
    assert values(catalog.listed_files(spark, str(tmp_path))) == in_tasks and len(in_tasks) == 8
    assert values(catalog.listed_files(spark, str(tmp_path), ["B"])) == of_type and len(of_type) == 4


def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    from forecourt.sources import catalog, listing

    monkeypatch.setattr(catalog, "_list_here", lambda *a: pytest.fail("entries in the driver"))
    for i in range(30):
        put(f"{tmp_path}/z {i}/a.csv", "x" * i)
        put(f"{tmp_path}/z {i}/_é.TXT", "")
        put(f"{tmp_path}/z {i}/.a.csv.crc", "1")
        put(f"{tmp_path}/z {i}/in/b.csv", "1")
    folders = [f"{tmp_path}/z {i}" for i in range(30)]
    found = catalog.file_catalog(spark, folders)
    assert values(found, "name", "size") == sorted([("a.csv", i) for i in range(30)] + [("_é.TXT", 0)] * 30, key=str)
    assert found.select("folder").distinct().count() == 30
    assert values(catalog.file_catalog(spark, folders, ["TXT"]), "type", "size") == [("TXT", 0)] * 30
    assert listing.listing(spark, [f"file:{p}" for p in folders]).rdd.getNumPartitions() == 30
    monkeypatch.setattr(listing, "MOST_TASKS", 7)
    reader = listing.ListingReader({"folders": json.dumps(folders)})
    assert sorted(p for task in reader.partitions() for p in task.folders) == sorted(folders)
    assert len(reader.partitions()) == 7
    # A file is its own entry; a missing folder is an error; no folder, no file.
    assert values(catalog.file_catalog(spark, f"{folders[3]}/a.csv"), "name", "size") == [("a.csv", 3)]
    assert catalog.file_catalog(spark, []).count() == 0
    with pytest.raises(Exception, match="No such file"):
        catalog.file_catalog(spark, [*folders, f"{tmp_path}/none"])


def test_filters_reach_the_listing(spark, tmp_path):
    from forecourt.sources.listing import listing

    put(f"{tmp_path}/a/x.csv", "1")
    put(f"{tmp_path}/a/y.txt", "1")
    both = listing(spark, [f"file:{tmp_path}/a", f"file:{tmp_path}/missing"])
    # The missing folder is never opened.
    here = both.filter(F.col("folder") == f"file:{tmp_path}/a")
    assert values(here, "type") == [("CSV",), ("TXT",)]
    assert values(here.filter(F.col("type").isin("CSV", "GZ")), "path") == [(f"file:{tmp_path}/a/x.csv",)]
    assert here.filter("type = 'CSV' AND type = 'TXT'").count() == 0


def test_an_empty_zone_says_so(spark, tmp_path):
    os.makedirs(tmp_path / "zone")
    with pytest.raises(FileNotFoundError, match="下没有数据文件"):
        cleaning.zone_job(spark, str(tmp_path / "zone"), "dedup")


@pytest.mark.parametrize("n,value", [(20_000, "1L"), (30_000, "id % 7 - 2")])
def test_many_slices_add_up(spark, n, value):
    df = spark.range(n).select(F.col("id").alias("n"), F.expr(value).cast("bigint").alias("v"))
    got = stats.slice_percentages(df, "n", "v", [F.col("n")])
    assert round(got.agg(F.sum(F.round(F.col("percent") * 100).cast("bigint"))).first()[0]) == 10_000
    assert got.count() == n


def test_values_that_cancel_out_have_no_share(spark):
    df = spark.createDataFrame([("a", 5), ("b", -5)], "n string, v long")
    assert values(stats.slice_percentages(df, "n", "v", [F.col("n")]), "percent") == [(0.0,), (0.0,)]


def test_tables_outlive_session_and_checkpoints(spark, tmp_path, name):
    spark.conf.set("spark.forecourt.tables.dir", str(tmp_path / "tables"))
    try:
        df = spark.range(3)
        tables.replace_table(df, name)
        assert tables.snapshot_once(spark, name, f"{name}_backup")
        for i in range(4):
            tables.replace_table(spark.range(i + 10), name)
            assert not tables.snapshot_once(spark, name, f"{name}_backup")
        assert len(tables.versions(spark, name)) == 2  # the newest and the one before
        other = spark.newSession()
        other.conf.set("spark.forecourt.tables.dir", str(tmp_path / "tables"))
        assert tables.open_table(other, name).count() == 13
        tables.restore(other, name, f"{name}_backup", ["id"])
        assert tables.open_table(spark, name).count() == 3
        tables.drop_table(spark, name)
        assert not tables.table_exists(spark, name)
        with pytest.raises(LookupError):
            tables.open_table(spark, name)
    finally:
        spark.conf.unset("spark.forecourt.tables.dir")


def test_a_failed_write_leaves_the_table(spark, tmp_path, name):
    spark.conf.set("spark.forecourt.tables.dir", str(tmp_path / "tables"))
    try:
        tables.replace_table(spark.range(3), name)
        with pytest.raises(Exception):
            tables.replace_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), name)
        assert tables.open_table(spark, name).count() == 3
    finally:
        spark.conf.unset("spark.forecourt.tables.dir")


def test_lines_keep_all_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "v", "k")], "id int, value string, k string")
    sinks.write_lines(df, f"{tmp_path}/all")
    sinks.write_lines(df, f"{tmp_path}/one", line="value")
    assert values(spark.read.text(f"{tmp_path}/all")) == [("1,v,k",)]
    assert values(spark.read.text(f"{tmp_path}/one")) == [("v",)]


@pytest.mark.parametrize("folders", [False, True])
def test_colliding_device_names_leave_one_document(spark, tmp_path, folders):
    rows = spark.createDataFrame([("10.0.1", 1, "x"), ("10_0_1", 2, "y"), ("10.0.2", 3, "z")], "device string, id long, p string")
    sinks.write_device_json(rows, f"{tmp_path}/j", ["id"], folders)
    assert values(spark.read.json(f"{tmp_path}/j"), "device", "id", "p") == [("10_0_1", 2, "y"), ("10_0_2", 3, "z")]
    assert any(d.startswith("device=") for d in os.listdir(f"{tmp_path}/j")) == folders


def test_flow_lines_take_one_row_for_the_origin(spark):
    places_ = spark.createDataFrame([("o", 1.0, 9.0), ("o", 2.0, 8.0), ("o", None, 0.0), ("p", 3.0, 4.0)], "name string, lon double, lat double")
    points = spark.createDataFrame([("p", 5)], "name string, value long")
    assert values(geo.flow_lines(points, places_, "o")) == [(1.0, 9.0, "p", 3.0, 4.0, 5)]
    assert geo.flow_lines(points, places_, "nowhere").count() == 0


def test_coverage_as_rows(spark):
    df = spark.createDataFrame([("n", "x"), ("n", None), ("s", "x")], "region string, customer_type string")
    assert values(sales.coverage_rows(df)) == [("customer_type", "x"), ("region", "n"), ("region", "s")]


def folders_of(path):
    return sorted(d for d in os.listdir(path) if d.startswith("batch_id="))


def test_compacting_states_and_ledgers(spark, tmp_path):
    states, ledger = str(tmp_path / "states"), str(tmp_path / "ledger")
    for batch in range(6):
        rows = spark.createDataFrame([("a", batch), (f"k{batch}", batch)], "k string, v long")
        rows.write.parquet(f"{states}/batch_id={batch}")
        rows.write.parquet(f"{ledger}/batch_id={batch}")
    before = values(state.current_state(spark.read.parquet(states), ["k"]))
    assert state.compact(spark, states, ["k"]) == 4
    assert state.compact(spark, ledger) == 4
    assert state.compact(spark, states, ["k"]) == 0
    assert folders_of(states) == ["batch_id=4", "batch_id=5"]
    assert values(state.current_state(spark.read.parquet(states), ["k"])) == before
    assert spark.read.parquet(states).count() == 8  # a once among the folded
    assert values(spark.read.parquet(ledger), "v").count((0,)) == 2 and spark.read.parquet(ledger).count() == 12


def test_scratch_copies_go(spark):
    root = workspace.fresh_dir(spark, "probe").rsplit("/", 1)[0].removeprefix("file:")
    number_rows(spark.range(10), [F.col("id")], "n").count()
    before = set(os.listdir(root))
    with workspace.scratch(spark):
        number_rows(spark.range(10), [F.col("id")], "n").count()
        assert len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) == before


def test_many_rows_per_key_beyond_the_task_cut(spark):
    """Above the planner's limit of 1,000 rows rows are sorted by range; they are the same."""
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    got = last_per_key(df, ["k"], [F.col("id").desc()], 1500)
    assert got.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("k").collect() == [(0, 1500, 3000), (1, 1500, 3001)]


def test_results_are_named_by_job_field_and_time(spark, tmp_path):
    out = cleaning.save_result(spark.range(3), str(tmp_path), "count", "Length(mm)")
    assert re.fullmatch(r"count_Length_mm__\d{13}[.]csv", os.path.basename(out))
    assert spark.read.option("header", True).csv(out).count() == 3
