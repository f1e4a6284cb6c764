"""Streams: two drops with one checkpoint equal one batch; a restart adds nothing."""

import os
import time

import pytest
from conftest import values
from pyspark.sql import functions as F

from forecourt.streaming import intake, state

SCHEMA = "id INT, device STRING, v INT"


def drop(folder, name, rows, end="\n", start=b""):
    os.makedirs(folder, exist_ok=True)
    body = "\n".join(["id,device,v", *[",".join(map(str, r)) for r in rows]]) + end
    with open(f"{folder}/{name}", "wb") as out:
        out.write(start + body.encode())
    return len(start) + len(body.encode())


FIRST = [(1, "a", 5), (2, "b", 7)]
SECOND = [(3, "a", 1), (4, "c", 9)]


def test_landing_in_two_drops(spark, tmp_path):
    zone, out, checkpoint = (str(tmp_path / d) for d in ("zone", "out", "cp"))

    def run():
        intake.land(intake.dropped_rows(spark, zone, SCHEMA, max_files=1), out, checkpoint).awaitTermination()

    drop(zone, "f1.csv", FIRST)
    run()
    drop(zone, "f2.csv", SECOND)
    run()
    run()
    expected = [(*r, "f1.csv") for r in FIRST] + [(*r, "f2.csv") for r in SECOND]
    assert values(spark.read.parquet(out)) == expected


def test_ledger(spark, tmp_path):
    zone, out, checkpoint = (str(tmp_path / d) for d in ("zone", "out", "cp"))

    def run():
        lines = intake.dropped_lines(spark, f"{zone}/*", max_files=2)
        intake.keep_ledger(lines, out, checkpoint).awaitTermination()

    sizes = {
        "closed.csv": drop(f"{zone}/d1", "closed.csv", FIRST),
        "open.csv": drop(f"{zone}/d1", "open.csv", FIRST, end=""),
        "marked.csv": drop(f"{zone}/d1", "marked.csv", FIRST, start=b"\xef\xbb\xbf"),
        "header.csv": drop(f"{zone}/d1", "header.csv", []),
    }
    run()
    ledger = spark.read.parquet(out)
    counted = {"closed.csv": 2, "open.csv": 1, "marked.csv": 2, "header.csv": 0}
    assert values(ledger, "file_name", "file_size", "data_count", "upload_success") == sorted(
        (n, sizes[n], counted[n], True) for n in sizes
    )
    time.sleep(1.1)
    again = drop(f"{zone}/d2", "closed.csv", FIRST + SECOND)
    run()
    run()
    ledger = spark.read.parquet(out)
    current = dict(values(intake.current_records(ledger), "file_name", "data_count"))
    assert current == {**counted, "closed.csv": 4}
    total = intake.intake_totals(ledger).first()
    assert total["received_count"] == 5 and total["received_bytes"] == sum(sizes.values()) + again
    assert total["last_file_name"] == "closed.csv" and "/d2/" in total["last_file_path"]


def test_latest_per_device_and_running_totals(spark, tmp_path):
    zone = str(tmp_path / "zone")
    paths = {k: (str(tmp_path / k), str(tmp_path / f"{k}-cp")) for k in ("latest", "sums")}

    def run():
        rows = intake.dropped_rows(spark, zone, SCHEMA).drop("source_file")
        state.write_updates(state.latest_per_key(rows, ["device"], ["id"]), *paths["latest"]).awaitTermination()
        sums = state.running_sums(rows, "device", F.col("v"))
        state.write_updates(sums, *paths["sums"]).awaitTermination()

    drop(zone, "f1.csv", FIRST)
    run()
    drop(zone, "f2.csv", SECOND)
    run()
    run()
    latest = state.current_state(spark.read.parquet(paths["latest"][0]), ["device"])
    assert values(latest, "device", "id", "v") == [("a", 3, 1), ("b", 2, 7), ("c", 4, 9)]
    sums = state.current_state(spark.read.parquet(paths["sums"][0]), ["device"])
    ranked = state.ranked_state(sums, "device", "value")
    assert values(ranked, "rank", "device", "value") == [(1, "c", 9), (2, "b", 7), (3, "a", 6)]


def test_landing_in_steps(spark, tmp_path):
    zone, out, checkpoint = (str(tmp_path / d) for d in ("zone", "out", "cp"))
    drop(zone, "f1.csv", FIRST)
    running = intake.land(intake.dropped_rows(spark, zone, SCHEMA), out, checkpoint, every="1 second")
    try:
        running.processAllAvailable()
        drop(zone, "f2.csv", SECOND)
        running.processAllAvailable()
    finally:
        running.stop()
    assert values(spark.read.parquet(out).select("id", "device", "v")) == FIRST + SECOND


def test_intake_limits():
    assert intake.intake_limits(5, 5) == (5, 5)
    assert intake.intake_limits(100, 0) == (60, 5)
    assert intake.intake_limits(1, 500) == (1, 100)
    with pytest.raises(ValueError):
        intake.intake_limits(0, 5)


def test_outcomes(spark):
    tasks = spark.sql(
        "SELECT *, CASE WHEN task_id = 3 THEN 'ws://h:7/x' END AS address FROM VALUES (1, 'a', 10), (2, 'b', 10), "
        "(3, 'c', 10), (4, 'd', 10) AS t(task_id, file_name, deadline)"
    )
    records = spark.sql(
        "SELECT * FROM VALUES ('a', 5L, 1L, 9, true), ('b', 5L, 1L, 9, false), ('c', 5L, 1L, 11, true) "
        "AS t(file_name, file_size, data_count, receive_time, upload_success)"
    )
    got = values(intake.outcomes(tasks, records))
    assert got == [
        (1, "a", "success", 1, 5, None),
        (2, "b", "error", 1, None, intake.UPLOAD_FAILED),
        (3, "c", "error", None, None, intake.TIMED_OUT % ("h", 7, 9999)),
        (4, "d", "error", None, None, intake.TIMED_OUT % ("127.0.0.1", 9999, 9999)),
    ]
