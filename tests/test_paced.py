"""Lines by index, intake at a pace, outcomes that a stream tells by itself."""

import os
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from forecourt.sources.catalog import listed_files
from forecourt.sources.line_index import line_index, page_of_lines, page_of_rows, page_pieces
from forecourt.streaming import intake, paced, state

TEXTS = {
    "a.csv": b"h\n1\n2\n3\n",
    "b.csv": b"h\r\n4\r\n5",
    "c.csv": b"",
    "d.csv": b"h\n" + b"x" * 500 + b"\n\n\n6\n",
    "e.csv": "h\n销量\n7\n".encode("gbk"),
    "f g%20.csv": b"\n8\n",
}


@pytest.fixture
def zone(tmp_path):
    folder = tmp_path / "zone"
    os.makedirs(folder)
    for name, data in TEXTS.items():
        (folder / name).write_bytes(data)
    return str(folder)


def lines(data):
    found = data.decode("gbk", "replace").split("\n")
    return [x.removesuffix("\r") for x in (found[:-1] if found[-1] == "" else found)]


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_lines_and_rows_as_in_the_files(spark, zone, piece):
    index = line_index(listed_files(spark, zone), header=1, piece=piece)
    expected = [(n, i + 1, line) for n, data in TEXTS.items() for i, line in enumerate(lines(data))]
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    found = page_of_lines(index, 1, 1000, "gbk").select(name, "position", "line")
    assert values(found) == sorted(expected)
    assert values(page_of_lines(index, 2, 2, "gbk").select(name, "position", "line")) == sorted(e for e in expected if e[1] in (2, 3))
    rows = [line for _, i, line in sorted(expected) if i > 1]
    assert [tuple(r) for r in page_of_rows(index, 3, 5, "gbk").orderBy("row").select("row", "line").collect()] == list(
        enumerate(rows, 1)
    )[2:7]


def test_a_page_reads_its_pieces_alone(spark, tmp_path):
    os.makedirs(tmp_path / "z")
    (tmp_path / "z" / "big.txt").write_bytes(b"".join(b"line %06d\n" % i for i in range(100_000)))
    index = line_index(listed_files(spark, str(tmp_path / "z")), piece=10_000)
    pieces = page_pieces(index, 50_000, 100).selectExpr("sum(end - begin)", "count(*)").first()
    assert pieces[0] <= 30_000 and pieces[1] <= 2
    found = page_of_lines(index, 50_000, 100).orderBy("position").collect()
    assert [r["line"] for r in found] == [f"line {i:06d}" for i in range(49_999, 50_099)]


def run(spark, index, folder, rows_per_batch, batches=None, seen=None):
    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    stream = paced.paced_lines(spark, index, f"{folder}/progress", rows_per_batch, batches)
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/cp").start()
    paced.finish(query)
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture
def index(spark, tmp_path):
    os.makedirs(tmp_path / "rows")
    for f in range(4):
        (tmp_path / "rows" / f"f{f}.csv").write_text("id\n" + "".join(f"{f * 25 + i}\n" for i in range(25)))
    path = str(tmp_path / "index")
    line_index(listed_files(spark, str(tmp_path / "rows")), header=1, piece=20).write.parquet(path)
    return path


def test_batches_hold_the_pace_and_a_restart_repeats_nothing(spark, tmp_path, index):
    first = run(spark, index, tmp_path, 7, batches=3)
    assert values(first, "line") == sorted((str(i),) for i in range(21))
    assert values(run(spark, index, tmp_path, 7, batches=3), "line") == values(first, "line")  # it has ended
    whole = run(spark, index, tmp_path, 30)
    assert values(whole, "line") == sorted((str(i),) for i in range(100))
    assert whole.filter("cast(line as long) <> row - 1").isEmpty()
    sizes = [r["count"] for r in whole.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [7, 7, 7, 30, 30, 19]
    assert run(spark, index, tmp_path, 30).count() == 100


def test_a_batch_that_failed_comes_again(spark, tmp_path, index):
    failed = []

    def save(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise OSError("no")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={batch_id}")

    for _ in range(2):
        stream = paced.paced_lines(spark, index, f"{tmp_path}/progress", 40)
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            paced.finish(query)
        except Exception:
            assert failed
    assert values(spark.read.parquet(f"{tmp_path}/out"), "line") == sorted((str(i),) for i in range(100))


def test_an_intake_task_takes_seconds_times_rows(spark, tmp_path, index):
    out = f"{tmp_path}/task"
    query = paced.collect_paced(
        spark, index, f"{tmp_path}/p", f"{tmp_path}/c", lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), 2, 0
    )
    paced.finish(query)
    rows = spark.read.parquet(out)
    assert rows.count() == 2 * intake.DEFAULT_ROWS_PER_SECOND
    assert rows.groupBy("batch_id").count().agg(F.max("count")).first()[0] == intake.DEFAULT_ROWS_PER_SECOND
    with pytest.raises(ValueError):
        paced.collect_paced(spark, index, "p", "c", None, 0, 5)


START = datetime(2025, 1, 1, 12)
TASKS = "task_id long, file_name string, address string, start timestamp, deadline timestamp"
RECORDS = "file_name string, file_size long, data_count long, receive_time timestamp, upload_success boolean, error string"


def test_a_stream_says_late_by_itself(spark, tmp_path):
    places = {k: str(tmp_path / k) for k in ("tasks", "records", "out", "cp")}
    at = lambda s: START + timedelta(seconds=s)

    def step(tasks, records):
        task_rows = [(i, f"f{i}", "h:7", at(s), at(s + 40)) for i, s in tasks]
        record_rows = [(f"f{i}", 9, 3, at(s), ok, None) for i, s, ok in records]
        spark.createDataFrame(task_rows, TASKS).write.mode("append").parquet(places["tasks"])
        spark.createDataFrame(record_rows, RECORDS).write.mode("append").parquet(places["records"])
        streams = [spark.readStream.schema(s).parquet(places[k]) for k, s in (("tasks", TASKS), ("records", RECORDS))]
        intake.land(intake.late_outcomes(*streams), places["out"], places["cp"]).awaitTermination()
        return {(r["task_id"], r["status"], r["data_count"], bool(r["message"] and r["message"].startswith("采集超时"))) for r in spark.read.parquet(places["out"]).collect()}

    found = step([(1, 0), (2, 0), (3, 0), (4, 0)], [(1, 30, True), (2, 30, False)])
    assert found == {(1, "success", 3, False), (2, "error", 3, False)}  # 3 and 4 may still come
    # A record after the deadline, while time has not passed it for the stream: still no outcome.
    found = step([(5, 50)], [(3, 45, True)])
    assert (3, "error", None, True) not in found and len(found) == 2
    found = step([(6, 300)], [(6, 310, True)])
    assert found == {
        (1, "success", 3, False), (2, "error", 3, False), (3, "error", None, True), (4, "error", None, True),
        (5, "error", None, True), (6, "success", 3, False),
    }
    assert step([(7, 900)], [(4, 901, True)]) >= found  # too late for task 4


def test_state_store_has_a_row_per_key(spark, tmp_path):
    zone, out, cp = (str(tmp_path / k) for k in ("zone", "out", "cp"))
    for step in range(3):
        spark.createDataFrame([("a", step), ("b", 1)], "k string, v long").write.mode("append").parquet(zone)
        rows = spark.readStream.schema("k string, v long").parquet(zone)
        state.write_updates(state.running_sums(rows, "k", F.col("v")), out, cp).awaitTermination()
    assert values(state.stored_sums(spark, cp, "k")) == [("a", 3), ("b", 3)]
    assert spark.read.parquet(out).count() == 6 and state.stored_state(spark, cp).count() == 2
