"""Structured Streaming over the events table dropped as CSV files."""

from __future__ import annotations

import calendar

from pyspark.sql import functions as F

from forecourt.functions import names
from forecourt.operators.ranking import number_rows
from forecourt.sinks.files import write_csv
from forecourt.sources.catalog import listed_files
from forecourt.sources.line_index import line_index
from forecourt.streaming import intake, paced, state
from forecourt.suite import query
from forecourt.suite.views import table
from forecourt.workspace import file_system, fresh_dir, landed_once

ROWS = "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, device STRING, props STRING"
HEADER_BYTES = len("event_id,user_id\n")


def _device():
    user = F.col("user_id")
    return F.concat(F.lit("10.0."), (user % 7).cast("string"), F.lit("."), (user % 200).cast("string"))


def landing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _device().alias("device"), "props")
    return landed_once(spark, f"{sf_dir}/landing", lambda p: write_csv(rows, p))


def typed_landing(spark, sf_dir):
    """Files in one folder per event type, with two numeric columns."""

    def write(path):
        rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
        rows.write.partitionBy("event_type").option("header", True).csv(path)

    return landed_once(spark, f"{sf_dir}/typed_landing", write)


def _ledger(spark, sf_dir):
    out = fresh_dir(spark, "ledger")
    lines = intake.dropped_lines(spark, typed_landing(spark, sf_dir))
    intake.keep_ledger(lines, out, fresh_dir(spark, "ledger-checkpoint")).awaitTermination()
    return state.read_batches(spark, out)


@query("i1_landed_rows", "SELECT event_id, user_id, ts, props FROM events")
def i1_landed_rows(spark, sf_dir):
    rows = intake.dropped_rows(spark, landing(spark, sf_dir), ROWS)
    out = fresh_dir(spark, "landed")
    intake.land(rows, out, fresh_dir(spark, "landed-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "ts", "props")


def several_files(spark, sf_dir):
    """The events in eight CSV files."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _device().alias("device"), "props")
    return landed_once(spark, f"{sf_dir}/several_files", lambda p: write_csv(rows.repartition(8), p))


@query("i4_paced_rows", "SELECT event_id, user_id, ts, props, 4 AS batches FROM events")
def i4_paced_rows(spark, sf_dir):
    rows = intake.dropped_rows(spark, several_files(spark, sf_dir), ROWS, max_files=2)
    out = fresh_dir(spark, "paced")
    landing_ = intake.land(rows, out, fresh_dir(spark, "paced-checkpoint"))
    landing_.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in landing_.recentProgress)
    return spark.read.parquet(out).select("event_id", "user_id", "ts", "props", F.lit(batches).alias("batches"))


@query(
    "i2_ledger",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS data_count,
              CAST(sum(length(CAST(event_id AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + 2) AS BIGINT) AS payload,
              true AS stored, CAST(NULL AS VARCHAR) AS error
       FROM events GROUP BY event_type""",
)
def i2_ledger(spark, sf_dir):
    records = _ledger(spark, sf_dir)
    kind = F.regexp_extract("file_path", "event_type=([^/]+)/", 1).alias("event_type")
    return records.groupBy(kind).agg(
        F.sum("data_count").alias("data_count"),
        F.sum(F.col("file_size") - HEADER_BYTES).alias("payload"),
        F.bool_and("upload_success").alias("stored"),
        F.max("error").alias("error"),
    )


def dated_landing(spark, sf_dir):
    """One file per event type (each type in a task of its own), named after it, with a modification time that follows the names."""

    def write(path):
        rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
        rows.repartition("event_type").write.partitionBy("event_type").option("header", True).csv(f"{path}-parts")
        files, source = file_system(spark, f"{path}-parts")
        target = file_system(spark, path)[1]
        files.mkdirs(target)
        start = calendar.timegm((2025, 1, 1, 0, 0, 0)) * 1000
        folders = sorted((f.getPath() for f in files.listStatus(source) if f.isDirectory()), key=lambda f: f.getName())
        for number, folder in enumerate(folders):
            for file in files.listStatus(folder):
                name = file.getPath().getName()
                if name.startswith("part-"):
                    place = file_system(spark, f"{path}/{folder.getName().split('=')[1]}.csv")[1]
                    files.rename(file.getPath(), place)
                    files.setTimes(place, start + 86_400_000 * 30 * number, -1)

    return landed_once(spark, f"{sf_dir}/dated_landing", write)


def _dated_ledger(spark, sf_dir, fails=None):
    """The ledger of the dated files, taken one by one; storing fails for the name ``fails``."""
    out = fresh_dir(spark, "dated-ledger")

    def store(lines, batch_id):
        if fails and not lines.filter(F.col("file_name") == fails).isEmpty():
            raise OSError("cannot store")

    lines = intake.dropped_lines(spark, dated_landing(spark, sf_dir), max_files=1)
    intake.keep_ledger(lines, out, fresh_dir(spark, "dated-checkpoint"), store=store).awaitTermination()
    state.compact(spark, out)
    return state.read_batches(spark, out)


@query(
    "i3_totals",
    """SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS received_count,
              CAST(sum(length(CAST(event_id AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + 2)
                   + 17 * count(DISTINCT event_type) AS BIGINT) AS received_bytes,
              max(event_type) || '.csv' AS last_file_name, true AS last_path_known FROM events""",
)
def i3_totals(spark, sf_dir):
    # Months lie between the files' times, so a source that forgets old files would drop most.
    totals = intake.intake_totals(_dated_ledger(spark, sf_dir))
    known = F.col("last_file_path").endswith(F.concat(F.lit("/"), F.col("last_file_name")))
    return totals.select("received_count", "received_bytes", "last_file_name", known.alias("last_path_known"))


LATEST = """SELECT '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) AS device,
       max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(props, event_id) AS props
    FROM events GROUP BY 1"""


@query("i5_latest_stream", LATEST)
def i5_latest_stream(spark, sf_dir):
    rows = intake.dropped_rows(spark, landing(spark, sf_dir), ROWS)
    newest = state.latest_per_key(rows.select("device", "event_id", "ts", "props"), ["device"], ["ts", "event_id"])
    out = fresh_dir(spark, "latest")
    state.write_updates(newest, out, fresh_dir(spark, "latest-checkpoint")).awaitTermination()
    return state.current_state(spark.read.parquet(out), ["device"])


@query("i5_latest_batch", LATEST)
def i5_latest_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(_device().alias("device"), "event_id", "ts", "props")
    return state.latest_per_key(rows, ["device"], ["ts", "event_id"])


@query(
    "i6_ranked_totals",
    """SELECT device, value, row_number() OVER (ORDER BY value DESC, device) AS rank FROM (
         SELECT '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) AS device,
                CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY 1) t""",
)
def i6_ranked_totals(spark, sf_dir):
    rows = intake.dropped_rows(spark, landing(spark, sf_dir), ROWS)
    out = fresh_dir(spark, "totals")
    sums = state.running_sums(rows, "device", F.col("user_id"))
    state.write_updates(sums, out, fresh_dir(spark, "totals-checkpoint")).awaitTermination()
    return state.ranked_state(state.current_state(spark.read.parquet(out), ["device"]), "device", "value")


@query(
    "i7_outcomes",
    """WITH sent AS (
         SELECT event_type, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY event_type) AS place,
                CAST(sum(length(CAST(event_id AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + 2) + 17 AS BIGINT) AS bytes
         FROM events GROUP BY event_type),
       tasks AS (
         SELECT place AS task_id, event_type || '.csv' AS file_name, n, bytes, place = 2 AS lost, place <= 3 AS seen FROM sent
         UNION ALL SELECT 100 + place, 'never_' || event_type || '.csv', NULL, NULL, false, false FROM sent)
       SELECT CAST(task_id AS BIGINT) AS task_id, file_name, CASE WHEN seen AND NOT lost THEN 'success' ELSE 'error' END AS status,
              CASE WHEN seen THEN n END AS data_count, CASE WHEN seen AND NOT lost THEN bytes END AS file_size,
              CASE WHEN seen AND NOT lost THEN NULL WHEN seen THEN '数据已通过 Socket 接收，但写入 HDFS 失败，请检查 HDFS 连接状态'
                   ELSE '采集超时：无法连接数据源 10.0.0.' || CAST(task_id % 9 AS VARCHAR)
                        || ':81，请确认采集服务端已启动（本机监听端口 9999）' END AS message
       FROM tasks""",
)
def i7_outcomes(spark, sf_dir):
    # A task per file and one that nothing was sent for; the deadline cuts off the later files.
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    kinds = number_rows(kinds, [F.col("event_type")], "place")
    file_name = F.concat(F.col("event_type"), F.lit(".csv"))
    sent = kinds.select(F.col("place").alias("task_id"), file_name.alias("file_name"))
    never = kinds.select((F.col("place") + 100).alias("task_id"), F.concat(F.lit("never_"), file_name).alias("file_name"))
    address = F.concat(F.lit("tcp://10.0.0."), (F.col("task_id") % 9).cast("string"), F.lit(":81/in"))
    deadline = F.lit("2025-03-15 00:00:00").cast("timestamp")
    tasks = sent.unionByName(never).withColumns({"address": address, "deadline": deadline})
    second = kinds.orderBy("event_type").limit(2).agg(F.max("event_type")).first()[0]
    records = intake.current_records(_dated_ledger(spark, sf_dir, fails=f"{second}.csv"))
    return intake.outcomes(tasks, records)


def _written_index(spark, sf_dir):
    """Line index of the events, sorted over several CSV files."""

    def write(path):
        rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id")
        write_csv(rows, f"{path}-files")
        line_index(listed_files(spark, f"{path}-files").filter("path LIKE '%.csv'"), header=1).write.parquet(path)

    return landed_once(spark, f"{sf_dir}/events_by_line", write)


@query(
    "i4_paced_source",
    """WITH pace AS (SELECT greatest(1000, (count(*) + 5) // 6) AS n FROM events)
       SELECT event_id, user_id, event_type, CAST((row_number() OVER (ORDER BY event_id) - 1) // n AS BIGINT) AS batch
       FROM events, pace""",
)
def i4_paced_source(spark, sf_dir):
    # Ends after two batches; a second run with the same folders goes on where it stood.
    index, out = _written_index(spark, sf_dir), fresh_dir(spark, "paced-rows")
    pace = max(1000, (table(spark, sf_dir, "events").count() + 5) // 6)
    progress, checkpoint = fresh_dir(spark, "paced-progress"), fresh_dir(spark, "paced-rows-checkpoint")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for batches in (2, None):
        lines = paced.paced_lines(spark, index, progress, pace, batches)
        writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        paced.finish(writer.trigger(processingTime="0 seconds").start())
    fields = F.from_csv("line", "event_id LONG, user_id LONG, event_type STRING").alias("r")
    return spark.read.parquet(out).select(fields, F.col("batch_id").cast("long").alias("batch")).select("r.*", "batch")


def _intake_events(spark, sf_dir):
    """A task per event and, for two thirds of them, the record of its file, some of them late or failed."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("start"))
    file_name = F.format_string("socket_collect_%d.csv", "event_id")
    address = F.concat(F.lit("tcp://10.0.0."), (F.col("event_id") % 9).cast("string"), F.lit(":81/in"))
    due = intake.deadline(F.col("start"), 1 + F.col("user_id") % 90)
    tasks = events.select(F.col("event_id").alias("task_id"), file_name.alias("file_name"), address.alias("address"), "start", due.alias("deadline"))
    records = events.filter("event_id % 3 <> 0").select(
        file_name.alias("file_name"),
        (F.col("event_id") * 10).alias("file_size"),
        (F.col("event_id") % 50).alias("data_count"),
        (F.col("start") + F.make_dt_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))).alias("receive_time"),
        (F.col("event_id") % 7 != 0).alias("upload_success"),
        F.lit(None).cast("string").alias("error"),
    )
    # A task and a record a day later move both streams' time on.
    end = F.max("start") + F.make_dt_interval(days=F.lit(1))
    last = events.agg(end.alias("start"))
    closing = last.select(F.lit(-1).cast("bigint").alias("task_id"), F.lit("last").alias("file_name"), F.lit("").alias("address"), "start", F.col("start").alias("deadline"))
    closed = last.select(
        F.lit("last").alias("file_name"), F.lit(0).cast("bigint").alias("file_size"), F.lit(0).cast("bigint").alias("data_count"),
        F.col("start").alias("receive_time"), F.lit(True).alias("upload_success"), F.lit(None).cast("string").alias("error"),
    )
    return tasks.unionByName(closing), records.unionByName(closed)


@query(
    "i7_late_stream",
    """WITH tasks AS (
         SELECT event_id, least(1 + user_id % 90, 60) + 30 AS patience, event_id % 3 <> 0 AND event_id % 120 <= least(1 + user_id % 90, 60) + 30 AS seen,
                event_id % 7 <> 0 AS stored FROM events)
       SELECT event_id AS task_id, 'socket_collect_' || CAST(event_id AS VARCHAR) || '.csv' AS file_name,
              CASE WHEN seen AND stored THEN 'success' ELSE 'error' END AS status,
              CASE WHEN seen THEN event_id % 50 END AS data_count, CASE WHEN seen AND stored THEN event_id * 10 END AS file_size,
              CASE WHEN seen AND stored THEN NULL WHEN seen THEN '数据已通过 Socket 接收，但写入 HDFS 失败，请检查 HDFS 连接状态'
                   ELSE '采集超时：无法连接数据源 10.0.0.' || CAST(event_id % 9 AS VARCHAR)
                        || ':81，请确认采集服务端已启动（本机监听端口 9999）' END AS message
       FROM tasks""",
)
def i7_late_stream(spark, sf_dir):
    landed = landed_once(
        spark,
        f"{sf_dir}/intake_events",
        lambda p: [df.write.parquet(f"{p}/{name}") for df, name in zip(_intake_events(spark, sf_dir), ("tasks", "records"))],
    )
    tasks, records = (
        spark.readStream.schema(spark.read.parquet(f"{landed}/{name}").schema).parquet(f"{landed}/{name}") for name in ("tasks", "records")
    )
    out = fresh_dir(spark, "late-outcomes")
    intake.land(intake.late_outcomes(tasks, records), out, fresh_dir(spark, "late-checkpoint")).awaitTermination()
    return spark.read.parquet(out).filter("task_id >= 0").drop("start")


@query(
    "i6_stored_totals",
    """SELECT '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) AS device,
              CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY 1""",
)
def i6_stored_totals(spark, sf_dir):
    # Several batches update the sums; what they come to is read from the state store.
    rows = intake.dropped_rows(spark, several_files(spark, sf_dir), ROWS, max_files=3)
    checkpoint = fresh_dir(spark, "stored-checkpoint")
    sums = state.running_sums(rows, "device", F.col("user_id"))
    state.write_updates(sums, fresh_dir(spark, "stored-updates"), checkpoint).awaitTermination()
    return state.stored_sums(spark, checkpoint, "device")


@query(
    "f11_k10_device_files",
    """SELECT DISTINCT '10_0_' || CAST(user_id % 7 AS VARCHAR) || '_' || CAST(user_id % 200 AS VARCHAR) || '.json'
       AS file_name FROM events""",
)
def f11_k10_device_files(spark, sf_dir):
    url = F.concat(F.lit("ws://"), _device(), F.lit(":8080"))
    name = F.concat(names.dots_to_underscores(names.socket_host(url)), F.lit(".json"))
    return table(spark, sf_dir, "events").select(name.alias("file_name")).distinct()
