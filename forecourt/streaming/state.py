"""Latest value per device and running totals per region."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from forecourt.commits import CommitLog
from forecourt.operators.dedup import latest_per_key
from forecourt.operators.ranking import number_rows
from forecourt.streaming.intake import triggered
from forecourt.workspace import file_system, remove


def running_sums(rows: DataFrame, key: str, value: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(value).alias(name))


def write_updates(
    changed: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the rows each batch changed under ``batch_id=<n>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = changed.writeStream.foreachBatch(save).outputMode("update")
    return triggered(writer.option("checkpointLocation", checkpoint), every).start()


def current_state(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key among the written updates."""
    return latest_per_key(updates, keys, ["batch_id"]).drop("batch_id")


def _batches(spark: SparkSession, out: str) -> dict[int, str]:
    files, folder = file_system(spark, out)
    if not files.exists(folder):
        return {}
    paths = [status.getPath() for status in files.listStatus(folder)]
    return {int(p.getName().split("=")[1]): p.toString() for p in paths if p.getName().startswith("batch_id=")}


def _pending(spark: SparkSession, out: str) -> dict | None:
    """What a fold has committed and not yet put in place."""
    _, entry = CommitLog(spark, out).latest()
    if not entry or not entry.get("folded"):
        return None
    files, folded = file_system(spark, f"{out}/{entry['folded']}")
    return entry if files.exists(folded) else None


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All rows written under ``out`` with their ``batch_id``, each once, also while batches are folded
    or after a fold that was stopped at any point."""
    entry = _pending(spark, out)
    if entry is None:
        return spark.read.parquet(out)
    folded = spark.read.parquet(f"{out}/{entry['folded']}").withColumn("batch_id", F.lit(entry["replaces"][-1]))
    rest = [path for batch, path in sorted(_batches(spark, out).items()) if batch not in set(entry["replaces"])]
    if not rest:
        return folded
    return spark.read.option("basePath", out).parquet(*rest).unionByName(folded)


def compact(spark: SparkSession, out: str, keys: Sequence[str] | None = None) -> int:
    """Fold the batches before the last into one, keeping the newest version per key.

    Without ``keys`` every row is kept (a ledger).  The last batch is left alone, since its
    stream may still repeat it.  ``read_batches`` sees the same rows before, during and after,
    also if this is stopped; the next call finishes what was left.  Of two calls at a time one
    is refused.  Returns the number of folders that went.
    """
    return sum(fold_steps(spark, out, keys))


def fold_steps(spark: SparkSession, out: str, keys: Sequence[str] | None = None) -> Iterator[int]:
    """The steps of ``compact``, each with the number of folders it took away in the end."""
    entry = _pending(spark, out)
    if entry is not None:
        yield from _placing_steps(spark, out, entry)
    found = _batches(spark, out)
    folded = sorted(found)[:-1]
    if len(folded) < 2:
        return
    log = CommitLog(spark, out)
    begun = log.latest()[0]
    # Rows from the folders themselves: none that a stream adds meanwhile is taken for folded.
    rows = spark.read.option("basePath", out).parquet(*[found[b] for b in folded])
    newest = current_state(rows, keys) if keys else rows.drop("batch_id")
    hidden = f"_folded-{uuid.uuid4().hex[:12]}"
    newest.write.parquet(f"{out}/{hidden}")
    yield 0
    entry = {"folded": hidden, "replaces": folded}
    log.commit(begun, entry)  # from here on the folded rows count and what they replace does not
    log.forget_before(begun)
    yield 0
    yield from _placing_steps(spark, out, entry)


def _placing_steps(spark: SparkSession, out: str, entry: dict) -> Iterator[int]:
    found = _batches(spark, out)
    for batch in entry["replaces"]:
        if batch in found:
            remove(spark, found[batch])
            yield 0
    files, place = file_system(spark, f"{out}/batch_id={entry['replaces'][-1]}")
    if not files.rename(file_system(spark, f"{out}/{entry['folded']}")[1], place):
        raise OSError(f"cannot rename {entry['folded']}")
    yield len(entry["replaces"]) - 1


def stored_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """What a stream's aggregate holds now: one row per key, read from its state store.

    ``key`` and ``value`` are structs as the aggregate keeps them.  Unlike the written updates
    this grows with the keys alone, however often they changed.
    """
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint).select("key", "value")


def stored_sums(spark: SparkSession, checkpoint: str, key: str, name: str = "value") -> DataFrame:
    """The sums of ``running_sums`` from the state store of the stream with this checkpoint."""
    held = stored_state(spark, checkpoint)
    return held.select(F.col("key")[key].alias(key), F.col("value.sum").alias(name))


def ranked_state(state: DataFrame, key: str, value: str) -> DataFrame:
    """Keys by descending value, ties by key, with 1-based ranks."""
    return number_rows(state, [F.col(value).desc(), F.col(key)], "rank")
