"""Commits of tables and folds: two writers, writers that stop half way, folders copied in part."""

import itertools
import os
import threading

import pytest
from conftest import values

from forecourt import workspace
from forecourt.commits import CommitConflict, CommitLog
from forecourt.sinks import tables
from forecourt.streaming import intake, state


@pytest.fixture
def table_root(spark, tmp_path):
    spark.conf.set("spark.forecourt.tables.dir", str(tmp_path / "tables"))
    yield tmp_path / "tables"
    spark.conf.unset("spark.forecourt.tables.dir")


def test_entries_are_written_once(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    assert log.latest() == (0, None)
    assert log.commit(0, {"a": 1}) == 1
    with pytest.raises(CommitConflict):
        other.commit(0, {"b": 1})
    assert other.commit(1, ["é"]) == 2 and log.latest() == (2, ["é"])
    log.forget_before(2)
    assert log.entries() == [(2, ["é"])]


def test_an_entry_cut_short_does_not_count(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    log.commit(0, "whole")
    (tmp_path / "_log" / "000000000002").write_text('"half"')
    assert log.latest() == (1, "whole")
    assert log.commit(1, "next") == 3 and log.latest() == (3, "next")


def test_writers_at_the_same_moment(spark, tmp_path):
    won, lost = [], []

    def write(i):
        try:
            won.append(CommitLog(spark, str(tmp_path)).commit(0, i))
        except CommitConflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert (len(won), len(lost)) == (1, 7)


def test_the_second_of_two_writers_is_refused(spark, table_root, name):
    tables.replace_table(spark.range(3), name)
    begun = tables.table_version(spark, name)
    tables.replace_table(spark.range(4), name, expected=begun)
    with pytest.raises(CommitConflict):
        tables.replace_table(spark.range(5), name, expected=begun)
    assert tables.open_table(spark, name).count() == 4
    assert len([d for d in os.listdir(table_root / name) if d.startswith("v")]) == 2  # its folder is gone


def test_a_folder_copied_in_part_is_not_seen(spark, table_root, name):
    tables.replace_table(spark.range(3), name)
    half = table_root / name / "v000000000099-half"
    spark.range(9).write.parquet(str(half))
    assert tables.open_table(spark, name).count() == 3
    assert tables.replace_table(spark.range(2), name) == 2
    assert tables.open_table(spark, name).count() == 2


def batches(spark, out, n):
    for batch in range(n):
        rows = [(f"f{batch}-{i}", f"/x/f{batch}-{i}", 10, batch) for i in range(3)]
        df = spark.createDataFrame(rows, "file_name string, file_path string, file_size long, receive_time long")
        df.write.parquet(f"{out}/batch_id={batch}")


def totals(spark, out):
    return tuple(intake.intake_totals(state.read_batches(spark, out)).first())


def test_totals_are_the_same_wherever_a_fold_stops(spark, tmp_path):
    for stop in itertools.count():
        out = str(tmp_path / f"ledger{stop}")
        batches(spark, out, 4)
        before = totals(spark, out)
        steps = list(itertools.islice(state.fold_steps(spark, out), stop))
        assert totals(spark, out) == before
        # A batch arrives, and the next call finishes what was left.
        spark.read.parquet(f"{out}/batch_id=3").write.parquet(f"{out}/batch_id=4")
        after = totals(spark, out)
        assert after[:2] == (before[0] + 3, before[1] + 30)
        state.compact(spark, out)
        assert totals(spark, out) == after
        assert tuple(intake.intake_totals(spark.read.parquet(out)).first()) == after  # nothing is left hidden
        if len(steps) < stop:
            break
    assert stop > 5


def test_two_folds_at_a_time(spark, tmp_path):
    out = str(tmp_path / "ledger")
    batches(spark, out, 4)
    before = totals(spark, out)
    first, second = state.fold_steps(spark, out), state.fold_steps(spark, out)
    next(first)
    next(second)
    next(first)
    with pytest.raises(CommitConflict):
        next(second)
    list(first)
    assert totals(spark, out) == before


def test_states_folded_by_key(spark, tmp_path):
    out = str(tmp_path / "states")
    for batch in range(5):
        spark.createDataFrame([("a", batch), (f"k{batch}", batch)], "k string, v long").write.parquet(f"{out}/batch_id={batch}")
    before = values(state.current_state(state.read_batches(spark, out), ["k"]))
    steps = state.fold_steps(spark, out, ["k"])
    next(steps), next(steps), next(steps)
    assert values(state.current_state(state.read_batches(spark, out), ["k"])) == before


def test_scratch_leaves_what_another_thread_stores(spark):
    found, begun, done = [], threading.Event(), threading.Event()

    def other():
        begun.wait()
        found.append(workspace.stored(spark.range(7), "other"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with workspace.scratch(spark):
        begun.set()
        done.wait()
        mine = workspace.stored(spark.range(5), "mine")
        assert mine.count() == 5
    thread.join()
    assert found[0].count() == 7
    with pytest.raises(Exception):
        mine.count()
