"""Cleaning many files at once: one look at them, one scan per charset and header."""

import os

import pytest
from conftest import plan_of, values

from forecourt.operators import dedup
from forecourt.plans import cleaning
from forecourt.sources import files as sources


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)
    return str(path)


@pytest.fixture
def paths(tmp_path):
    found = []
    for i in range(12):
        header, rows = ("a,b", f"1,x{i}\n1,x{i}\n02,销\n") if i % 2 else ("b,a", f"x{i},1\n销,02\n")
        found.append(put(f"{tmp_path}/in/f{i}.csv", f"{header}\n{rows}".encode("utf-8" if i % 4 < 2 else "gbk")))
    return found


def scans(df):
    return plan_of(df).count("FileScan csv")


def test_scans_do_not_grow_with_the_files(spark, paths):
    few = cleaning.count_file_words(spark, paths[:4], "a,b", infer=False)
    many = cleaning.count_file_words(spark, paths, "a,b", infer=False)
    assert scans(few) == scans(many) == 4  # two headers, two charsets


def test_words_of_all_files(spark, paths):
    got = {(r["field"], r["word"]): r["freq"] for r in cleaning.count_file_words(spark, paths, "a,b", infer=False).collect()}
    assert got["a", "1"] == 18 and got["a", "02"] == 12 and got["b", "销"] == 12
    assert got["b", "x1"] == 2 and got["b", "x0"] == 1


def test_each_file_is_deduplicated_by_itself(spark, paths, tmp_path):
    out = f"{tmp_path}/out"
    found = cleaning.deduplicate_files(spark, paths, "b", out, single_file=True)
    assert [p.rsplit("/", 1)[-1] for p in found] == [f"deduplicated_f{i}.csv" for i in range(12)]
    for i, path in enumerate(found):
        assert values(sources.read_text_csv(spark, path), "a", "b") == sorted([("1", f"x{i}"), ("2", "销")])
        assert len([n for n in os.listdir(path) if n.endswith(".csv")]) == 1
    assert not [d for d in os.listdir(out) if d.startswith("_")]


def test_text_files_and_folders(spark, tmp_path):
    put(f"{tmp_path}/in/x.txt", b"1,a\n1,a\n2,b\n")
    put(f"{tmp_path}/in/y.txt/part-0", b"1,a\n")
    put(f"{tmp_path}/in/y.txt/part-1", b"1,a\n1,c\n")
    given = [f"{tmp_path}/in/x.txt", f"{tmp_path}/in/y.txt"]
    x, y = cleaning.deduplicate_files(spark, given, dedup.ALL_FIELDS, f"{tmp_path}/out")
    assert values(spark.read.text(x)) == [("1,a",), ("2,b",)]
    assert values(spark.read.text(y)) == [("1,a",), ("1,c",)]
    _, z = cleaning.deduplicate_files(spark, given, "1", f"{tmp_path}/out2")
    assert values(spark.read.text(z)) == [("1,a",)]


def test_a_file_without_rows_and_a_taken_name(spark, tmp_path):
    empty = put(f"{tmp_path}/in/e.csv", b"a,b\n")
    (out,) = cleaning.deduplicate_files(spark, [empty], "a", f"{tmp_path}/out")
    assert os.path.isdir(out)
    with pytest.raises(FileExistsError):
        cleaning.deduplicate_files(spark, [empty], "a", f"{tmp_path}/out")


def test_bad_input(spark, tmp_path):
    with pytest.raises(ValueError):
        cleaning.file_groups(spark, [])
    with pytest.raises(ValueError):
        cleaning.file_groups(spark, ["x.pdf"])
    put(f"{tmp_path}/mixed.csv/part-0", b"a,b\n1,2\n")
    put(f"{tmp_path}/mixed.csv/part-1", b"b,a\n1,2\n")
    with pytest.raises(ValueError):
        cleaning.file_groups(spark, [f"{tmp_path}/mixed.csv"])


def test_a_part_file_with_only_the_header_agrees_with_any_charset(spark, tmp_path):
    # The first task of a write makes a file with the header even if it has no rows.
    for name, charset in (("gbk", "gbk"), ("western", "windows-1252")):
        put(f"{tmp_path}/{name}.csv/part-0", b"a,b\n")
        put(f"{tmp_path}/{name}.csv/part-1", ("a,b\n1,销\n1,销\n" if name == "gbk" else "a,b\n1,café\n").encode(charset))
    put(f"{tmp_path}/none.csv/part-0", b"a,b\n")
    given = [f"{tmp_path}/{name}.csv" for name in ("gbk", "western", "none")]
    assert [sources.charset_of(spark, path) for path in given] == ["GBK", "windows-1252", "UTF-8"]
    groups = cleaning.file_groups(spark, given)
    assert groups == [("csv", c, [p]) for c, p in zip(["GBK", "windows-1252", "UTF-8"], given)]
    words = {(r["field"], r["word"]): r["freq"] for r in cleaning.count_file_words(spark, given, "a,b", infer=False).collect()}
    assert words == {("a", "1"): 3, ("b", "销"): 2, ("b", "café"): 1}
    gbk, *_ = cleaning.deduplicate_files(spark, given, "a,b", f"{tmp_path}/out")
    assert values(sources.read_text_csv(spark, gbk), "a", "b") == [("1", "销")]


def test_files_with_different_charsets_stay_an_error(spark, tmp_path):
    put(f"{tmp_path}/z.csv/part-0", "a,b\n1,销\n".encode("gbk"))
    for other in ("a,b\n1,销\n".encode(), b"\xef\xbb\xbfa,b\n1,2\n"):  # a mark is no plain ASCII
        put(f"{tmp_path}/z.csv/part-1", other)
        with pytest.raises(ValueError):
            sources.charset_of(spark, f"{tmp_path}/z.csv")
        with pytest.raises(ValueError):
            cleaning.file_groups(spark, [f"{tmp_path}/z.csv"])


def test_no_job_where_charset_and_schema_are_known(spark):
    groups = cleaning.file_groups(spark, ["/nowhere/a.csv", "/nowhere/b.csv"], "GBK", "a STRING")
    assert groups == [("csv", "GBK", ["/nowhere/a.csv", "/nowhere/b.csv"])]


def test_previewed_text_can_be_put_together(spark, tmp_path):
    texts = {name: "".join(f"{name} 行 {i}\n" for i in range(500)) for name in ("a", "b")}
    for name, text in texts.items():
        put(f"{tmp_path}/z/{name}.txt", text.encode("gbk"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = sources.preview_original(spark, f"{tmp_path}/z").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        mine = sorted((r["position"], r["line"]) for r in rows if r["path"].endswith(f"/{name}.txt"))
        assert [p for p, _ in mine] == list(range(1, 501))
        assert "".join(f"{line}\n" for _, line in mine) == text


def test_part_files_are_about_as_many_as_files(spark, tmp_path):
    given = []
    for i in range(20):
        given.append(put(f"{tmp_path}/in/f{i}.csv", ("a,b\n" + "".join(f"{j},{j % 7}\n" for j in range(200))).encode()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cleaning.deduplicate_files(spark, given, "a", f"{tmp_path}/out", charset="UTF-8", schema="a INT, b INT")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [len([n for n in os.listdir(path) if n.startswith("part-")]) for path in found]
    assert parts == [1] * 20
    assert spark.read.option("header", True).csv(found).count() == 20 * 200


def test_a_taken_name_stops_all_before_anything_is_written(spark, tmp_path):
    given = [put(f"{tmp_path}/in/f{i}.csv", b"a,b\n1,2\n") for i in range(3)]
    os.makedirs(f"{tmp_path}/out/deduplicated_f2.csv")
    with pytest.raises(FileExistsError):
        cleaning.deduplicate_files(spark, given, "a", f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == ["deduplicated_f2.csv"]
    twice = [given[0], put(f"{tmp_path}/other/f0.csv", b"a,b\n1,2\n")]
    with pytest.raises(FileExistsError):
        cleaning.deduplicate_files(spark, twice, "a", f"{tmp_path}/out3")
