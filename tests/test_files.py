"""Files in and out: charsets, previews, sinks, replaceable tables, whole tasks."""

import os

import pytest
from conftest import values
from pyspark.sql import DataFrameReader, DataFrameWriter, functions as F

from forecourt.operators import dedup
from forecourt.plans import cleaning, statistics_import
from forecourt.sinks import files as sinks
from forecourt.sinks import tables
from forecourt.sources import files as sources
from forecourt.sources.catalog import file_catalog
from forecourt.sources.tables import jdbc_scan, point_lookup, table_scan


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_charsets_of_whole_files(spark, tmp_path):
    long_ascii = b"plain line\n" * 20_000
    cases = {
        "utf8": ("销量\n" * 3).encode("utf-8"),
        "gbk": ("销量,abc\n" * 3).encode("gbk"),
        "ascii": b"abc\r\n\tdef\n",
        "late_gbk": long_ascii + "销量".encode("gbk"),
        "late_western": long_ascii + "café\n".encode("windows-1252"),
        "bom": b"\xef\xbb\xbf" + "销量\n".encode("utf-8"),
        "bom_then_bad": b"\xef\xbb\xbfab\n\xff\xff\n",
        "bom_open_end": b"\xef\xbb\xbf\xb1\xb1",
        "control": b"a\x00b\n",
        "nothing_fits": b"\x81\xff\x81\n",
    }
    for case, data in cases.items():
        put(f"{tmp_path}/{case}.txt", data)
    found = sources.detect_charsets(spark, str(tmp_path))
    got = dict(values(found.select(F.regexp_extract("path", "([^/.]+)[.]txt$", 1), "charset")))
    assert got == {
        "utf8": "UTF-8", "gbk": "GBK", "ascii": "UTF-8", "late_gbk": "GBK", "late_western": "windows-1252",
        "bom": "UTF-8", "bom_then_bad": "UTF-8", "bom_open_end": "UTF-8", "control": "UTF-8", "nothing_fits": "UTF-8",
    }
    with pytest.raises(ValueError):
        sources.charset_of(spark, str(tmp_path))


def test_detection_splits_files_over_tasks(spark, tmp_path):
    put(f"{tmp_path}/big.txt", ("销量 line\n" * 50_000).encode("gbk"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = sources._raw_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        assert sources.charset_of(spark, f"{tmp_path}/big.txt") == "GBK"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_detection_leaves_the_session_settings_alone(spark, tmp_path):
    put(f"{tmp_path}/a.txt", "x")
    before = spark.conf.get("spark.sql.legacy.codingErrorAction")
    sources.detect_charsets(spark, str(tmp_path)).collect()
    assert spark.conf.get("spark.sql.legacy.codingErrorAction") == before


def test_gbk_csv_and_previews(spark, tmp_path):
    path = put(f"{tmp_path}/z/a.csv", "名,数\r\n北京,1\r\n".encode("gbk"))
    df = sources.read_csv(spark, path, charset=sources.charset_of(spark, path))
    assert df.columns == ["名", "数"] and values(df) == [("北京", "1")]
    assert values(sources.preview_original(spark, path).select("line")) == [("北京,1",), ("名,数",)]
    broken = sources.preview_processed(spark, path).select("line").collect()
    assert any("�" in r["line"] for r in broken)


def test_readers_by_extension(spark, tmp_path):
    csv = put(f"{tmp_path}/a.CSV", "x,y\n1,2\n")
    txt = put(f"{tmp_path}/b.Txt", "1,2,,\n3,4,5,6\n")
    other = put(f"{tmp_path}/c.json", "{}")
    empty = put(f"{tmp_path}/d.txt", "")
    assert sources.read_by_extension(spark, csv).columns == ["x", "y"]
    assert sources.read_by_extension(spark, txt).columns == ["value"]
    for bad in (other, str(tmp_path / "noext")):
        with pytest.raises(ValueError):
            sources.read_by_extension(spark, bad)
    assert sources.preview_fields(spark, csv) == ["x", "y"]
    assert sources.preview_fields(spark, txt) == ["1", "2"]
    assert sources.preview_fields(spark, other) == []
    assert sources.preview_fields(spark, empty) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_lines(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        sources.read_text_csv(spark, put(f"{tmp_path}/e.csv", ""))


def test_catalog_lists_files_only(spark, tmp_path):
    put(f"{tmp_path}/z1/a.b.csv", "12345")
    put(f"{tmp_path}/z1/sub/hidden.txt", "1")
    put(f"{tmp_path}/z2/noext", "1")
    catalog = file_catalog(spark, f"{tmp_path}/z1/, {tmp_path}/z2")
    assert values(catalog, "name", "display_name", "type", "size") == [
        ("a.b.csv", "a.b", "CSV", 5), ("noext", "noext", "", 1),
    ]
    assert "content" not in catalog._jdf.queryExecution().executedPlan().toString()


def test_csv_sink_keeps_microseconds_and_quotes(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, TIMESTAMP_NTZ'2024-01-01 00:00:00.123456' AS t, 'a,\"b\"' AS s")
    sinks.write_csv(df, f"{tmp_path}/o", single_file=True)
    back = sources.read_csv(spark, f"{tmp_path}/o", schema="i INT, t TIMESTAMP_NTZ, s STRING")
    assert values(back) == values(df)
    assert len([f for f in os.listdir(f"{tmp_path}/o") if f.endswith(".csv")]) == 1


def test_line_sink_joins_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "x STRING, y INT")
    sinks.write_lines(df, f"{tmp_path}/o")
    assert values(sources.read_lines(spark, f"{tmp_path}/o")) == [("a,1",), ("b",)]


def test_word_frequency_sink_survives_odd_words(spark, tmp_path):
    freq = spark.createDataFrame([("f", 'a,"b\\', 2), ("f", "c", 1)], "field STRING, word STRING, freq LONG")
    sinks.write_word_frequency(freq, f"{tmp_path}/o")
    back = spark.read.options(header=True, escape='"').csv(f"{tmp_path}/o")
    assert back.columns == sinks.WORD_FREQUENCY_HEADER
    assert values(back) == [("f", 'a,"b\\', "2"), ("f", "c", "1")]


def test_replace_snapshot_restore(spark, name):
    def table(rows):
        return spark.createDataFrame(rows, "brand_name STRING, sales LONG")

    backup = f"{name}_backup"
    with pytest.raises(LookupError):
        tables.restore(spark, name, backup, ["brand_name", "sales"])
    assert tables.snapshot_once(spark, name, backup) is False
    tables.replace_table(table([("a", 1)]), name)
    assert tables.snapshot_once(spark, name, backup) is True
    tables.replace_table(table([("b", 2), ("c", 3)]), name)
    assert tables.snapshot_once(spark, name, backup) is False
    assert values(table_scan(spark, name)) == [("b", 2), ("c", 3)]
    tables.replace_table(spark.table(name).filter("sales > 2"), name)  # reads what it replaces
    assert values(spark.table(name)) == [("c", 3)]
    tables.restore(spark, name, backup, ["brand_name", "sales"])
    assert values(spark.table(name)) == [("a", 1)]


def test_failed_replace_keeps_the_old_rows(spark, name):
    tables.replace_table(spark.range(3), name)
    with pytest.raises(Exception):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), name)
    assert spark.table(name).count() == 3


def test_database_options(spark, monkeypatch):
    """No database is started here: only what is handed to Spark's writer and reader."""
    seen = []
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, url, table, mode: seen.append((url, table, mode)))
    options = []
    original = DataFrameWriter.option
    monkeypatch.setattr(
        DataFrameWriter, "option", lambda self, k, v: (options.append((k, v)), original(self, k, v))[1]
    )
    tables.append_jdbc(spark.range(1), "jdbc:x", "t")
    tables.replace_jdbc(spark.range(1), "jdbc:x", "t", batch=7)
    assert seen == [("jdbc:x", "t", "append"), ("jdbc:x", "t", "overwrite")]
    assert options == [("batchsize", 1000), ("truncate", True), ("batchsize", 7)]
    asked = {}
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, **k: asked.update(k))
    jdbc_scan(spark, "jdbc:x", "t", "id", 1, 100, 8)
    assert asked == {"column": "id", "lowerBound": 1, "upperBound": 100, "numPartitions": 8}


def test_point_lookup(spark):
    df = spark.range(10)
    assert values(point_lookup(df, "id", 1)) == [(1,)]
    assert values(point_lookup(df, "id", 99)) == []


def test_statistics_import_and_restore(spark, name, tmp_path):
    rows = ["id,brand", *[f"{i},{' ' if i % 2 else 'b' + str(i % 6)}" for i in range(30)]]
    path = put(f"{tmp_path}/d.csv", "\n".join(rows) + "\n")
    backup = f"{name}_backup"
    tables.replace_table(spark.createDataFrame([(1, "old", 5)], "id LONG, brand_name STRING, sales LONG"), name)
    items = statistics_import.import_statistics(spark, path, "nope", 3, name, backup)
    assert values(items) == [("b0", 5, 30, "brand", True), ("b2", 5, 30, "brand", True)]
    assert values(spark.table(name)) == [(1, "b0", 5), (2, "b2", 5)]
    statistics_import.restore_statistics(spark, name, backup)
    assert values(spark.table(name)) == [(1, "old", 5)]
    blank = put(f"{tmp_path}/blank.csv", "id,brand\n1,\n2, \n")
    with pytest.raises(ValueError):
        statistics_import.import_statistics(spark, blank, "brand", 3, name, backup)
    assert values(spark.table(name)) == [(1, "old", 5)]
    with pytest.raises(ValueError):
        statistics_import.import_statistics(spark, " ")


def test_deduplicate_files(spark, tmp_path):
    csv = put(f"{tmp_path}/in/a.csv", "k,v\n1,x\n1,x\n1,y\n2,z\n".encode("gbk"))
    txt = put(f"{tmp_path}/in/b.txt", "1,x\n1,y\n2,x\n1,x\n")
    out = f"{tmp_path}/out"
    written = cleaning.deduplicate_files(spark, [csv], "k", out)
    assert written == [f"{out}/deduplicated_a.csv"]
    assert values(sources.read_csv(spark, written[0])) == [("1", "x"), ("2", "z")]
    written = cleaning.deduplicate_files(spark, [txt], "1", out)
    assert values(sources.read_lines(spark, written[0])) == [("1,x",), ("2,x",)]
    with pytest.raises(ValueError):
        cleaning.deduplicate_files(spark, [], "k", out)


def test_values_are_cleaned_by_type(spark, tmp_path):
    path = put(f"{tmp_path}/in/t.csv", "k,v\n1.50,a\n1.5,a\n02,b\n")
    typed = cleaning.deduplicate_file(spark, path, dedup.ALL_FIELDS, f"{tmp_path}/typed")
    assert values(sources.read_csv(spark, typed)) == [("1.5", "a"), ("2.0", "b")]
    texts = cleaning.deduplicate_file(spark, path, dedup.ALL_FIELDS, f"{tmp_path}/texts", infer=False)
    assert values(sources.read_csv(spark, texts)) == [("02", "b"), ("1.5", "a"), ("1.50", "a")]
    given = cleaning.deduplicate_file(spark, path, "v", f"{tmp_path}/given", charset="UTF-8", schema="k DOUBLE, v STRING")
    assert values(sources.read_csv(spark, given)) == [("1.5", "a"), ("2.0", "b")]
    assert values(cleaning.count_file_words(spark, [path], "k")) == [("k", "1.5", 2), ("k", "2.0", 1)]


def test_words_of_all_files(spark, tmp_path):
    one = put(f"{tmp_path}/a.csv", "s,t\nx y,1\n")
    two = put(f"{tmp_path}/b.csv", "t,s\n1,y\n")
    freq = cleaning.count_file_words(spark, [one, two], "s,t")
    assert values(freq) == [("s", "x", 1), ("s", "y", 2), ("t", "1", 2)]
    txt = put(f"{tmp_path}/c.txt", "p q,r\ns\n")
    assert values(cleaning.count_file_words(spark, [txt], "2, 1")) == [
        (" 1", "p", 1), (" 1", "q", 1), (" 1", "s", 1), ("2", "r", 1),
    ]


def test_zone_jobs(spark, tmp_path):
    put(f"{tmp_path}/z/a.csv", "h\nx y\n")
    put(f"{tmp_path}/z/b.txt", "x y\n\n")
    assert values(cleaning.zone_job(spark, f"{tmp_path}/z", "dedup")) == [("",), ("h",), ("x y",)]
    assert values(cleaning.zone_job(spark, f"{tmp_path}/z", "other")) == [("h", 1), ("x", 2), ("y", 2)]
