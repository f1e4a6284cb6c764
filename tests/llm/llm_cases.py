"""Rows that every operator on documents must take, and small tables to compare with."""

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
CLASHING = ["_doc", "_hash", "_gone", "_cuts", "fp", "n_words", "kept", "host", "line", "window", "bundle", "row"]


def table(name, sf_dir=SF_DIR):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def odd_documents():
    """(doc_id, text, source): nulls, blanks, ties, repeated rows, copies and a long text."""
    plain = "one two three four five six seven eight nine ten eleven twelve thirteen " * 3
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, plain + "end", "a"),
        (2, plain + "end", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \n\t ", "b"),
        (5, " \n\t ", "b"),
        (None, plain + "other end", "a"),
        (None, None, "c"),
        (6, long, "c"),
        (7, "Éai les, ou <|endoftext|> straße ΣΑΣ İ 日本語 \x1c x", "c"),
        (7, "the same number with another text", "c"),
        (8, "short", None),
    ]


def frame(spark, rows, clash=True):
    docs = spark.createDataFrame(
        [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    if clash:
        for i, name in enumerate(CLASHING):
            from pyspark.sql import functions as F

            docs = docs.withColumn(name, F.lit(i))
    return docs
