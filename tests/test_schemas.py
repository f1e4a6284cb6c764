"""Declared schemas read the files they describe."""

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forecourt import schemas
from forecourt.sources import files as sources
from forecourt.streaming import intake


@pytest.mark.parametrize("name", [n for n in dir(schemas) if n.isupper()])
def test_schema_parses(spark, name):
    assert StructType.fromDDL(getattr(schemas, name)).fields


# Headers of the exchanged files.
HEADER = "ID,Brand,Model,Year,Horsepower,Torque,FuelType,Length(mm),Width(mm),Height(mm)"


def test_telemetry_lands_with_its_types(spark, tmp_path):
    zone, out, checkpoint = (str(tmp_path / d) for d in ("zone", "out", "cp"))
    (tmp_path / "zone").mkdir()
    (tmp_path / "zone" / "a.csv").write_text(f"{HEADER}\n7f-1,Audi,A4,2020,150,320,Diesel,4700,1800,1400\n2,BMW,X5,x,,1,E,1,2,3\n")
    intake.land(intake.dropped_rows(spark, zone, schemas.TELEMETRY), out, checkpoint).awaitTermination()
    landed = spark.read.parquet(out)
    assert values(landed, "ID", "Year", "Length(mm)", "source_file") == [("2", None, 1, "a.csv"), ("7f-1", 2020, 4700, "a.csv")]


def test_profiles_with_and_without_header(spark, tmp_path):
    header = ",".join(f.name for f in StructType.fromDDL(schemas.USER_PROFILE).fields)
    row = "张三,30,男,工程师,高,已婚,北京,新,138,a@b.c"
    (tmp_path / "p.csv").write_text(f"{header}\n{row}\n", encoding="utf-8")
    (tmp_path / "p.txt").write_text(f"{row}\n李四,20\n", encoding="utf-8")
    csv = sources.read_csv(spark, f"{tmp_path}/p.csv", schema=schemas.USER_PROFILE)
    assert values(csv, "姓名", "年龄", "城市") == [("张三", 30, "北京")]
    lines = sources.read_lines(spark, f"{tmp_path}/p.txt")
    assert values(sources.positional(lines, [1, 2, 7])) == [("张三", "30", "北京"), ("李四", "20", None)]


def test_union_of_files_adds_up(spark, tmp_path):
    paths = []
    for name, text in (("a", "x\ny\n"), ("b", "y\n")):
        (tmp_path / name).write_text(text)
        paths.append(f"{tmp_path}/{name}")
    both = sources.read_lines(spark, sources.path_list(", ".join(paths)))
    assert values(both.groupBy("value").agg(F.count("*"))) == [("x", 1), ("y", 2)]
