"""The log source: splits at every place, malformed lines, filters in the scan, a stream that resumes."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import StructType

from quarry.sources import logs

SCHEMA = "id long, ts timestamp_ntz, kind string, value double"
START = datetime(2024, 1, 1)


def line(k):
    return f"{k}\t{START + timedelta(minutes=k)}\t{('view', 'née', NULL)[k % 3]}\t{k / 4 if k % 5 else NULL}\n"


NULL = logs.NULL


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "logs"
    at.mkdir()
    (at / "a.log").write_text("".join(map(line, range(100))), encoding="utf-8")
    (at / "b.log").write_text("".join(map(line, range(100, 130))).rstrip("\n"), encoding="utf-8")  # no end of line at its end
    (at / "c.log").write_text("")
    (at / "_SUCCESS").write_text("x")
    return at


def read(spark, folder, **options):
    logs.register(spark)
    return spark.read.format(logs.NAME).schema(SCHEMA).options(**options).load(str(folder))


@pytest.mark.parametrize("split", [1, 7, 40, 41, 1000, 1 << 20])
def test_each_line_is_in_one_split(spark, folder, split):
    reader = logs.LogReader(StructType.fromDDL(SCHEMA), {"path": str(folder), "split": str(split)})
    got = [i for s in reader.partitions() for b in reader.rows(s) for i in b.column(0).to_pylist()]
    assert sorted(got) == list(range(130))
    if split < 1000:
        return  # as many tasks as bytes are too many for Spark here
    df = read(spark, folder, split=split)
    rows = sorted(df.collect())
    assert [r["id"] for r in rows] == list(range(130))
    assert rows[3]["ts"] == START + timedelta(minutes=3) and rows[1]["kind"] == "née" and rows[2]["kind"] is None and rows[5]["value"] is None and rows[6]["value"] == 1.5
    if split == 1000:
        assert df.rdd.getNumPartitions() > 4


def test_filters_are_in_the_scan(spark, folder):
    df = read(spark, folder, split=500)
    tests = ["id = 7", "id > 120", "id >= 5 AND id < 9", "kind = 'view' AND value <= 3", "kind IS NULL", "kind IS NOT NULL AND id IN (1, 2, 3, 500)", "kind <=> NULL", "ts >= TIMESTAMP_NTZ '2024-01-01 02:00:00'", "id % 2 = 0 AND id < 10", "value = 2.5 OR id = 3"]
    every = spark.createDataFrame(df.collect(), df.schema)
    for test in tests:
        assert sorted(r["id"] for r in df.where(test).collect()) == sorted(r["id"] for r in every.where(test).collect()), test
    taken = df.where("id = 7 AND kind = 'née'")
    plan = spark._jvm.PythonSQLUtils.explainString(taken._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "EqualTo(id,7)" in plan.replace(", ", ",")
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")  # none is left for Spark


def test_malformed_lines(spark, tmp_path):
    at = tmp_path / "odd.log"
    at.write_bytes(b"1\t2024-01-01 00:00:00\ta\t1.0\nx\t2024-01-01 00:00:00\tb\t1\n2\tno time\tc\t1\n3\n\n4\t2024-01-01 00:00:00\td\t\\N\r\n5\t2024-01-01 00:00:00\te\t1\textra\n\xff\t\t\t\n")
    assert sorted(r["id"] for r in read(spark, at).collect()) == [1, 4]
    logs.register(spark)
    df = spark.read.format(logs.NAME).schema(SCHEMA + ", line string").option("corrupt", "line").load(str(at))
    got = {r["line"]: r["id"] for r in df.collect()}
    assert len(got) == 7 and got["3"] is None and got["x\t2024-01-01 00:00:00\tb\t1"] is None and got[None] in (1, 4)
    with pytest.raises(Exception, match="nothing"):
        read(spark, tmp_path / "nothing").collect()


def test_a_stream_resumes_and_waits_for_whole_lines(spark, folder, tmp_path):
    logs.register(spark)

    def run():
        df = spark.readStream.format(logs.NAME).schema(SCHEMA).option("split", 700).load(str(folder))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(129))  # the last line of b.log isn't whole
    with (folder / "b.log").open("a", encoding="utf-8") as f:
        f.write("\n" + line(130))
    (folder / "d.log").write_text(line(131), encoding="utf-8")
    assert run() == list(range(132))
    assert run() == list(range(132))  # nothing new
