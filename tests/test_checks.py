"""Checks of content, sketches of keys, and sizes of files."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from vesselflow.operators.curation import curate
from vesselflow.operators.quality import (
    CountMismatch,
    distinct_sketches,
    merged_distinct,
    reconcile_content,
    require_match,
)
from vesselflow.plans import analyses as A
from vesselflow.sources.messages import read_months, write_curated

SCHEMA = "ymd string, a long, b string, c double"
ROWS = [("d1", i % 7, f"t{i % 3}", i / 4) for i in range(50)] + [("d2", None, "x", 1.0), ("d2", 1, None, 1.0), (None, 3, "y", None)]


def verdicts(left, right, **options):
    return {r.ymd: r.match for r in reconcile_content(left, right, **options).collect()}


def test_the_same_rows_in_any_order_match(spark):
    left = spark.createDataFrame(ROWS, SCHEMA)
    right = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5).select("c", "b", "a", "ymd")
    assert verdicts(left, right) == {"d1": True, "d2": True, None: True}
    require_match(reconcile_content(left, right))


@pytest.mark.parametrize(
    "change",
    [
        lambda rows: [("d1", 5, "t0", 0.0), *rows[1:]],
        lambda rows: [rows[1], *rows[1:]],
        lambda rows: rows[:-3] + [("d2", 1, "x", 1.0), ("d2", None, None, 1.0), rows[-1]],
        lambda rows: rows + [rows[0], rows[0]],
        lambda rows: rows[1:],
    ],
)
def test_a_change_is_found(spark, change):
    left, right = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(change(ROWS), SCHEMA)
    found = verdicts(left, right)
    assert sorted(found.values()) == [False, True, True]
    with pytest.raises(CountMismatch):
        require_match(reconcile_content(left, right))


def test_a_null_in_another_column_is_a_change(spark):
    left = spark.createDataFrame([("d", 1, None, 1.0)], SCHEMA).withColumn("a2", F.lit(None).cast("long"))
    right = left.select("ymd", F.col("a2").alias("a"), "b", "c", F.col("a").alias("a2"))
    assert verdicts(left, right) == {"d": False}


def test_days_of_one_side_and_types(spark):
    left, right = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(ROWS[:50], SCHEMA)
    assert verdicts(left, right) == {"d1": True, "d2": False, None: False}
    assert verdicts(left.limit(0), right.limit(0)) == {}
    with pytest.raises(ValueError, match="types: a"):
        reconcile_content(left, right.withColumn("a", F.col("a").cast("int")))
    assert verdicts(left, right.withColumn("a", F.lit(0)), columns=["b"])["d1"]
    assert "Exchange" in plan_of(reconcile_content(left, right)) and "partial_sum" in plan_of(reconcile_content(left, right))


def test_sketches_merge_over_months(spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("ym"),
        (F.col("id") % 10_000).alias("MMSI"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("BaseDateTime"),
    )
    keys = ["MMSI", "BaseDateTime"]
    sketches = distinct_sketches(rows, keys)
    exact = {r.ym: r.n for r in rows.groupBy("ym").agg(F.count_distinct(F.struct(*keys)).alias("n")).collect()}
    assert {r.ym: (r["rows"], r.distinct_keys) for r in merged_distinct(sketches, "ym").collect()} == {
        k: (10_000, n) for k, n in exact.items()
    }
    whole = merged_distinct(sketches).first()
    assert whole["rows"] == 30_000 and whole.distinct_keys == rows.select(F.struct(*keys)).distinct().count()
    rough = merged_distinct(distinct_sketches(rows, keys, log_entries=10), log_entries=10).first()
    assert rough.distinct_keys == pytest.approx(whole.distinct_keys, rel=0.15)
    assert merged_distinct(sketches.limit(0)).first()["rows"] == 0


def test_files_of_an_even_size(spark, tmp_path):
    def part(month, first, count):
        return spark.range(first, first + count, 1, 2).select(F.lit(month).alias("ym"), F.uuid().alias("text"), "id")

    table = part("2024-02", 0, 10)
    for k in range(12):
        table = table.unionByName(part("2024-01", k * 5000, 5000)).unionByName(part("2024-03", k, 1))
    out = str(tmp_path / "even")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    write_curated(table, out, file_bytes=400_000)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    sizes = {}
    for row in spark.read.parquet(out).groupBy("ym", F.input_file_name().alias("file")).count().collect():
        sizes.setdefault(str(row.ym), []).append(row["count"])
    assert sizes["2024-02"] == [10] and sizes["2024-03"] == [12]
    assert sum(sizes["2024-01"]) == 60_000 and 3 <= len(sizes["2024-01"]) <= 12
    assert max(sizes["2024-01"]) <= 3 * min(sizes["2024-01"])
    with pytest.raises(ValueError):
        write_curated(table, out, files=2, file_bytes=5)


def test_newest_positions_leave_older_months_alone(spark, messages, tmp_path):
    rows = [{"MMSI": i, "BaseDateTime": f"2024-0{m}-0{i + 1}T00:00:00"} for m in (1, 2, 3) for i in range(5)]
    base = str(tmp_path)
    write_curated(curate(messages(*rows)), base)
    months = ["2024-01", "2024-02", "2024-03"]
    table = read_months(spark, base, months)

    def same(**options):
        found = A.recent_positions_by_month(spark, base, months, **options)
        assert found.collect() == A.recent_positions(table, **options).collect()
        return {f.rsplit("ym=", 1)[1][:7] for f in found.inputFiles()}

    assert same(limit=3) == {"2024-03"} and same(limit=5) == {"2024-03"}
    assert same(limit=6) == {"2024-02", "2024-03"} and same(limit=99) == set(months)
    assert same(limit=2, end="2024-02-03") == {"2024-02"}
    assert same(limit=2, mmsi=["000000009"]) == set(months)
    assert same(limit=4, start="2024-03-04") == {"2024-03"}
    with pytest.raises(FileNotFoundError):
        A.recent_positions_by_month(spark, base, months, start="2025-01-01")
