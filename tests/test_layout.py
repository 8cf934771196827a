"""Boxes over a table clustered by place: the same rows, fewer of them read."""

import random

import pytest
from pyspark.sql import functions as F

from vesselflow.functions import geo
from vesselflow.functions.predicates import in_bbox
from vesselflow.sources import layout
from vesselflow.sources.layout import covering, in_clustered_box, write_clustered

BOXES = [
    (30.0, 45.0, -110.0, -80.0),
    (-90.0, 90.0, -180.0, 180.0),
    (10.0, 10.0, 20.0, 20.0),
    (0.0, 0.001, 0.0, 0.001),
    (None, 35.5, None, None),
    (45.0, None, -100.0, None),
    (89.0, 95.0, 179.0, 200.0),
    (-45.0, 45.0, -90.0, 90.0),
]


@pytest.fixture(scope="module")
def places(spark):
    random.seed(4)
    points = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(4000)]
    points += [(random.uniform(29, 46), random.uniform(-112, -79)) for _ in range(4000)]
    points += [(a, b) for a in (-90.0, -45.0, 0.0, 10.0, 30.0, 45.0, 90.0) for b in (-180.0, -110.0, -80.0, 0.0, 20.0, 180.0)]
    points += [(None, 5.0), (5.0, None), (None, None)]
    rows = [(i, f"2024-0{i % 2 + 1}", lat, lon) for i, (lat, lon) in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, ym string, LAT double, LON double")
    return df.withColumn("geohash9", geo.geohash_encode("LAT", "LON"))


@pytest.fixture(scope="module")
def clustered(spark, places, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("clustered"))
    write_clustered(places, out, files=16)
    return spark.read.parquet(out)


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("ranges", [1, 2, 7, 32])
def test_same_rows_as_the_plain_box(places, clustered, box, ranges):
    plain = {r.id for r in places.where(in_bbox(*box)).select("id").collect()}
    found = [r.id for r in clustered.where(in_clustered_box(*box, ranges=ranges)).select("id").collect()]
    assert len(found) == len(plain) and set(found) == plain


@pytest.mark.parametrize("box", BOXES)
def test_ranges_are_few_sorted_and_apart(box):
    for ranges in (1, 2, 5, 32, 100):
        found = covering(box, ranges)
        assert 1 <= len(found) <= ranges
        assert all(a <= b for a, b in found) and all(a[1] < b[0] for a, b in zip(found, found[1:]))


def test_more_ranges_fit_closer(spark, places):
    box = (30.1, 44.9, -109.3, -80.7)

    def rows(ranges):
        place = F.col("geohash9")
        near = F.lit(False)
        for low, high in covering(box, ranges):
            near = near | place.between(low, high)
        return places.where(near).count()

    inside = places.where(in_bbox(*box)).count()
    assert inside <= rows(64) <= rows(4) <= rows(1)
    assert rows(64) < 1.3 * inside


def test_no_bound_keeps_all_rows_and_an_empty_box_none(clustered, places):
    assert clustered.where(in_clustered_box()).count() == places.count()
    assert clustered.where(in_clustered_box(5.0, 4.0, 1.0, 2.0)).count() == 0
    assert covering((5.0, 4.0, 1.0, 2.0)) == []
    with pytest.raises(ValueError):
        covering((1.0, 2.0, 3.0, 4.0), 0)


def rows_read(df):
    """Rows that the scan of a plan gave out, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_row_groups_are_skipped(spark, messages, tmp_path):
    import pyarrow.dataset as ds

    wide = spark.range(200_000).select(
        F.lit("2024-01").alias("ym"),
        (F.rand(1) * 180 - 90).alias("LAT"),
        (F.rand(2) * 360 - 180).alias("LON"),
        F.col("id"),
    )
    wide = wide.withColumn("geohash9", geo.geohash_encode("LAT", "LON"))
    out = str(tmp_path / "clustered")
    write_clustered(wide, out, files=4, row_group_bytes=1 << 18)
    table = spark.read.parquet(out)
    fragments = list(ds.dataset(out, format="parquet", exclude_invalid_files=True).get_fragments())
    groups = [g for f in fragments for g in f.row_groups]
    box = (30.0, 40.0, -110.0, -90.0)
    place = ds.field("geohash9")
    wanted = None
    for low, high in covering(box):
        part = (place >= low) & (place <= high)
        wanted = part if wanted is None else wanted | part
    met = [g for f in fragments for s in [f.subset(wanted)] for g in s.row_groups]
    assert len(groups) > 12 and len(met) < len(groups) / 3
    near = table.where(in_clustered_box(*box)).select("id", "LAT", "LON", "geohash9")
    plain = table.where(in_bbox(*box)).select(*near.columns)
    # The layout helps the plain box, too; in the order of the messages it reads all rows.
    assert near.count() == plain.count() and rows_read(near) < 0.7 * rows_read(plain) < 0.2 * 200_000
    wide.write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "unordered"))
    unordered = spark.read.parquet(str(tmp_path / "unordered")).where(in_bbox(*box)).select(*near.columns)
    assert rows_read(unordered) > 0.9 * 200_000


def test_a_crowded_place_fills_several_files(spark, messages, tmp_path):
    crowd = spark.range(5000).select(
        F.lit("2024-01").alias("ym"),
        F.lit(10.0).alias("LAT"),
        F.lit(20.0).alias("LON"),
        F.col("id").cast("string").alias("MMSI"),
        F.current_timestamp().alias("BaseDateTime"),
    )
    write_clustered(crowd.withColumn("geohash9", geo.geohash_encode("LAT", "LON")), str(tmp_path), files=8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path)).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2000


def test_geohash_texts_are_in_order():
    assert sorted(layout.GEOHASH_ALPHABET) == list(layout.GEOHASH_ALPHABET)
