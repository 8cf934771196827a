"""Statistics of stretches of time, added up, against one fit over all of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vesselflow.operators.curation import curate
from vesselflow.plans import anomaly as N
from vesselflow.plans.mergeable import coefficients, merge, statistics, update_anomaly

SCHEMA = "series_id string, ts_col timestamp, value double"
START = dt.datetime(2024, 1, 1)


def points(seed=1, units=400, step="hours", gaps=0.2, level=5.0):
    random.seed(seed)
    rows = []
    for name in ("a", "b", None):
        noise = 0.0
        for i in range(units):
            noise = 0.6 * noise + random.gauss(0, 1)
            if random.random() < gaps:
                continue
            value = None if random.random() < 0.05 else level + i % 24 + noise
            rows.append((name, START + dt.timedelta(**{step: i}), value))
    rows += [("once", START, 3.0), ("twice", START, 1.0), ("twice", START + dt.timedelta(**{step: 1}), 2.0)]
    rows += [("late", START + dt.timedelta(**{step: units - 2}), 4.0), ("empty", START, None)]
    rows += [("flat", START + dt.timedelta(**{step: i}), 7.1) for i in range(60)]
    return rows


def check(spark, rows, freq, cuts, step="hours", **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    ends = [START, *[START + dt.timedelta(**{step: c}) for c in cuts], dt.datetime(2100, 1, 1)]
    parts = [
        statistics(frame.where((F.col("ts_col") >= a) & (F.col("ts_col") < b)), freq) for a, b in zip(ends, ends[1:])
    ]
    merged = parts[0] if len(parts) == 1 else merge(*reversed(parts), freq=freq)
    ours = {r.series_id: r for r in coefficients(merged, freq, **options).collect()}
    theirs = {r.series_id: r for r in N.fit(frame, freq, **options).collect()}
    assert list(ours) and set(ours) == set(theirs)
    for name, other in theirs.items():
        own = ours[name]
        assert own.n == other.n and own.last_ts == other.last_ts and own.horizon == other.horizon
        assert own.slot_means == pytest.approx(other.slot_means)
        for column in ("series_mean", "last_residual"):
            assert own[column] == pytest.approx(other[column], rel=1e-12, abs=1e-9), (name, column)
        if name == "flat":
            assert own.phi == 0 and own.sigma == pytest.approx(0, abs=1e-9)
        else:
            assert own.phi == pytest.approx(other.phi, abs=1e-7), name
            assert own.sigma == pytest.approx(other.sigma, abs=1e-7), name


@pytest.mark.parametrize("cuts", [[], [200], [50, 51, 52, 300], [399]])
def test_hours(spark, cuts):
    check(spark, points(), "HOURLY", cuts)


def test_days(spark):
    check(spark, points(2, 120, "days", 0.1), "DAILY", [31, 60], "days", min_slot=3, min_points=2, horizon=5)


def test_values_far_from_zero_keep_their_spread(spark):
    check(spark, points(3, 200, level=1e7), "HOURLY", [77, 140])


def test_merging_one_by_one_equals_merging_at_once(spark):
    frame = spark.createDataFrame(points(), SCHEMA)
    ends = [START + dt.timedelta(hours=h) for h in (0, 100, 200, 500)]
    a, b, c = (statistics(frame.where(F.col("ts_col").between(x, y - dt.timedelta(seconds=1))), "HOURLY") for x, y in zip(ends, ends[1:]))
    steps = coefficients(merge(merge(a, b, freq="HOURLY"), c, freq="HOURLY"), "HOURLY")
    once = coefficients(merge(c, a, b, freq="HOURLY"), "HOURLY")
    left, right = ({r.series_id: r for r in x.collect()} for x in (steps, once))
    assert all(left[k].sigma == pytest.approx(right[k].sigma) and left[k].phi == pytest.approx(right[k].phi) for k in left)


def test_a_pair_across_the_border_counts(spark):
    frame = spark.createDataFrame([("x", START + dt.timedelta(hours=h), float(h * h)) for h in range(4)], SCHEMA)
    border = START + dt.timedelta(hours=2)
    a, b = statistics(frame.where(F.col("ts_col") < border), "HOURLY"), statistics(frame.where(F.col("ts_col") >= border), "HOURLY")
    merged = merge(a, b, freq="HOURLY")
    assert a.agg(F.sum("pairs")).first()[0] + b.agg(F.sum("pairs")).first()[0] == 2
    assert merged.agg(F.sum("pairs")).first()[0] == 3


def test_overlapping_stretches_are_an_error(spark):
    frame = statistics(spark.createDataFrame([("x", START, 1.0), ("x", START + dt.timedelta(hours=1), 2.0)], SCHEMA), "HOURLY")
    other = statistics(spark.createDataFrame([("x", START + dt.timedelta(hours=1), 1.0)], SCHEMA), "HOURLY")
    with pytest.raises(Exception, match="overlap"):
        merge(frame, other, freq="HOURLY").collect()


def test_no_points(spark):
    none = statistics(spark.createDataFrame([], SCHEMA), "HOURLY")
    assert coefficients(merge(none, none, freq="HOURLY"), "HOURLY").collect() == []


def test_a_stored_model_takes_a_new_month(spark, messages, tmp_path):
    random.seed(6)
    rows = [
        {"MMSI": 366000001 + i % 3, "BaseDateTime": f"2024-{m}-{d:02d}T{random.randrange(24):02d}:{i % 60:02d}:00", "SOG": float(i % 20)}
        for m in ("01", "02")
        for d in range(1, 29)
        for i in range(random.randrange(1, 9))
    ]
    table = curate(messages(*rows))
    base = str(tmp_path)
    for metric, freq in (("count", "DAILY"), ("speed", "HOURLY")):
        settings = {"metric": metric, "freq": freq, "id_col": "MMSI"}
        update_anomaly(spark, base, table, "2024-01-01", "2024-01-31", **settings)
        made = update_anomaly(spark, base, table, "2024-02-01", "2024-02-29", **settings)
        whole = N.train_anomaly(table, "2024-01-01", "2024-02-29", None, **settings)
        assert made.columns == whole.columns
        left, right = ({r.series_id: r for r in x.collect()} for x in (made, whole))
        assert set(left) == set(right) and len(left) == 3
        for key, row in right.items():
            assert left[key].phi == pytest.approx(row.phi, abs=1e-9) and left[key].sigma == pytest.approx(row.sigma)
            assert left[key].slot_means == pytest.approx(row.slot_means)
        scored = N.detect_anomalies(table, made, "2024-01-01", "2024-02-29", None, **settings).count()
        assert scored > 0
        with pytest.raises(Exception, match="overlap"):
            update_anomaly(spark, base, table, "2024-02-01", "2024-02-29", **settings)
        again = N.load_model(spark, base, metric, "MMSI", freq)
        assert {r.series_id: r.n for r in again.collect()} == {k: r.n for k, r in right.items()}
