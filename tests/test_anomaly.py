import datetime as dt
import math

import pytest

from vesselflow.operators.curation import curate
from vesselflow.operators.series import time_series
from vesselflow.plans import anomaly as N

SCHEMA = "series_id string, ts_col timestamp, value double"
START = dt.datetime(2024, 1, 1)


def wave(hours, series="a", spike=None, level=10.0):
    """Daily pattern with a small deterministic wobble."""
    rows = []
    for h in range(hours):
        value = level + 3 * math.sin(h * math.pi / 12) + 0.3 * math.sin(h * 1.7)
        rows.append((series, START + dt.timedelta(hours=h), value + (20 if h == spike else 0)))
    return rows


def test_a_spike_is_found(spark):
    model = N.fit(spark.createDataFrame(wave(24 * 10), SCHEMA), "HOURLY")
    scored = N.score(spark.createDataFrame(wave(24 * 10, spike=100), SCHEMA), model, "HOURLY", 0.999)
    flagged = [r.ts_col for r in scored.where("is_anomaly").collect()]
    assert START + dt.timedelta(hours=100) in flagged and len(flagged) <= 2
    row = scored.where("hour(ts_col) = 4 and day(ts_col) = 5").first()
    assert row.anomaly_probability > 0.999999 and row.value > row.upper_bound > row.lower_bound


def test_model_has_one_row_per_series(spark):
    rows = wave(48) + wave(48, "b", level=50.0) + wave(30, None)
    model = {r.series_id: r for r in N.fit(spark.createDataFrame(rows, SCHEMA), "HOURLY").collect()}
    assert set(model) == {"a", "b", None} and model["a"].n == 48 and len(model["a"].slot_means) == 24
    assert model["b"].series_mean == pytest.approx(model["a"].series_mean + 40)
    assert model["a"].last_ts == START + dt.timedelta(hours=47) and abs(model["a"].phi) <= 0.99
    # Slots seen once take the mean of the series.
    assert model[None].slot_means[23] == pytest.approx(model[None].series_mean)
    assert N.fit(spark.createDataFrame(rows, SCHEMA), "HOURLY", min_points=40).count() == 2


def test_coefficients_equal_a_direct_computation(spark):
    rows = wave(24 * 6)
    r = N.fit(spark.createDataFrame(rows, SCHEMA), "HOURLY").first()
    values = [v for _, _, v in rows]
    means = {h: sum(values[h::24]) / 6 for h in range(24)}
    res = [v - means[i % 24] for i, v in enumerate(values)]
    x, y = res[:-1], res[1:]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    phi = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    shocks = [b - phi * a for a, b in zip(x, y)]
    mean = sum(shocks) / len(shocks)
    sigma = math.sqrt(sum((s - mean) ** 2 for s in shocks) / (len(shocks) - 1))
    assert r.phi == pytest.approx(phi) and r.sigma == pytest.approx(sigma)
    assert r.last_residual == pytest.approx(res[-1])


def test_unknown_and_constant_series_have_no_probability(spark):
    flat = [("f", START + dt.timedelta(hours=h), 5.0) for h in range(48)]
    model = N.fit(spark.createDataFrame(flat, SCHEMA), "HOURLY")
    scored = N.score(spark.createDataFrame(flat + wave(3, "new"), SCHEMA), model, "HOURLY").collect()
    assert len(scored) == 51
    assert all(r.anomaly_probability is None and r.is_anomaly is None for r in scored)


def test_first_point_continues_from_the_training_range(spark):
    model = N.fit(spark.createDataFrame(wave(24 * 10), SCHEMA), "HOURLY")
    m = model.first()
    nxt = spark.createDataFrame(wave(24 * 10 + 1)[-1:], SCHEMA)
    row = N.score(nxt, model, "HOURLY").first()
    assert (row.lower_bound + row.upper_bound) / 2 == pytest.approx(m.slot_means[0] + m.phi * m.last_residual)
    again = N.score(spark.createDataFrame(wave(1), SCHEMA), model, "HOURLY").first()
    assert (again.lower_bound + again.upper_bound) / 2 == pytest.approx(m.slot_means[0])


def test_horizon(spark):
    model = N.fit(spark.createDataFrame(wave(24 * 10), SCHEMA), "HOURLY", horizon=1)
    later = spark.createDataFrame(wave(24 * 10 + 2)[-2:], SCHEMA)
    rows = N.score(later, model, "HOURLY").orderBy("ts_col").collect()
    assert rows[0].anomaly_probability is not None and rows[1].anomaly_probability is None


@pytest.fixture(scope="module")
def table(messages):
    rows = [
        {"BaseDateTime": f"2024-01-{1 + d:02d}T{h:02d}:{m:02d}:00", "SOG": 5.0 + (d * 7 + h) % 3, "MMSI": m}
        for d in range(6) for h in (3, 9) for m in range(1 + (d + h) % 2)
    ]
    return curate(messages(*rows, {"BaseDateTime": "bad", "MMSI": 8}, {"VesselType": "x", "MMSI": 9}))


def test_time_series(table):
    rows = time_series(table, None, None, None, "COUNT", "hourly", "VesselTypeName").collect()
    assert {r.series_id for r in rows} == {None, "Cargo, all ships of this type"}
    by_time = {(r.series_id, r.ts_col): r.value for r in rows}
    assert by_time["Cargo, all ships of this type", dt.datetime(2024, 1, 1, 3)] == 2
    daily = time_series(table, "2024-01-01", "2024-01-02", None, "speed", "DAILY", "MMSI", None)
    assert {r.ts_col.hour for r in daily.collect()} == {0}
    short = time_series(table, None, None, precision=3)
    assert {len(r.series_id) for r in short.collect()} == {3}
    for metric, freq in (("max", "DAILY"), ("count", "WEEKLY")):
        with pytest.raises(ValueError):
            time_series(table, None, None, None, metric, freq)


def test_stored_model(spark, table, tmp_path):
    base = str(tmp_path)
    model = N.train_anomaly(table, None, None, None, "count", "daily", "MMSI")
    path = N.save_model(model, base, "Count", "MMSI", "daily")
    assert path.endswith("/anomaly_count_mmsi_daily")
    N.save_model(model.where("series_id = '000000000'"), base, "count", "MMSI", "DAILY")
    stored = N.load_model(spark, base, "count", "MMSI", "daily")
    assert stored.count() == 1
    result = N.detect_anomalies(table, stored, None, None, None, "count", "DAILY", "MMSI", 0.9)
    assert result.columns == [
        "series_id", "ts_col", "value", "is_anomaly", "anomaly_probability", "lower_bound", "upper_bound",
    ]
    found = [r.anomaly_probability for r in result.collect()]
    known = [p for p in found if p is not None]
    assert known == sorted(known, reverse=True) and found[: len(known)] == known


def test_model_names():
    assert N.model_name("count", "geo-hash 9", "HOURLY") == "anomaly_count_geo_hash_9_hourly"
    assert N.model_name("count", "geohash9", "DAILY", 2) == "anomaly_count_geohash9_daily_p2"


def test_a_model_for_other_settings_is_refused(spark, table, tmp_path):
    model = N.train_anomaly(table, None, None, None, "count", "DAILY", "geohash9", precision=2)
    N.save_model(model, str(tmp_path), "count", "geohash9", "DAILY", 2)
    with pytest.raises(FileNotFoundError):
        N.load_model(spark, str(tmp_path), "count", "geohash9", "DAILY")
    with pytest.raises(ValueError, match="precision"):
        N.detect_anomalies(table, model, None, None, None, "count", "DAILY", "geohash9")
    with pytest.raises(ValueError, match="metric"):
        N.detect_anomalies(table, model, None, None, None, "speed", "DAILY", "geohash9", precision=2)
    with pytest.raises(ValueError, match="does not tell"):
        N.detect_anomalies(table, model.drop("freq"), None, None, None, "count", "DAILY", "geohash9", precision=2)
    stored = N.load_model(spark, str(tmp_path), "count", "geohash9", "DAILY", 2)
    assert N.detect_anomalies(table, stored, None, None, None, "count", "DAILY", "geohash9", precision=2).count()
    for threshold in (0, 1, 1.5):
        with pytest.raises(ValueError):
            N.detect_anomalies(table, stored, None, None, None, "count", "DAILY", "geohash9", threshold, 2)


def test_nothing_is_carried_over_a_gap(spark):
    rows = wave(24 * 6)
    gap = [r for i, r in enumerate(rows) if i != 71]
    model = N.fit(spark.createDataFrame(rows, SCHEMA), "HOURLY")
    m = model.first()
    scored = {r.ts_col: r for r in N.score(spark.createDataFrame(gap, SCHEMA), model, "HOURLY").collect()}
    after = scored[START + dt.timedelta(hours=72)]
    assert (after.lower_bound + after.upper_bound) / 2 == pytest.approx(m.slot_means[0])


def test_an_outage_is_a_point_and_is_found(spark, messages):
    rows = [
        {"BaseDateTime": f"2024-01-{d:02d}T{h:02d}:{m:02d}:00", "MMSI": 1 + m}
        for d in range(1, 11) for h in range(24) for m in range(10 + (h * 7 + d) % 3)
        if (d, h) != (9, 5)
    ]
    table = curate(messages(*rows))
    args = (None, "count", "HOURLY", "VesselTypeName")
    model = N.train_anomaly(table, "2024-01-01", "2024-01-08", *args, fill=True)
    found = N.detect_anomalies(table, model, "2024-01-09", "2024-01-10", *args, threshold=0.999, fill=True)
    flagged = [(r.ts_col, r.value) for r in found.where("is_anomaly").collect()]
    assert (dt.datetime(2024, 1, 9, 5), 0) in flagged and found.count() == 48
    assert time_series(table, None, None, *args, fill=True).count() == 240
    assert time_series(table, None, None, *args).count() == 239
    with pytest.raises(ValueError):
        time_series(table, None, None, None, "speed", "HOURLY", "MMSI", fill=True)
