import zipfile

import pytest

from tests.test_sources import HEADER, line
from vesselflow.operators.curation import curate
from vesselflow.operators.quality import CountMismatch, quality_report, reconcile_counts, require_match
from vesselflow.plans.jobs import ingest_archives, run_months
from vesselflow.sources import archives
from vesselflow.sources.messages import add_raw_partitions, read_months, write_raw
from vesselflow.sources.storage import marker_path, path_exists, write_marker


@pytest.fixture
def raw_base(messages, tmp_path):
    out = str(tmp_path / "raw")
    rows = [{"MMSI": i, "BaseDateTime": f"2024-0{1 + i % 2}-05T00:00:00"} for i in range(10)]
    write_raw(add_raw_partitions(messages(*rows, rows[0])), out)
    return out


def test_months_are_curated_once(spark, raw_base, tmp_path):
    out = str(tmp_path / "curated")
    first = run_months(spark, ["2024-02", "2024-01", "2024-03"], raw_base, out)
    assert (first.processed, first.skipped, first.failed) == (["2024-01", "2024-02"], ["2024-03"], [])
    assert first.strays == {"2024-01": 0, "2024-02": 0}
    assert path_exists(spark, marker_path(out, "2024-01"))
    before = sorted(map(tuple, read_months(spark, out, ["2024-01", "2024-02"]).collect()))
    assert len(before) == 10
    again = run_months(spark, ["2024-01", "2024-02"], raw_base, out)
    assert again.processed == [] and again.skipped == ["2024-01", "2024-02"]
    forced = run_months(spark, ["2024-01"], raw_base, out, resume=False)
    assert forced.processed == ["2024-01"]
    assert sorted(map(tuple, read_months(spark, out, ["2024-01", "2024-02"]).collect())) == before
    kept = run_months(spark, ["2024-01"], raw_base, out, resume=False, skip_existing=True)
    assert kept.skipped == ["2024-01"]


def test_rows_of_other_months_are_counted_and_left_out(spark, messages, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "curated")
    rows = messages({"MMSI": 1}, {"MMSI": 2, "BaseDateTime": "2024-02-05T00:00:00"}, {"BaseDateTime": "x"})
    rows.write.parquet(f"{raw}/ym=2024-01")
    outcome = run_months(spark, ["2024-01"], raw, out)
    assert outcome.strays == {"2024-01": 2}
    assert [r.MMSI for r in read_months(spark, out, ["2024-01"]).collect()] == ["000000001"]
    assert not path_exists(spark, f"{out}/ym=2024-02")


def test_a_failed_month_does_not_stop_the_rest(spark, raw_base, tmp_path):
    out = str(tmp_path / "curated")
    (tmp_path / "raw" / "ym=2023-12").mkdir()
    outcome = run_months(spark, ["2023-12", "2024-01"], raw_base, out)
    assert outcome.processed == ["2024-01"] and [m for m, _ in outcome.failed] == ["2023-12"]
    assert not path_exists(spark, marker_path(out, "2023-12"))


def test_marker_can_be_written_again(spark, tmp_path):
    write_marker(spark, str(tmp_path), "2024-01")
    write_marker(spark, str(tmp_path), "2024-01")
    assert path_exists(spark, marker_path(str(tmp_path), "2024-01"))


def test_archives_to_raw_months(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "AIS_1.zip", "w") as z:
        z.writestr("a.csv", "\n".join([HEADER, line(1), line(2), line(3, "2024-02-01T00:00:00")]))
    comparison = ingest_archives(spark, str(tmp_path), str(tmp_path / "raw")).collect()
    assert [(r.ymd, r.csv_rows, r.parquet_rows, r.match) for r in comparison] == [
        ("2024-01-05", 2, 2, True), ("2024-02-01", 1, 1, True),
    ]
    row = read_months(spark, str(tmp_path / "raw"), ["2024-02"]).first()
    assert row.MMSI == 3 and row.ymd == "2024-02-01" and row._source_file.endswith("AIS_1.zip/a.csv")


def test_unreadable_times_fail_the_ingest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "AIS_1.zip", "w") as z:
        z.writestr("a.csv", "\n".join([HEADER, line(1), line(2, "soon")]))
    with pytest.raises(CountMismatch):
        ingest_archives(spark, str(tmp_path), str(tmp_path / "raw"))


def test_counts_of_null_keys_match(spark):
    left = spark.createDataFrame([("a",), (None,), (None,)], "ymd string")
    right = spark.createDataFrame([("b",), (None,), (None,)], "ymd string")
    rows = {r.ymd: (r.csv_rows, r.parquet_rows, r.match) for r in reconcile_counts(left, right).collect()}
    assert rows == {"a": (1, 0, False), "b": (0, 1, False), None: (2, 2, True)}
    require_match(reconcile_counts(left, left))


def test_quality_report(messages):
    raw = messages(
        {}, {}, {"MMSI": 2, "SOG": 80.0}, {"MMSI": 3, "LAT": 95.0}, {"MMSI": 4, "BaseDateTime": "x"}
    )
    report = {(r.stage, r.metric): r.value for r in quality_report(raw, curate(raw)).collect()}
    assert report == {
        ("raw", "rows"): 5, ("raw", "without_position"): 1, ("raw", "percent_sog_out_of_range"): 20,
        ("raw", "unparseable_time"): 1, ("raw", "with_position"): 4,
        ("curated", "rows"): 3, ("curated", "distinct_keys"): 3, ("curated", "repeated_keys"): 0,
        ("curated", "sog_out_of_range"): 0, ("curated", "lat_out_of_range"): 0,
        ("curated", "lon_out_of_range"): 0, ("curated", "hour_out_of_range"): 0,
        ("curated", "duplicates_removed"): 1,
    }


def zip_of(folder, name, rows):
    with zipfile.ZipFile(folder / name, "w") as z:
        z.writestr("a.csv", "\n".join([HEADER, *rows]))


def test_times_with_a_blank_pass_the_ingest_check(spark, tmp_path):
    (tmp_path / "in").mkdir()
    zip_of(tmp_path / "in", "a.zip", [line(1, "2024-01-01 00:00:00"), line(2, "2024-01-01T00:00:00")])
    result = ingest_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [(r.ymd, r.csv_rows, r.parquet_rows, r.match) for r in result] == [("2024-01-01", 2, 2, True)]


def test_each_member_is_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(3):
        zip_of(tmp_path / "in", f"{k}.zip", [line(k, "2024-01-01T00:00:00")])
    reads = spark.sparkContext.accumulator(0)
    original = archives._member_reader

    def counting(*args):
        list_members, read_lines = original(*args)

        def counted(batches):
            def each():
                for batch in batches:
                    reads.add(batch.num_rows)
                    yield batch

            return read_lines(each())

        return list_members, counted

    monkeypatch.setattr(archives, "_member_reader", counting)
    ingest_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert reads.value == 3
