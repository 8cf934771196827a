"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the number of local cores.
The whole chain is timed: ZIP archives to checked raw months, raw months to curated
months, then the analyses of that table, each run to its last row (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from vesselflow.operators.quality import quality_report, reconcile_counts  # noqa: E402
from vesselflow.operators.series import time_series  # noqa: E402
from vesselflow.plans import analyses as A  # noqa: E402
from vesselflow.plans import anomaly as N  # noqa: E402
from vesselflow.plans.jobs import ingest_archives, run_months  # noqa: E402
from vesselflow.registry.base import Context  # noqa: E402
from vesselflow.session import build_session  # noqa: E402
from vesselflow.sources.links import extract_links  # noqa: E402
from vesselflow.sources.messages import read_months  # noqa: E402

START, END = "2024-01-01", "2024-02-29"


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def curate_months(spark: SparkSession, months: list[str], raw_base: str, curated_base: str) -> None:
    outcome = run_months(spark, months, raw_base, curated_base)
    if outcome.processed != months:
        raise RuntimeError(str(outcome))


def headline(c: Context, raw: DataFrame, cur: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    model = N.train_anomaly(cur, START, END, None, "count", "DAILY", "MMSI")
    days = cur.selectExpr("string(date) ymd")
    return {
        "src07_extract_links": lambda: extract_links(c.table("pages"), ""),
        "an01_draft_outliers": lambda: A.draft_outliers(cur, START, END),
        "an02_course_changes": lambda: A.course_changes(cur, START, END, min_delta=90),
        "an03_course_changes_circular": lambda: A.course_changes_circular(
            cur, START, END, 600, 90, limit=100
        ),
        "an04_correlation_by_type": lambda: A.correlation_by_type(cur, START, END),
        "an06_recent_positions": lambda: A.recent_positions(cur, START, END),
        "an08_length_width_covariance": lambda: A.length_width_covariance(cur, START, END),
        "an09_status_summary": lambda: A.status_summary(cur, START, END),
        "an10_status_by_day": lambda: A.status_by_day(cur, START, END),
        "an11_moving_while_stationary": lambda: A.moving_while_stationary(cur, START, END),
        "an12_variability_by_type": lambda: A.variability_by_type(cur, START, END),
        "an14_unusual_speeds": lambda: A.unusual_speeds(cur, START, END),
        "an15_speeds_above_type_percentile": lambda: A.speeds_above_type_percentile(cur, START, END),
        "an16_speed_by_weekday": lambda: A.speed_by_weekday(cur),
        "an17_top_status_by_weekday": lambda: A.top_status_by_weekday(cur),
        "an18_time_series": lambda: time_series(cur, START, END, None, "count", "HOURLY", "geohash9"),
        "an19_train_anomaly": lambda: model,
        "an20_detect_anomalies": lambda: N.detect_anomalies(
            cur, model, START, END, None, "count", "DAILY", "MMSI"
        ),
        "val1_reconcile_counts": lambda: reconcile_counts(raw, days),
        "val2_quality_report": lambda: quality_report(raw, cur),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "vesselflow-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    context = Context(spark, sf_dir)
    archives = context.zip_files()
    run(context.table("events"))

    months = ["2024-01", "2024-02"]
    times: dict[str, float] = {}
    cold: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object], repeats: int = 3) -> object:
        """Median of the repeats after a first run, whose time is noted as the cold one."""
        taken, result = [], None
        for _ in range(repeats + 1):
            started = time.perf_counter()
            result = work()
            taken.append(round(time.perf_counter() - started, 3))
        cold[name], times[name] = taken[0], round(median(taken[1:]), 3)
        return result

    def ingest() -> str:
        """Each run writes to a folder of its own."""
        out = context.fresh_dir("raw")
        ingest_archives(spark, archives, out)
        return out

    def curate_all() -> str:
        out = context.fresh_dir("curated")
        curate_months(spark, months, raw_base, out)
        return out

    raw_base = timed("job1_ingest_archives", ingest)
    curated_base = timed("job1_run_months", curate_all)
    raw, curated = read_months(spark, raw_base, months), read_months(spark, curated_base, months)
    for name, build in headline(context, raw, curated).items():
        timed(name, lambda build=build: run(build()))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold": cold,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
