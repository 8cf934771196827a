import math
import random
from random import Random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from vesselflow.operators import percentiles as operator
from vesselflow.operators.percentiles import percentiles

pick = random.Random(5)
GROUPS = {
    "even": [float(i) for i in range(1, 101)],
    "ties": [1.0] * 50 + [2.0] * 3 + [9.0],
    "one": [4.0],
    None: [round(pick.uniform(0, 70), 1) for _ in range(777)],
    "long": [pick.uniform(0, 70) for _ in range(3000)],
}
SHARES = [0, 1, 7, 50, 95, 99, 100]


def nth(values, p, parts):
    return sorted(values)[max(1, -(-p * len(values) // parts)) - 1]


def table(spark):
    rows = [(g, v) for g, values in GROUPS.items() for v in [*values, None]]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


def test_exact(spark):
    for parts in (100, 101):
        found = percentiles(table(spark), ["g"], "v", {f"p{p}": p for p in SHARES}, parts, "top").collect()
        assert len(found) == len(GROUPS)
        for row in found:
            values = GROUPS[row.g]
            assert row.top == max(values)
            for p in SHARES:
                assert row[f"p{p}"] == nth(values, p, parts), (row.g, p, parts)


def test_approximate_is_near(spark):
    for row in percentiles(table(spark), ["g"], "v", {"p": 90}, accuracy=1000).collect():
        values = sorted(GROUPS[row.g])
        rank = sum(v <= row.p for v in values)
        assert abs(rank - math.ceil(0.9 * len(values))) <= max(50, 2 + len(values) / 100)


def test_cells_do_not_change_the_result(spark):
    for width in (0.01, 7.0, 1000.0):
        for row in percentiles(table(spark), ["g"], "v", {"p": 50}, cell_width=width).collect():
            assert row.p == nth(GROUPS[row.g], 50, 100)


def test_several_group_columns(spark):
    rows = [(g, h, float(v)) for g in ("a", None) for h in (1, None) for v in range(10)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    found = {(r.g, r.h): r.p for r in percentiles(df, ["g", "h"], "v", {"p": 50}).collect()}
    assert found == {("a", 1): 4.0, ("a", None): 4.0, (None, 1): 4.0, (None, None): 4.0}


def test_no_task_holds_the_values_of_a_group(spark):
    plan = plan_of(percentiles(table(spark), ["g"], "v", {"p": 90}))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    by_group = [line for line in shuffles if "_cell" not in line and ", v#" not in line]
    # By group alone travel the cell counts and the partial results only.
    assert len(by_group) == 2 and len(shuffles) > 2


def test_counts_are_made_once(spark):
    spark.range(200).selectExpr("string(id % 3) g", "double(id % 17) v").write.mode("overwrite").saveAsTable("percentile_rows")
    result = percentiles(spark.table("percentile_rows"), ["g"], "v", {"p": 90}, largest="top")
    assert result.count() == 3
    result.collect()
    final = plan_of(result).split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
    spark.sql("DROP TABLE percentile_rows")


SPREADS = {
    "wide": lambda random: 10.0 ** random.uniform(-6, 12),
    "narrow": lambda random: 1e6 + random.randrange(5000) * 1e-6,
    "few": lambda random: float(random.randrange(4)),
    "negative": lambda random: random.gauss(0, 1) * 10.0 ** random.randrange(9),
}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_selection_is_exact_on_any_spread(spark, accuracy):
    random = Random(8)
    rows = [(name, make(random)) for name, make in SPREADS.items() for _ in range(4000)]
    rows += [(None, float(i)) for i in range(7)] + [("one", 3.0), ("void", None), ("void", float("nan")), ("nan", float("nan")), ("nan", 1.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"least": 0, "p1": 1, "half": 50, "p95": 95, "p99": 99, "most": 100}
    found = {x.g: x for x in operator.selected_percentiles(frame, ["g"], "v", wanted, 100, "top", accuracy).collect()}
    assert set(found) == {*SPREADS, None, "one", "nan"}
    for name in [*SPREADS, None, "one"]:
        values = sorted(v for g, v in rows if g == name)
        for column, p in wanted.items():
            assert found[name][column] == values[max(1, -(-len(values) * p // 100)) - 1], (name, column)
        assert found[name].top == values[-1]
    assert found["nan"].least == found["nan"].most == found["nan"].top == 1.0
    other = {x.g: x for x in percentiles(frame.where("abs(v) < 1e6"), ["g"], "v", wanted).collect()}
    again = {x.g: x for x in operator.selected_percentiles(frame.where("abs(v) < 1e6"), ["g"], "v", wanted).collect()}
    assert {k: tuple(x) for k, x in other.items()} == {k: tuple(x) for k, x in again.items()}


def test_selection_ranks_only_a_sliver(spark):
    frame = spark.range(100_000).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    _, counts, _ = operator._counts_in_brackets(frame, ["g"], "v", {"half": 50}, 100, 2000)
    assert 100 < counts.count() < 1500
    half = operator.selected_percentiles(frame, ["g"], "v", {"half": 50}, accuracy=2000).first().half
    assert half == frame.select(F.expr("percentile_disc(0.5) within group (order by v)")).first()[0]


def test_selection_reads_the_rows_twice(spark, tmp_path):
    """Once for the brackets and once for the counts in them; groups of NULL and of two columns stay apart."""
    path = str(tmp_path / "rows")
    spark.range(600).selectExpr(
        "nullif(id % 3, 0) g", "if(id % 2 = 0, null, '') h", "double(id div 6) v"
    ).write.parquet(path)
    result = operator.selected_percentiles(spark.read.parquet(path), ["g", "h"], "v", {"least": 0, "most": 100}, largest="top")
    found = {(x.g, x.h): (x.top, x.least, x.most) for x in result.collect()}
    assert found == {(g, h): (99.0, 0.0, 99.0) for g in (None, 1, 2) for h in (None, "")}
    final = plan_of(result).split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") - final.count("ReusedExchange") <= 2


def test_a_missed_bracket_is_an_error(spark, monkeypatch):
    frame = spark.range(10_000).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    monkeypatch.setattr(operator, "SLACK", -100)
    with pytest.raises(Exception, match="bracket"):
        operator.selected_percentiles(frame, ["g"], "v", {"half": 50}, accuracy=1000).collect()
