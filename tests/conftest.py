import pytest

from vesselflow.schema import RAW_SCHEMA
from vesselflow.session import build_session

DEFAULT_MESSAGE = {
    "MMSI": 366000001,
    "BaseDateTime": "2024-01-05T10:00:00",
    "LAT": 30.0,
    "LON": -90.0,
    "SOG": 5.0,
    "COG": 100.0,
    "Heading": 90.0,
    "VesselName": "SHIP",
    "IMO": "IMO9000001",
    "CallSign": "CALL1",
    "VesselType": "70",
    "Status": "0",
    "Length": 100.0,
    "Width": 20.0,
    "Draft": 5.0,
    "Cargo": "70",
    "TransceiverClass": "A",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "vesselflow-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def messages(spark):
    """Raw messages from dicts; missing fields take a plausible default."""

    def make(*rows):
        data = [tuple({**DEFAULT_MESSAGE, **row}[c] for c in RAW_SCHEMA.fieldNames()) for row in rows]
        return spark.createDataFrame(data, RAW_SCHEMA)

    return make


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression for each of some inputs."""

    def run(expression, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in rows.select("i", expression("x").alias("y")).orderBy("i").collect()]

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def largest_method(spark, df) -> int:
    """Bytecode size of the largest generated method of a plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = spark._jvm.org.apache.spark.sql.execution.debug
    stages = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(plan)
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
