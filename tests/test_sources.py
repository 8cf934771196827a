import zipfile
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from vesselflow.schema import RAW_COLUMNS
from vesselflow.sources import messages as written
from vesselflow.sources.archives import (
    archive_members,
    arrow_location,
    expand_members,
    list_archives,
    member_counts,
    read_zip_lines,
)
from vesselflow.sources.links import absolute_url, extract_links
from vesselflow.sources.manifest import pending_files
from vesselflow.sources.messages import (
    add_lineage,
    add_raw_partitions,
    line_options,
    parse_message_lines,
    read_messages_csv,
    read_months,
    write_curated,
    write_raw,
)

HEADER = ",".join(RAW_COLUMNS)


def line(mmsi, when="2024-01-05T10:00:00", name="SHIP"):
    return f"{mmsi},{when},30.5,-90.25,5.0,100.0,90.0,{name},IMO1,C1,70,0,100,20,5.5,70,A"


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "in" / "deep er"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "AIS_2024_01_05.zip", "w") as z:
        z.writestr("readme.txt", "nothing\n")
        z.writestr("data/", "")
        z.writestr("data/a.csv", "\n".join([HEADER, line(1), "", line(2, name='"A, B"')]) + "\n")
        z.writestr("\\data\\b.CSV", "\r\n".join([HEADER, line(3), line("bad", "soon")]))
    with zipfile.ZipFile(folder / "AIS_2024_02_01.ZIP", "w") as z:
        z.writestr("c.csv", "\n".join([HEADER, *[line(i, "2024-02-01T00:00:00") for i in range(20000)]]))
    with zipfile.ZipFile(folder / "other.zip", "w") as z:
        z.writestr("d.csv", HEADER)
    (folder / "AIS_2024_03.txt").write_text("no archive")
    return str(tmp_path / "in")


def test_archives_are_chosen_by_base_name(spark, archives):
    names = {r.source.rsplit("/", 1)[-1] for r in list_archives(spark, archives).collect()}
    assert names == {"AIS_2024_01_05.zip", "AIS_2024_02_01.ZIP", "other.zip"}
    chosen = list_archives(spark, archives, r"^AIS_2024_.*\.(zip|ZIP)$")
    assert chosen.count() == 2
    with pytest.raises(FileNotFoundError):
        list_archives(spark, archives, r"^AIS_2023")


def test_members(spark, archives):
    found = list_archives(spark, archives, "^AIS_2024_01")
    assert {r.member for r in archive_members(found).collect()} == {"readme.txt", "data/a.csv", "data/b.CSV"}
    assert [r.members for r in member_counts(found).collect()] == [3]


def test_messages_of_archives(spark, archives):
    lines = read_zip_lines(spark, archives, "^AIS_2024_01")
    rows = parse_message_lines(lines).orderBy(F.col("MMSI").asc_nulls_last()).collect()
    assert [(r.MMSI, r.VesselName, r.BaseDateTime) for r in rows] == [
        (1, "SHIP", "2024-01-05T10:00:00"),
        (2, "A, B", "2024-01-05T10:00:00"),
        (3, "SHIP", "2024-01-05T10:00:00"),
        (None, "SHIP", "soon"),
    ]
    assert rows[0].LAT == 30.5 and rows[0].Draft == 5.5
    stamped = add_lineage(parse_message_lines(lines)).where("MMSI = 3").first()
    assert stamped._source_file.endswith("AIS_2024_01_05.zip/data/b.CSV") and stamped._ingest_ts


def test_long_members_come_in_several_batches(spark, archives):
    lines = read_zip_lines(spark, archives, "^AIS_2024_02")
    numbers = lines.agg(F.count("*"), F.countDistinct("line_no"), F.max("line_no")).first()
    assert tuple(numbers) == (20001, 20001, 20000)
    assert parse_message_lines(lines).count() == 20000
    assert parse_message_lines(lines, {"header": False}).count() == 20001


def test_members_are_dealt_by_size_and_none_is_lost(spark, archives):
    members = archive_members(list_archives(spark, archives, "^AIS_2024"))
    members = members.where("lower(member) like '%.csv'")
    two, whole = expand_members(members, tasks=2), expand_members(members)
    assert two.exceptAll(whole).isEmpty() and whole.exceptAll(two).isEmpty()
    # By default a task for each core, as far as there are members.
    cores = min(members.count(), spark.sparkContext.defaultParallelism)
    assert two.rdd.getNumPartitions() == 2 and whole.rdd.getNumPartitions() == cores > 1


def test_hidden_names_and_any_case_are_listed(spark, tmp_path):
    for name in ("B.ZIP", "_c.zip", ".d.Zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.csv", HEADER + "\n" + line(1))
    assert list_archives(spark, str(tmp_path)).count() == 3
    assert parse_message_lines(read_zip_lines(spark, str(tmp_path))).count() == 3


def test_hidden_csv_files_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + line(1))
    (tmp_path / "_b.csv").write_text(HEADER + "\n" + line(2))
    with pytest.raises(ValueError, match="_b.csv"):
        read_messages_csv(spark, str(tmp_path))


def test_locations_for_arrow():
    keys = {"fs.s3a.endpoint": "http://store:9000", "fs.s3a.access.key": "a", "fs.s3a.secret.key": "b"}
    options = {"endpoint_override": "store:9000", "scheme": "http", "access_key": "a", "secret_key": "b"}
    for scheme in ("s3", "s3a", "s3n"):
        assert arrow_location(f"{scheme}://bucket/a b/x#1.zip", keys) == ("s3", "bucket/a b/x#1.zip", options)
    assert arrow_location("s3a://bucket/x.zip") == ("s3", "bucket/x.zip", {})
    assert arrow_location("file:///a b/x.zip") == ("local", "/a b/x.zip", {})
    assert arrow_location("file:/a/x.zip") == arrow_location("/a/x.zip") == ("local", "/a/x.zip", {})
    assert arrow_location("gs://bucket/a b.zip", keys) == ("gcs", "bucket/a b.zip", {})
    assert arrow_location("hdfs://name:8020/a/x.zip") == ("hdfs", "/a/x.zip", {"host": "hdfs://name:8020"})
    assert arrow_location("hdfs:///a/x.zip") == ("hdfs", "/a/x.zip", {"host": "default"})
    assert arrow_location("abfss://c@acc.dfs.core.windows.net/x.zip") == ("azure", "c/x.zip", {"account_name": "acc"})
    with pytest.raises(ValueError, match="wasbs"):
        arrow_location("wasbs://c@a/x.zip")


def zipped(tmp_path, *texts):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i, text in enumerate(texts):
            z.writestr(f"{i}.csv", text)
    return str(tmp_path)


def read_zipped(spark, root, options=None):
    from vesselflow.sources.messages import reading

    return parse_message_lines(read_zip_lines(spark, root, **reading(options)), options)


def test_header_is_the_first_line_with_something(spark, tmp_path):
    root = zipped(tmp_path, f"\n  \n{HEADER}\n\n{line(1)}\n{line(2)}\n", f"# note\n{HEADER}\n# more\n{line(3)}")
    rows = read_zipped(spark, root, {"header": True, "comment": "#"})
    assert sorted(r.MMSI for r in rows.collect()) == [1, 2, 3]


def test_values_with_line_breaks(spark, tmp_path):
    root = zipped(tmp_path, HEADER + "\n" + line(1, name='"A\nB ""x"""') + "\n" + line(2))
    options = {"header": True, "multiLine": True, "escape": '"'}
    rows = sorted(read_zipped(spark, root, options).select("MMSI", "VesselName").collect())
    assert rows == [(1, 'A\nB "x"'), (2, "SHIP")]


def test_malformed_rows(spark, tmp_path):
    root = zipped(tmp_path, "\n".join([HEADER, line(1), line("bad"), "3,soon"]))
    assert read_zipped(spark, root).count() == 3
    assert [r.MMSI for r in read_zipped(spark, root, {"header": True, "mode": "DROPMALFORMED"}).collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_zipped(spark, root, {"header": True, "mode": "FAILFAST"}).collect()


@pytest.mark.parametrize("options", [{"inferSchema": True}, {"lineSep": ";"}, {"encoding": "UTF-16"}, {"mode": "no"}])
def test_options_that_cannot_work_are_refused(options):
    with pytest.raises(ValueError):
        line_options(options)


def test_archives_without_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(FileNotFoundError):
        read_zip_lines(spark, str(tmp_path))


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line(1), line(2)]))
    (tmp_path / "b.txt").write_text("no csv")
    rows = read_messages_csv(spark, str(tmp_path))
    assert rows.count() == 2 and rows.columns == RAW_COLUMNS
    assert read_messages_csv(spark, str(tmp_path), {"header": False}).count() == 3
    assert add_lineage(rows).first()._source_file.endswith("a.csv")
    semicolon = tmp_path / "s"
    semicolon.mkdir()
    (semicolon / "a.csv").write_text(line(9).replace(",", ";"))
    assert read_messages_csv(spark, str(semicolon), {"header": False, "sep": ";"}).first().MMSI == 9


def test_no_csv_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("no csv")
    with pytest.raises(FileNotFoundError):
        read_messages_csv(spark, str(tmp_path))


def test_only_touched_months_are_replaced(spark, messages, tmp_path):
    out = str(tmp_path / "raw")
    january, february = {"MMSI": 1}, {"MMSI": 2, "BaseDateTime": "2024-02-01T00:00:00"}
    write_raw(add_raw_partitions(messages(january, february)), out)
    write_raw(add_raw_partitions(messages({**january, "SOG": 9.0})), out)
    rows = read_months(spark, out, ["2024-01", "2024-02", "2024-03"], allow_missing=True).collect()
    with pytest.raises(FileNotFoundError, match="2024-03"):
        read_months(spark, out, ["2024-01", "2024-03"])
    assert sorted((r.ym, r.MMSI, r.SOG) for r in rows) == [("2024-01", 1, 9.0), ("2024-02", 2, 5.0)]
    assert read_months(spark, out, ["2024-02"]).count() == 1
    with pytest.raises(FileNotFoundError):
        read_months(spark, out, ["2024-03"])


def test_number_of_files(spark, messages, tmp_path):
    rows = add_raw_partitions(messages(*[{"MMSI": i} for i in range(50)]))
    out = str(tmp_path / "curated")
    write_curated(rows, out, files=3)
    parts = list((tmp_path / "curated" / "ym=2024-01").glob("*.parquet"))
    assert len(parts) == 3 and all(".snappy." in p.name for p in parts)
    assert spark.read.parquet(out).count() == 50


def test_files_of_months_have_a_task_each_and_no_sort(spark, messages, tmp_path, monkeypatch):
    months = ["2023-12", "2024-01", "2024-02"]
    rows = [{"MMSI": i, "BaseDateTime": f"{m}-05T10:00:00"} for m in months for i in range(50)]
    unclear = [{"MMSI": None}, {"BaseDateTime": "2024"}, {"BaseDateTime": None}, {"MMSI": None, "BaseDateTime": None}]
    raw = add_raw_partitions(messages(*rows, *unclear))
    out, name = str(tmp_path / "curated"), "spark.sql.maxConcurrentOutputFileWriters"
    before, seen, write = spark.conf.get(name), [], written._write_months

    def watched(*args):
        seen.append(int(spark.conf.get(name)))
        write(*args)

    monkeypatch.setattr(written, "_write_months", watched)
    write_curated(raw, out, files=3)
    assert seen and seen[0] > len(months) and spark.conf.get(name) == before
    tasks = [p.name[5:10] for m in months for p in (tmp_path / "curated" / f"ym={m}").glob("*.parquet")]
    assert len(tasks) == len(set(tasks)) == 9
    found = spark.read.parquet(out).select(*raw.columns[:-2])
    assert sorted(map(str, found.collect())) == sorted(map(str, raw.select(*found.columns).collect()))


BASES = [
    "http://h.example/a/b/c.html?x=1#f", "https://h.example", "http://h.example/", "http://h.example/a/b/",
    "http://h.example:8080/a?q=/x/y",
]
REFERENCES = [
    "x.zip", "/x.zip", "./x.zip", "../x.zip", "../../../x.zip", "/a/../x.zip", "/a/./b/..", "d/e/../x.zip",
    "?y=2", "#top", "//other.example/x.zip", "http://z.example/q.zip", "mailto:a@b", "x.zip?y=../z", "..", ".",
    "/", "x/", "a/b#c/../d",
]


def test_absolute_urls_equal_the_standard_library(spark):
    pairs = [(b, r) for b in BASES for r in REFERENCES]
    df = spark.createDataFrame(pairs, "base string, ref string")
    rows = df.select("base", "ref", absolute_url(F.col("base"), F.col("ref")).alias("u")).collect()
    wrong = [(r.base, r.ref, r.u, urljoin(r.base, r.ref)) for r in rows if r.u != urljoin(r.base, r.ref)]
    assert not wrong


def test_links_of_a_page(spark):
    html = """<html><body><A class="k" HREF='a.ZIP'>1</a><a href="b.zip?x">2</a> <a name="n" data-href="no.zip">
      <a href=c.zip>3</a><a
      href = "a.ZIP">again</a><a href="">empty</a><abbr href="no.zip"><link href="no.zip">
      <a href="d&amp;e.zip">4</a></body>"""
    pages = spark.createDataFrame([(1, "http://h/x/i.html", html)], "page_id int, url string, html string")
    rows = extract_links(pages).orderBy("position").collect()
    assert [(r.position, r.link) for r in rows] == [
        (0, "http://h/x/a.ZIP"), (1, "http://h/x/c.zip"), (2, "http://h/x/d&e.zip"),
    ]


def test_pending_files(spark):
    manifest = spark.createDataFrame(
        [("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 0)], "name string, size long"
    )
    landed = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9), ("e", 0)], "name string, size long")
    assert sorted(r.name for r in pending_files(manifest, landed).collect()) == ["b", "c", "d", "e"]
