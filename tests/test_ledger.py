"""An ingest that is killed and begun again."""

import os
import zipfile

import pytest

from tests.test_sources import HEADER, line
from vesselflow.operators.quality import CountMismatch
from vesselflow.plans import jobs
from vesselflow.plans.jobs import resume_ingest
from vesselflow.sources.ledger import ChangedArchive, Ledger
from vesselflow.sources.messages import read_months
from vesselflow.sources.storage import write_text


def archive(folder, number, month="01", rows=3, text=None):
    path = folder / f"AIS_{number:02d}.zip"
    with zipfile.ZipFile(path, "w") as zipped:
        zipped.writestr("note.txt", "no message")
        if rows:
            body = text or "\n".join([HEADER, *[line(number * 100 + i, f"2024-{month}-0{i + 1}T00:00:00") for i in range(rows)]])
            zipped.writestr("data/a.csv", body)
    return path


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "zips"
    root.mkdir()
    for number in range(4):
        archive(root, number, month="01" if number % 2 else "02")
    return root, str(tmp_path / "raw"), str(tmp_path / "ledger")


def ids(spark, out, months=("2024-01", "2024-02")):
    return sorted(int(r.MMSI) for r in read_months(spark, out, months).select("MMSI").collect())


ALL = sorted(number * 100 + i for number in range(4) for i in range(3))


def spoil(path):
    """Same size and time, but no archive any more: whoever opens it fails."""
    state = os.stat(path)
    path.write_bytes(b"x" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))


def test_a_stopped_run_goes_on_without_a_second_read(spark, place):
    root, out, ledger = place
    assert resume_ingest(spark, str(root), out, ledger, batch_bytes=1, most_batches=2) is None
    book = Ledger(spark, ledger)
    done = {r.source.rsplit("/", 1)[-1]: (r.members, r.bytes) for r in book.archives().collect()}
    assert done == {f"AIS_0{n}.zip": (1, os.path.getsize(root / f"AIS_0{n}.zip")) for n in (0, 1)}
    for name in done:
        spoil(root / name)
    compared = resume_ingest(spark, str(root), out, ledger, batch_bytes=1)
    assert {r.csv_rows for r in compared.collect()} == {2} and ids(spark, out) == ALL


def test_a_failing_archive_loses_its_batch_alone(spark, place):
    root, out, ledger = place
    good = (root / "AIS_02.zip").read_bytes()
    (root / "AIS_02.zip").write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)zip"):
        resume_ingest(spark, str(root), out, ledger, batch_bytes=1)
    assert Ledger(spark, ledger).archives().count() == 2
    (root / "AIS_02.zip").write_bytes(good)
    resume_ingest(spark, str(root), out, ledger)
    assert ids(spark, out) == ALL and Ledger(spark, ledger).archives().count() == 4


def test_a_run_killed_between_work_and_note_repeats_the_work_once(spark, place, monkeypatch):
    root, out, ledger = place
    commit = Ledger.commit_batch

    def killed(self, *arguments):
        raise KeyboardInterrupt

    monkeypatch.setattr(Ledger, "commit_batch", killed)
    with pytest.raises(KeyboardInterrupt):
        resume_ingest(spark, str(root), out, ledger)
    monkeypatch.setattr(Ledger, "commit_batch", commit)
    resume_ingest(spark, str(root), out, ledger)
    assert ids(spark, out) == ALL


def test_months_are_written_once_and_a_killed_publication_goes_on(spark, place, monkeypatch):
    root, out, ledger = place
    written, write = [], jobs.write_raw

    def noted(rows, to):
        written.append(rows.first().ym)
        if len(written) == 2:
            raise KeyboardInterrupt
        write(rows, to)

    monkeypatch.setattr(jobs, "write_raw", noted)
    with pytest.raises(KeyboardInterrupt):
        resume_ingest(spark, str(root), out, ledger)
    resume_ingest(spark, str(root), out, ledger)
    resume_ingest(spark, str(root), out, ledger)
    assert written == ["2024-01", "2024-02", "2024-02"] and ids(spark, out) == ALL


def test_later_archives_join_their_months(spark, place):
    root, out, ledger = place
    resume_ingest(spark, str(root), out, ledger)
    archive(root, 7, month="02")
    resume_ingest(spark, str(root), out, ledger)
    assert ids(spark, out) == sorted([*ALL, 700, 701, 702])
    Ledger(spark, ledger).close()
    assert Ledger(spark, ledger).archives().count() == 0


def test_a_changed_archive_is_an_error(spark, place):
    root, out, ledger = place
    resume_ingest(spark, str(root), out, ledger)
    archive(root, 1, rows=5)
    with pytest.raises(ChangedArchive, match="AIS_01"):
        resume_ingest(spark, str(root), out, ledger)


def test_archives_without_messages(spark, place):
    root, out, ledger = place
    archive(root, 8, rows=0)
    resume_ingest(spark, str(root), out, ledger, batch_bytes=1)
    assert ids(spark, out) == ALL
    members = {r.source.rsplit("/", 1)[-1]: r.members for r in Ledger(spark, ledger).archives().collect()}
    assert members["AIS_08.zip"] == 0 and len(members) == 5


def test_only_empty_archives_and_unreadable_times(spark, tmp_path):
    root = tmp_path / "zips"
    root.mkdir()
    archive(root, 1, rows=0)
    with pytest.raises(FileNotFoundError):
        resume_ingest(spark, str(root), str(tmp_path / "raw"), str(tmp_path / "ledger"))
    archive(root, 3, text=HEADER)
    with pytest.raises(FileNotFoundError):
        resume_ingest(spark, str(root), str(tmp_path / "raw"), str(tmp_path / "ledger"))
    archive(root, 2, text="\n".join([HEADER, line(1, "2024-01-01T00:00:00"), line(2, "soon")]))
    with pytest.raises(CountMismatch):
        resume_ingest(spark, str(root), str(tmp_path / "raw"), str(tmp_path / "ledger"))


def test_a_note_is_written_once(spark, tmp_path):
    path = str(tmp_path / "a" / "note.json")
    write_text(spark, path, "ä\n")
    with pytest.raises(FileExistsError):
        write_text(spark, path, "b")
    assert (tmp_path / "a" / "note.json").read_text() == "ä\n"
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")) == ["note.json"]
