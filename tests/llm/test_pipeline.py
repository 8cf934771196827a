import random

import pytest

import corpus_pipeline as C
from tests.llm.test_benchmark_leaks import brute as brute_leaks
from tests.llm.test_simhash import brute_components, brute_fingerprint
from vesselflow.llm import secret_formats, sentence_pieces
from vesselflow.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklmprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    prose = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(prose(14))) for i in range(6)]
    rows, labels = [], []
    for i in range(400):
        text = prose(60)
        toxic = i % 6 == 0
        if toxic:
            text[5:5] = ["idiot", "moron"]
        elif i % 10 == 1:
            text[20:20] = items[i % 6][1].split()
        elif i % 10 == 3:
            text[20:20] = ["token", "=", f"{i:040x}"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1].replace(" ", "\n", 1)) for i in range(1, 60)]
    rows += [(2000, ""), (2001, None), (None, rows[2][1]), (7, rows[7][1]), (None, " ".join(prose(40)))]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


@pytest.fixture(scope="module")
def steps(spark, folder):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{folder[0]}/documents.parquet"), []
    for name, stage in C.STAGES:
        given = docs
        docs = stored(stage(spark, docs, folder[0]), "stage")
        out.append((name, given.collect(), docs.collect(), docs.columns))
    return out


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def test_stages_and_columns(steps):
    assert [name for name, *_ in steps] == [name for name, _ in C.STAGES] and len(steps) == 5
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, _, columns in steps[:-1])


def test_toxic_documents_go(steps):
    _, given, kept, _ = steps[0]
    assert pairs(kept) == sorted((p for p in pairs(given) if "idiot" not in (p[1] or "")), key=repr)


def test_one_of_each_group_stays(steps):
    _, given, kept, _ = steps[1]
    prints = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in given}
    assert len(kept) == len(set((r.doc_id, r.text) for r in kept))
    known = [(i, f) for (i, _), f in prints.items() if i is not None]
    component = brute_components(known)
    of_print = {f: component[i] for i, f in known}
    expected = set(component.values())
    lone = {f for (i, _), f in prints.items() if i is None and not any(bin(f ^ g).count("1") <= 4 for g in of_print)}
    assert {r.doc_id for r in kept if r.doc_id is not None} == expected
    assert {prints[None, r.text] for r in kept if r.doc_id is None} == lone


def test_leaks_go(steps, folder):
    _, given, kept, _ = steps[2]
    found = {d for d, _ in brute_leaks([(k, r.text) for k, r in enumerate(given)], folder[2])}
    assert found and pairs(kept) == pairs(r for k, r in enumerate(given) if k not in found)


def test_secrets_are_masked_and_nothing_else(steps):
    _, given, kept, _ = steps[3]
    expected = []
    for r in given:
        spans = [(k, a, b, None) for k, a, b in secret_formats.base_spans(r.text or "")]
        expected.append((r.doc_id, secret_formats.redact(r.text, sorted(spans, key=lambda s: s[1]), C.REPLACEMENT)))
    assert pairs(kept) == sorted(expected, key=repr) and any(C.REPLACEMENT in (t or "") for _, t in expected)
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)


def test_ids_decode_to_the_texts(steps):
    _, given, kept, columns = steps[4]
    model = sentence_pieces.load_model()
    assert columns == ["doc_id", "n_tokens", "round_trip", "ids"] and all(r.round_trip for r in kept)
    assert sorted(sentence_pieces.decode_ids(model, r.ids) for r in kept) == sorted(r.text or "" for r in given)


def test_run_gives_the_last_stage(spark, folder, steps):
    key = lambda r: (repr(r.doc_id), r.n_tokens)
    assert sorted(map(key, C.run(spark, folder[0]).collect())) == sorted(map(key, steps[-1][2]))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
