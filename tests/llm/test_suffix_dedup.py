import random

import numpy as np
import pytest

from vesselflow.llm import suffix_dedup as S


def brute(rows):
    """Removed bytes of each row by a dictionary of all windows."""
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for q in range(len(b) - 49):
                w = b[q : q + 50]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        if i is not None:
            for q in range(len(b) - 49):
                if least[b[q : q + 50]] < i:
                    gone[q : q + 50] = True
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, part int")
    got = S.remove_repeats(docs).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), bytes(r.kept)) for r in got), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiouéü')}{k}" for k in range(200)] + ["the", "and", "of"] * 20
    passages = [" ".join(rng.choices(words, k=rng.choice([8, 12, 20, 60]))) for _ in range(12)]
    line = "All rights are reserved by the owners of this small site. "
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([0, 2, 10, 60])))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages) + text[at:]
        if i % 2:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + line + text[at:]
        rows.append((rng.randrange(10_000), text))
    rows += [(20_000 + k, rows[k][1]) for k in range(10)] + [(20_100 + k, rows[k][1][3:] + "z") for k in range(10)]
    rows += [(30_000, "a" * 400), (30_001, "ba" * 120 + "a" * 60), (30_002, "ab" * 100), (30_003, "a" * 49), (30_004, "a" * 50)]
    return rows


@pytest.mark.parametrize(
    ("seed", "chunk", "here", "crowded", "piece"),
    [(1, 4 << 20, 32, 2048, 1 << 15), (2, 3000, 32, 2048, 1 << 15), (3, 3000, 3, 4, 64), (4, 20_000, 2, 3, 257)],
)
def test_equals_brute_force(spark, monkeypatch, seed, chunk, here, crowded, piece):
    for name, value in (("CHUNK_BYTES", chunk), ("CROWDED_HERE", here), ("CROWDED", crowded), ("SLICE", piece), ("PART_BYTES", 4 * chunk)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(None, text), (5, text), (5, text), (6, text), (7, None), (8, ""), (None, None), (5, "x" + text)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(1, "x")][:0] or [(1, None)]) == [(1, 0, 0, b"")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("here", "crowded"), [(32, 2048), (3, 4)])
def test_rows_of_one_id_in_different_chunks(spark, monkeypatch, here, crowded):
    for name, value in (("CHUNK_BYTES", 1000), ("CROWDED_HERE", here), ("CROWDED", crowded), ("PART_BYTES", 12_000)):
        monkeypatch.setattr(S, name, value)
    rows = [(k % 7, text) for k, (_, text) in enumerate(corpus(5))]
    assert result(spark, rows) == brute(rows)


def test_one_long_text(spark):
    rng = random.Random(0)
    long = "".join(rng.choices("abcdefgh \n", k=300_000))
    rows = [(1, long), (2, long[1000:200_000] + "!" + long[:70])]
    assert [r[2] for r in result(spark, rows)] == [0, 199_070]


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 30) for k in range(50)], "doc_id long, text string")
    cut = S.remove_repeats(docs)
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
