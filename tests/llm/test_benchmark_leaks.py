import random

import numpy as np
import pytest

from vesselflow.llm import benchmark_leaks as B


def edits_within(item, text):
    """Least edits between the item and any stretch of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for word in text:
        diagonal, row[0] = row[0], 0
        for i, own in enumerate(item, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (own != word))
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = {}
    for key, text in docs:
        for item, own in items:
            words = B.words_of(own)
            if len(words) >= B.LEAST_WORDS:
                edits = edits_within(words, B.words_of(text))
                if edits <= B.allowed(len(words)):
                    out[key, item] = min(edits, out.get((key, item), 99))
    return out


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.choice("rid")
        if kind == "r":
            words[at] = rng.choice(vocabulary)
        elif kind == "i":
            words.insert(at, rng.choice(vocabulary))
        else:
            words.pop(at)
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 10, 15, 25, 40, 70])))) for i in range(30)]
    docs = []
    for d in range(250):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 30, 300]))
        if d % 2:
            own = B.words_of(items[d % 30][1])
            own = edited(rng, own, rng.randrange(0, B.allowed(len(own)) + 2), vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if d % 3 else w + "," for w in own]
        docs.append((d, " ".join(words)))
    return docs, items


def test_equals_brute_force_at_the_target_recall(spark, corpus):
    docs, items = corpus
    found = B.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    expected = brute(docs, items)
    assert got.keys() <= expected.keys() and all(got[k] == expected[k] for k in got)
    assert len(got) >= 0.95 * len(expected) > 80
    assert all((k in got) for k, edits in expected.items() if edits == 0)
    texts, wanted = dict(docs), dict(items)
    for r in found:
        stretch = B.words_of(texts[r.doc_id])[r.first_word : r.last_word]
        assert edits_within(B.words_of(wanted[r.item_id]), stretch) == r.edits


def test_agreement_of_places_is_at_least_the_assumed_one():
    rng = np.random.default_rng(0)
    for n in (10, 30, 60):
        embedding, agreed = B.Embedding(n, 300, 1), []
        for _ in range(30):
            x = rng.integers(1, 1 << 62, n).astype(np.uint64)
            y = x.copy()
            y[rng.choice(n, B.allowed(n), replace=False)] = rng.integers(1, 1 << 62, B.allowed(n)).astype(np.uint64)
            both = [embedding.signatures(v, np.zeros(1, np.int64)) for v in (x, y)]
            agreed.append((both[0] == both[1]).mean())
        assert np.mean(agreed) > B.AGREEMENT


@pytest.mark.parametrize("place", ["alone", "start", "end"])
@pytest.mark.parametrize("lost", ["front", "back", "anywhere"])
def test_items_that_lost_words_at_an_end_of_a_text(spark, place, lost):
    rng = random.Random(5)
    items, docs = [], []
    for i in range(120):
        words = [f"i{i}x{j}" for j in range(rng.choice([5, 10, 30, 59]))]
        n = B.allowed(len(words))
        gone = {"front": range(n), "back": range(len(words) - n, len(words)), "anywhere": rng.sample(range(len(words)), n)}[lost]
        own = [w for j, w in enumerate(words) if j not in gone]
        filler = [f"p{i}x{j}" for j in range(100)]
        docs.append((i, " ".join({"alone": own, "start": own + filler, "end": filler + own}[place])))
        items.append((i, " ".join(words)))
    found = B.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert all(r.doc_id == r.item_id and r.edits == B.allowed(r.n_words) for r in found)
    assert len(found) >= B.RECALL * len(docs)


def test_best_match_places():
    item = [1, 2, 3, 4, 5]
    assert B.best_match(item, [9, 9, 1, 2, 3, 4, 5, 9]) == (0, 2, 7)
    assert B.best_match(item, [9, 1, 2, 4, 5, 9]) == (1, 1, 5)
    assert B.best_match(item, [8, 8])[0] == 5


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame(
        [(None, "x " + item, 1), (1, None, 1), (2, "", 1), (3, item, 1), (3, item, 1), (4, "alpha beta", 1)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "alpha beta"), (None, item)], "item_id long, text string")
    got = B.find_leaks(docs, items).collect()
    both = [(None, 7), (None, None), (3, 7), (3, None), (None, 9), (3, 9), (4, 9)]
    assert sorted(repr((r.doc_id, r.item_id)) for r in got) == sorted(map(repr, both))
    assert B.find_leaks(docs.limit(0), items).count() == 0 == B.find_leaks(docs, items.limit(0)).count()


def test_very_long_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, "filler " * 300_000 + item)], "doc_id long, text string")
    row = B.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row.first_word, row.last_word) == (300_000, 300_008)


def test_short_items_are_found_word_for_word(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for d in range(120)] + [(500, None), (501, "W3, w4!")]
    items = [(i, " ".join(rng.choices(vocabulary, k=1 + i % 4))) for i in range(24)] + [(90, "w3 w4"), (91, ""), (92, "w1 w2 w3 w4 w5 w6 w7")]
    expected = {}
    for key, text in docs:
        words = B.words_of(text)
        for item, own in items:
            own = B.words_of(own)
            places = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
            if 0 < len(own) < B.LEAST_WORDS and places:
                expected[key, item] = (0, len(own), places[0], places[0] + len(own))
    found = B.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.edits, r.n_words, r.first_word, r.last_word) for r in found.collect() if r.item_id != 92}
    assert got == expected and (501, 90) in got and len(got) > 100
    short = B.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:24], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in short.collect()} == {k for k in expected if k[1] < 24}
