import random
import zlib

import pytest
from pyspark.sql import functions as F

from vesselflow.llm import toxicity as T


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")]
    rude = ["krompfel", "krompfler", "krompfo", "idiot"]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("toxic")
    rows = corpus()
    extra = [(5000, "", None), (5001, None, None), (None, "you idiot", None), (5002, "you idiot", None), (5002, "you idiot", None), (5003, "pure " * 100_000, None)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows + extra], "doc_id long, text string, score double, label int")
    docs.write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (77_777, 1, 1), (1, 1, None), (0, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return rows, T.op5_toxicity(spark, str(folder)).collect(), str(folder)


def test_held_out_accuracy(scored):
    rows, got, _ = scored
    truth = {i: y for i, _, y in rows}
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 200
    hits = sum(r.predicted and truth[r.doc_id] for r in unseen)
    assert hits >= 0.95 * sum(truth[r.doc_id] for r in unseen)
    assert hits >= 0.95 * sum(r.predicted for r in unseen)


def test_columns(scored):
    rows, got, _ = scored
    assert len(got) == len(rows) + 6
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.7 and not by_id[5003].predicted
    assert by_id[5002].score == by_id[None].score


def test_a_second_run_gives_the_same(spark, scored):
    _, got, folder = scored
    again = T.op5_toxicity(spark, folder).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 9))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_own_label_is_left_out():
    lexicon = T.Lexicon({"zzzword": (3, 0), "clean": (0, 9)}, (30, 300))
    assert lexicon.word_weight("zzzword") > 0 == lexicon.word_weight("zzzword", 1)
    assert lexicon.word_weight("clean") == 0


def test_features_see_disguise_shouting_and_nearness():
    memo = T.Memo(T.Lexicon({}, (0, 0)))
    f = dict(zip(T.FEATURES, T.features_of("YOU are an 1d10t and st*pid", memo)))
    assert f["disguised_hits"] > 0 and f["shout_rate"] > 0 and f["second_person_rate"] > 0
    g = dict(zip(T.FEATURES, T.features_of("you idiot! " + "word " * 20 + "idiot", memo)))
    assert g["near_second_person"] == pytest.approx(1 / 23) and g["insult_rate"] == pytest.approx(2 / 23)
    assert T.features_of(None, memo) == T.features_of("", memo) == [0.0] * len(T.FEATURES)


def test_without_examples_of_both_classes(spark):
    docs = spark.createDataFrame([(0, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        assert {r._score for r in T.learn_toxicity(docs, own).score(docs).collect()} == {0.0}
    assert T.learn_toxicity(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert 200 < T.training_rows(docs, labels, 300).count() < 400


@pytest.mark.parametrize("most", [1, 7, 300, 10**9])
def test_the_sample_is_about_as_large_as_asked_however_many_labels(spark, most):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    known = labels.where(~T.held_out(F.col("doc_id"))).count()
    got = T.training_rows(docs, labels, most).count()
    assert got == known if most > n else abs(got - most) <= 4 * most**0.5 + 3


def test_a_share_below_a_millionth_still_trains(spark):
    """The sample of 1,500,000 labels for one row each has about as many rows as asked."""
    labels = spark.range(6_000_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    docs = labels.select("doc_id", F.lit("a").alias("text"))
    counts = [T.training_rows(docs, labels, most).count() for most in (2, 40)]
    assert counts[0] <= 10 and 15 <= counts[1] <= 75
