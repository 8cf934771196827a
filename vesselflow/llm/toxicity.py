"""Toxicity: gradient-boosted trees over a few dense features, with isotonic calibration.

Features of a text are rates: words of a lexicon, such words near a second person,
capitals, punctuation, and words in disguise. The lexicon is a short list of insults plus
the words and word beginnings that training labels set apart. It is learned from the very
documents that train the trees, so a training document is measured by what the *other*
documents say: its own label is taken out of the counts (leave-one-out). A part of the
sample is kept from the trees and fits the isotonic curve, which turns their output into a
probability.

Training uses a bounded sample of labelled rows (``MAX_TRAIN``, by hash of the id); scoring
covers every whole text and moves no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import stored, table

#: Bound of the labelled rows that train the model.
MAX_TRAIN = 20_000
#: Bound of the learned lexicon.
MAX_LEXICON = 20_000
#: A score from here on is a prediction.
CUT = 0.7
SEED = 11

# Insults and second-person words that are searched from the start.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown clowns "
    "dumb imbecile retard bastard dummkopf idioten abschaum versager imbécile crétin débile ordure "
    "estúpido imbécil basura escoria payaso patético".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os vuestro".split()
)
LEET = str.maketrans("013457@$!|", "oieastasil")
PREFIXES = (4, 5, 6)
NEAR = 5
FEATURES = (
    "lexicon_rate", "lexicon_count", "lexicon_kinds", "lexicon_weight", "insult_rate", "near_second_person",
    "second_person_rate", "capital_rate", "shout_rate", "exclaim_rate", "punctuation_rate", "disguise_rate",
    "disguised_hits", "words",
)

_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"(?<![^\s])(?=[^\s]*[^\W\d_])(?=[^\s]*[0-9@$!|*.\-_][^\s]*[^\W\d_])[^\s]{3,24}(?![^\s])")
_NO_LETTER = re.compile(r"[\W_]+")


def entries_of(word: str) -> list[str]:
    """What a word may match in the lexicon: itself and its beginnings (marked by ``*``)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def weight(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    """Log-odds of an entry, 0 unless it is frequent enough and sets the classes apart."""
    if toxic < 3:
        return 0.0
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    odds = math.log(p / q)
    deviation = math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return odds if odds > math.log(6) and odds / deviation > 2 else 0.0


@dataclass
class Lexicon:
    """Document counts of entries by label; ``sizes`` are the documents of each label."""

    counts: dict[str, tuple[int, int]]
    sizes: tuple[int, int]

    def word_weight(self, word: str, label: int | None = None) -> float:
        """Largest weight of the word's entries, without one document of that label."""
        best = 3.0 if word in INSULTS else 0.0
        own_toxic, own_clean = label == 1, label == 0
        for entry in entries_of(word):
            if entry in self.counts:
                toxic, clean = self.counts[entry]
                best = max(
                    best,
                    weight(toxic - own_toxic, clean - own_clean, self.sizes[0] - own_toxic, self.sizes[1] - own_clean),
                )
        return best


class Memo(dict):
    """Weights of words, found once a task; emptied when it grows large."""

    def __init__(self, lexicon: Lexicon, label: int | None = None):
        super().__init__()
        self.lexicon, self.label = lexicon, label

    def __missing__(self, word: str) -> float:
        if len(self) > 120_000:
            self.clear()
        value = self[word] = self.lexicon.word_weight(word, self.label)
        return value


def features_of(text: str | None, weights: Memo) -> list[float]:
    """The features of one text in the order of ``FEATURES``; all 0 for an empty or null one."""
    text = text or ""
    found = _WORD.findall(text)
    if not found:
        return [0.0] * len(FEATURES)
    words = [w.lower() for w in found]
    scores = [weights[w] for w in words]
    n = len(words)
    hits = [i for i, s in enumerate(scores) if s]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        places = set(second)
        near = sum(any(j in places for j in range(i - NEAR, i + NEAR + 1)) for i in hits)
    letters = sum(map(len, found))
    capitals = sum(map(str.isupper, text))
    disguised = _DISGUISED.findall(text)
    plain = [_NO_LETTER.sub("", w.lower().translate(LEET)) for w in disguised]
    unmasked = sum(1 for w in plain if w in INSULTS or weights[w])
    return [
        len(hits) / n,
        math.log1p(len(hits)),
        math.log1p(len({words[i] for i in hits})),
        max(scores),
        sum(w in INSULTS for w in words) / n,
        near / n,
        len(second) / n,
        capitals / letters,
        sum(1 for w in found if len(w) > 2 and w.isupper()) / n,
        (text.count("!") + text.count("?")) / n,
        sum(map(text.count, ".,;:-")) / n,
        len(disguised) / n,
        math.log1p(unmasked),
        math.log1p(n),
    ]


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 divided by 3; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, label, text) of at most about ``most`` labelled documents that are not held out.

    An id labelled twice is toxic if one label says so. The sample is a range of the id's
    hash, so it is the same on any cluster; the ids are few and are broadcast."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    wanted = 1_000_000 * min(1.0, most / max(known.count(), 1))
    # Whole millionths of the hash, and of the next one the share that is left over.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    finer = F.pmod(F.xxhash64("doc_id", F.lit("finer")), F.lit(1 << 40)) / float(1 << 40)
    sample = known.where(slot + finer < wanted)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def learn_lexicon(rows: DataFrame, most: int = MAX_LEXICON) -> Lexicon:
    """Document counts of words and word beginnings by label; each task sums its own first."""

    def run(batches):
        import pyarrow as pa

        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w.lower() for w in _WORD.findall(text or "") if 2 < len(w) < 40}
                counts[int(label > 0)].update({e for w in words for e in entries_of(w)})
        toxic, clean = counts[1], counts[0]
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([toxic[e] for e in part], pa.int64()), pa.array([clean[e] for e in part], pa.int64())],
                ["entry", "toxic", "clean"],
            )

    sizes = rows.agg(F.sum("label"), F.count("*")).first()
    n_toxic = int(sizes[0] or 0)
    n_clean = int(sizes[1]) - n_toxic
    summed = (
        rows.select("label", "text")
        .mapInArrow(run, "entry string, toxic bigint, clean bigint")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    odds = F.log(((F.col("toxic") + 0.5) / F.lit(n_toxic + 1)) / ((F.col("clean") + 0.5) / F.lit(n_clean + 1)))
    best = summed.where((F.col("toxic") >= 3) & (odds > math.log(6))).orderBy(F.desc(odds * F.sqrt("toxic")), "entry").limit(most)
    return Lexicon({r["entry"]: (r["toxic"], r["clean"]) for r in best.collect()}, (n_toxic, n_clean))


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", label: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``_features``; with ``label`` its own label is left out."""
    columns = docs.columns
    at = columns.index(text)

    def run(batches):
        import pyarrow as pa

        memos = {value: Memo(lexicon, value) for value in ((0, 1) if label else (None,))}
        for batch in batches:
            texts = batch.column(at)
            labels = batch.column(columns.index(label)).to_pylist() if label else [None] * len(texts)
            made = [features_of(t.as_py(), memos[v]) for t, v in zip(texts, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*columns, "_features"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


@dataclass
class ToxicityModel:
    """Lexicon, trees and curve; without examples of both classes, only a base rate."""

    lexicon: Lexicon
    trees: object = None
    curve: object = None
    rate: float = 0.0

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All columns of ``docs`` and ``_score`` from 0 to 1.

        Null and empty texts have features of zero and a score like any other; rows with
        equal texts have equal scores, repeated rows come back each; no rows give no rows.
        Columns whose names begin with an underscore are reserved."""
        if self.trees is None:
            return docs.withColumn("_score", F.lit(self.rate))
        measured = with_features(docs, self.lexicon, text).withColumn("_vector", array_to_vector("_features"))
        judged = self.trees.transform(measured).withColumn("_margin", vector_to_array("_probability")[1])
        curved = self.curve.transform(judged)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))
        return curved.select(*docs.columns, score.alias("_score"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> ToxicityModel:
    """Fit lexicon, trees and curve on labelled documents that are not held out.

    Null ids and null labels are no examples; an id that is labelled twice is toxic if one
    label says so, and each row of an id is an example. Without examples of both classes,
    as with empty tables, the model is the share of toxic ones, 0 without any."""
    rows = stored(training_rows(docs, labels, most), "toxic-train")
    lexicon = learn_lexicon(rows)
    toxic, clean = lexicon.sizes
    if not toxic or not clean:
        return ToxicityModel(lexicon, rate=toxic / max(1, toxic + clean))
    measured = stored(with_features(rows, lexicon, "text", "label").drop("text"), "toxic-features").withColumn(
        "_vector", array_to_vector("_features")
    ).withColumn("_y", F.col("label").cast("double"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5))
    columns = {"featuresCol": "_vector", "labelCol": "_y", "predictionCol": "_class"}
    fit, curve = measured.where(part > 0), measured.where(part == 0)
    if fit.select("label").distinct().count() < 2 or curve.select("label").distinct().count() < 2:
        fit = curve = measured
    learner = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, maxBins=32, seed=SEED, **columns)
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    trees = learner.fit(fit.coalesce(6))
    margins = trees.transform(curve).withColumn("_margin", vector_to_array("_probability")[1])
    isotonic = IsotonicRegression(featuresCol="_margin", labelCol="_y", predictionCol="_score").fit(margins)
    return ToxicityModel(lexicon, trees, isotonic)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated score and the prediction at 0.7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= CUT).cast("int").alias("predicted"),
    )
