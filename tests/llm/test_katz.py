import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vesselflow.llm import katz as K


class Brute:
    """The model from whole dictionaries."""

    def __init__(self, rows):
        train = [[t for t in K.tokens_of(text)] for key, text in rows if not K.is_held_out(key)]
        self.one = Counter(t for tokens in train for t in tokens)
        self.n, self.two = sum(self.one.values()), defaultdict(Counter)
        for tokens in train:
            for h, w in zip([None, *tokens], tokens):
                self.two[h][w] += 1
        self.d1 = self.discounts(Counter(self.one.values()))
        self.d2 = self.discounts(Counter(c for row in self.two.values() for c in row.values()))
        self.lost = 1 - sum(self.d1(c) * c for c in self.one.values()) / self.n if self.n else 1.0

    @staticmethod
    def discounts(n):
        k = K.LARGEST
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0

        def d(r):
            if r > k:
                return 1.0
            value = (((r + 1) * n[r + 1] / n[r]) / r - a) / (1 - a) if n[r] and a < 1 else 0.0
            return value if 0 < value < 1 else (r - 0.5) / r

        return d

    def single(self, w):
        return self.d1(self.one[w]) * self.one[w] / self.n if self.one[w] else self.lost

    def pair(self, w, h):
        row = self.two.get(h)
        if not row:
            return self.single(w)
        total = sum(row.values())
        small = any(c <= K.LARGEST for c in row.values())
        scale = 1 / total if small else 1 / (total + 0.5)
        if row[w]:
            return self.d2(row[w]) * row[w] * scale
        left = 1 - scale * sum(self.d2(c) * c for c in row.values() if c)
        return left / (1 - sum(self.single(v) for v, c in row.items() if c)) * self.single(w)

    def score(self, text):
        tokens = K.tokens_of(text)
        return sum(math.log10(self.pair(w, h)) for h, w in zip([None, *tokens], tokens))

    def base(self, text):
        whole = self.n + 0.5 * (len(self.one) + 1)
        return sum(math.log10((self.one[t] + 0.5) / whole) for t in K.tokens_of(text))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["The", "THE", "É"] * 20
    rows = [(rng.randrange(10_000), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 200])))) for _ in range(n)]
    return rows + [(None, "the w1 unseen"), (3, None), (4, ""), rows[0], rows[0], (5, "\t \n")]


@pytest.mark.parametrize(
    ("seed", "chunk", "part", "hot", "words"), [(1, 8 << 20, 8 << 20, 2000, 300_000), (2, 4000, 2000, 30, 50), (3, 9000, 700, 8, 9)]
)
def test_equals_brute_force(spark, monkeypatch, seed, chunk, part, hot, words):
    for name, value in (("CHUNK_BYTES", chunk), ("PAIR_PART_BYTES", part), ("WORD_PART_BYTES", part), ("HOT_SHARE", hot), ("MOST_WORDS", words)):
        monkeypatch.setattr(K, name, value)
    rows = corpus(seed)
    model = Brute(rows)
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, chunk string, part int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in K.score_texts(docs).collect()))
    expected = sorted(
        (
            (i is None, i or 0, len(K.tokens_of(t)), sum(model.one[x] > 0 for x in K.tokens_of(t)), K.is_held_out(i), round(model.base(t), 6), round(model.score(t), 6))
            for i, t in rows
        )
    )
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)


def test_every_context_sums_to_one():
    model = Brute(corpus(5))
    for h in [None, *list(model.two)[:60], b"never seen"]:
        total = sum(model.pair(w, h) for w in model.one) + model.pair(b"never seen", h)
        assert total == pytest.approx(1.0, abs=1e-9)


def test_discounts_stay_between_zero_and_one():
    for counts in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [1000, 400, 200, 100, 60, 40]):
        d = K.discounts(counts)
        assert d[-1] == 1 and ((d[1:-1] > 0) & (d[1:-1] < 1)).all()


def test_context_without_small_counts_keeps_half_a_count():
    scale, weight = K.context_shares(np.array([20.0]), np.zeros((1, K.LARGEST)), np.array([20.0]), np.array([0.25]), K.discounts([9, 5, 3, 2, 2, 1]), np.array([False]))
    assert 20 * scale[0] + weight[0] * 0.75 == pytest.approx(1.0)


def test_empty_and_untrained_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert K.score_texts(docs.limit(0)).count() == 0
    out = next(i for i in range(100) if K.is_held_out(i))
    row = K.score_texts(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_counts_beyond_32_bits_arrive_whole():
    import pyarrow as pa

    words = K.Words.of(10**11, 10, 1000, [5, 4, 3, 2, 1, 1, 1, 1, 1, 1][: K.LARGEST + 1])
    most = 2**32 - 1

    def asked(times):
        return K._pack(
            np.array([3, 5], "<u4"), np.array([2, 1], "<u4"), np.array([2, 2], "u1"),
            np.array([1, 2, 1], "<u4"), np.array(times, "<u4"), np.array([5_000_000_000, 7, 5_000_000_000], "<u8"),
        )

    rows = pa.table({"chunk": pa.array([1, 2], pa.int64()), "data": pa.array([asked([most, 1, 2]), asked([most, 0, most])], pa.binary())})
    out = K._tell_pairs(words, "<u4")((pa.scalar(0, pa.int64()),), rows)
    for data in out.column("data").to_pylist()[:2]:
        told, _, _, larger, below = K._unpack(data, "<u8", "u1", "<u8", "<u8", "<f8")
        assert told.tolist() == [2 * most, 1, most + 2]
        assert larger.tolist() == [2 * most, most + 2]
        assert below[1] == pytest.approx(words.probability(np.array([5_000_000_000]))[0])
