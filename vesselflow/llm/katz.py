"""LM scoring: a Katz back-off model of word pairs, counted and looked up in partitioned tables.

Good-Turing discounts lower the small counts; what a context loses is spread over the words
that never followed it, in proportion to their own (discounted) frequency, by a weight that
normalises the context exactly. Words that training never saw share the mass that the
single words lost:

    P(w | h) = d(c) * c(h, w) / c(h)   if the pair was seen
             = weight(h) * P(w)        else
    P(w)     = d(c) * c(w) / N         if the word was seen
             = the rest                else

No table fits a task or the driver, so tasks never look words up one by one. Documents are
dealt into chunks of bounded text. A chunk asks the parts of the word table for the counts
of its distinct words, and the parts of the pair table for those of its distinct pairs, in
sorted arrays; the answers come back in the same order and the chunk sums its documents. A
pair's part is that of its context, where the weights are summed; pairs of a hot context
(more than one in ``HOT_SHARE`` of all words) are dealt by pair, and its few sums are added
over the parts and handed to every chunk. A word or pair counts once a chunk however often
it occurs, so nothing is gathered by a frequent key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm.common import stored, table

#: Counts up to this are discounted.
LARGEST = 5
#: At most so many contexts are hot.
HOT_SHARE = 2000
CHUNK_BYTES = 5 << 20
WORD_PART_BYTES, PAIR_PART_BYTES = 48 << 20, 8 << 20
MOST_WORDS = 200_000
END = b"\n"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 divided by 5; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def is_held_out(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end, which no word equals."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    tokens.append(END)
    return tokens


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0) to d(LARGEST) and 1 for all larger ones, from the number of entries seen 1, 2, ... times.

    Good-Turing with Katz's correction, so that d is 1 above ``LARGEST``. Where the numbers
    are too few for that (a discount outside of 0 to 1), half a count is taken off instead."""
    n = [0, *counts_of_counts]
    out = np.ones(LARGEST + 2)
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, LARGEST + 1).astype(np.int64)] * counts


@dataclass
class Words:
    """Totals of the training words: what turns a count into a probability."""

    tokens: int
    distinct: int
    documents: int
    d: np.ndarray
    lost: float

    @classmethod
    def of(cls, tokens: int, distinct: int, documents: int, counts_of_counts: list[int]) -> Words:
        d = discounts(counts_of_counts)
        lost = sum((1 - d[r]) * r * counts_of_counts[r - 1] for r in range(1, LARGEST + 1)) / max(tokens, 1)
        return cls(tokens, distinct, documents, d, lost if lost > 0 else 0.0)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by the training count; 0 is the class of all unknown words."""
        if not self.tokens:
            return np.ones(len(counts))
        unknown = self.lost or 0.5 / (self.tokens + 0.5)
        scale = 1.0 if self.lost else 1 - unknown
        seen = scale * discounted(counts, self.d) / self.tokens
        return np.where(counts > 0, seen, unknown)


def context_shares(
    context: np.ndarray, classes: np.ndarray, larger: np.ndarray, below: np.ndarray, d: np.ndarray, some: np.ndarray
):
    """(scale of seen pairs, back-off weight) of contexts.

    ``classes`` counts the pairs seen 1 to LARGEST times, ``larger`` sums the other counts,
    ``below`` sums P(w) of the words seen, ``some`` tells whether there is a small count. A
    context without one has no discount; it gives half a count to the others. One that was
    never seen has weight 1. Where the sums were not asked for, only the scale has a meaning."""
    kept = (classes * (d[1 : LARGEST + 1] * np.arange(1, LARGEST + 1))).sum(axis=1) + larger
    scale = np.where(some, 1 / np.maximum(context, 1), 1 / (context + 0.5))
    weight = (1 - kept * scale) / (1 - below)
    return scale, np.where(context > 0, weight, 1.0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Lengths, then arrays; their first bytes together, then the second ones and so on.

    Most numbers are small, so most of those planes are zeros, which compress to nothing."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *planes])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(data, "<i8", len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def _part_of(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(values: np.ndarray):
    """(value, from, to) of the stretches of a sorted array."""
    if len(values):
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(values[a]), a, b


def _rows(rows, *names):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], list(names))


def count_words(docs: DataFrame, parts: int) -> DataFrame:
    """Training words as a table of (part, n, tokens, counts of counts, data).

    ``data`` has the sorted 64-bit hashes of the part's words and their counts. Each task
    counts first, so a frequent word is one entry for each task and not for each document."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa
        import xxhash

        def flush(counts):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, count=len(counts))
            values = np.fromiter(counts.values(), np.int64, count=len(counts))
            order = np.argsort(hashes)
            hashes, values = hashes[order], values[order]
            rows = [(p, _pack(hashes[a:b], values[a:b])) for p, a, b in _stretches(_part_of(hashes, parts))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])

        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if not is_held_out(key.as_py()):
                    counts.update(tokens_of(text.as_py()))
                    if len(counts) > MOST_WORDS:
                        yield flush(counts)
                        counts.clear()
        yield flush(counts)

    def add(key, rows):
        import pyarrow as pa

        own = [_unpack(d.as_py(), "<u8", "<i8") for d in rows.column("data")]
        hashes, at = np.unique(np.concatenate([o[0] for o in own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([o[1] for o in own]), len(hashes)).astype(np.int64)
        frequent = np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2]
        return pa.table(
            {
                "part": [key[0].as_py()],
                "n": [len(hashes)],
                "tokens": [int(counts.sum())],
                "frequent": pa.array([frequent.tolist()], pa.list_(pa.int64())),
                "data": [_pack(hashes, counts)],
            }
        )

    counted = docs.select("doc_id", "text").mapInArrow(count, "part bigint, data binary")
    return counted.groupBy("part").applyInArrow(add, "part bigint, n bigint, tokens bigint, frequent array<bigint>, data binary")


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Chunk:
    """Documents of a chunk as places in its sorted distinct words, and its distinct pairs."""

    def __init__(self, rows, words_only: bool = False):
        import xxhash

        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        split = [tokens_of(texts[i]) for i in order]
        self.sizes = np.array([len(tokens) for tokens in split], dtype=np.int64)
        known = dict.fromkeys(chain.from_iterable(split)) if words_only else _Numbers()
        if not words_only:
            numbers = map(known.__getitem__, chain.from_iterable(split))
            met = np.fromiter(numbers, np.int64, count=int(self.sizes.sum()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, count=len(known))
        ordered = np.argsort(hashes)
        self.words = hashes[ordered]
        if words_only:
            return
        rank = np.empty(len(known), np.int64)
        rank[ordered] = np.arange(len(known))
        self.tokens = rank[met]
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.context = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.context[self.firsts] = len(self.words)

    def pairs(self, word_ids: np.ndarray):
        """Distinct pairs of known words: contexts and words (places), counts in training, and
        the place of each token's pair among them (-1 without). The last context is the begin."""
        base = len(self.words) + 1
        known = np.concatenate([word_ids >= 0, [True]])
        asked = known[self.context] & known[self.tokens]
        codes = self.context[asked] * base + self.tokens[asked]
        training = np.repeat([not is_held_out(i) for i in self.ids], self.sizes)[asked] if self.ids else asked
        distinct, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at, training, len(distinct)).astype(np.int64)
        place = np.full(len(self.tokens), -1, np.int64)
        place[asked] = at
        return distinct // base, distinct % base, counts, place


def _ask_words(parts: int):
    def run(key, rows):
        words = Chunk(rows, words_only=True).words
        out = [(p, key[0].as_py(), _pack(words[a:b])) for p, a, b in _stretches(_part_of(words, parts))]
        return _rows(out, "part", "chunk", "data")

    return run


def _tell_words(offsets: dict[int, int]):
    """Ids and counts of the asked words, -1 and 0 for unknown ones."""

    def run(key, asked, known):
        out, part = [], key[0].as_py()
        words, counts = _unpack(known.column("data")[0].as_py(), "<u8", "<i8") if known.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for chunk, data in zip(asked.column("chunk").to_pylist(), asked.column("data"), strict=True):
            (own,) = _unpack(data.as_py(), "<u8")
            if not len(words):
                out.append((chunk, part, _pack(np.full(len(own), -1, "<i8"), np.zeros(len(own), "<i8"))))
                continue
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            hit = words[at] == own
            out.append((chunk, part, _pack(np.where(hit, at + offsets[part], -1).astype("<i8"), np.where(hit, counts[at], 0).astype("<i8"))))
        return _rows(out, "chunk", "part", "data")

    return run


def _word_answers(rows):
    """Ids and counts in the order of the chunk's words: by part."""
    data = [d.as_py() for d in rows.sort_by("part").column("data")]
    own = [_unpack(d, "<i8", "<i8") for d in data]
    return (np.concatenate([o[i] for o in own]) if own else np.zeros(0, np.int64) for i in range(2))


def _dealt_pairs(chunk: Chunk, ids: np.ndarray, counts: np.ndarray, words: Words, parts: int):
    """Distinct pairs with the part of each, in the order (part, context, word)."""
    context, word, training, place = chunk.pairs(ids)
    all_ids = np.concatenate([ids, [words.distinct]])
    all_counts = np.concatenate([counts, [words.documents]])
    h, w = all_ids[context].astype(np.uint64), all_ids[word].astype(np.uint64)
    hot = all_counts[context] * HOT_SHARE > words.tokens
    part = _part_of(_mix(_mix(h) + np.where(hot, w + np.uint64(1), np.uint64(0)) * _FACTOR), parts)
    # Pairs come in the order of context and word, and a stable sort keeps that within a part.
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    # Contexts that are followed by an unknown word need their weight in any case.
    needs = np.zeros(len(all_ids), dtype=bool)
    needs[chunk.context[ids[chunk.tokens] < 0]] = True
    return order, part[order], context[order], word[order], training[order], place, all_ids, all_counts, hot[order], needs


def _ask_pairs(words: Words, parts: int, kind: str):
    def run(key, rows, answers):
        out = []
        if rows.num_rows:
            chunk = Chunk(rows)
            ids, counts = _word_answers(answers)
            _, part, context, word, training, _, all_ids, all_counts, hot, needs = _dealt_pairs(chunk, ids, counts, words, parts)
            for p, a, b in _stretches(part):
                new = np.flatnonzero(np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]]))
                followers = np.diff(np.concatenate([new, [b - a]]))
                heads = context[a:b][new]
                out.append(
                    (
                        p,
                        key[0].as_py(),
                        _pack(
                            all_ids[heads].astype(kind),
                            followers.astype("<u4"),
                            (hot[a:b][new] + 2 * needs[heads]).astype("u1"),
                            all_ids[word[a:b]].astype(kind),
                            training[a:b].astype("<u4"),
                            all_counts[word[a:b]].astype("<u8"),
                        ),
                    )
                )
        return _rows(out, "part", "chunk", "data")

    return run


#: Answers have a chunk and data; sums of hot contexts and of all pairs (context -1) have numbers.
_PAIR_SCHEMA = (
    "chunk bigint, part bigint, data binary, context bigint, "
    + ", ".join(f"n{r} bigint" for r in range(1, LARGEST + 2))
    + ", larger bigint, below double"
)


def _tell_pairs(words: Words, kind: str):
    """Counts of the asked pairs, and for each context what its weight needs."""

    def run(key, rows):
        import pyarrow as pa

        chunks = rows.column("chunk").to_pylist()
        own = [_unpack(d.as_py(), kind, "<u4", "u1", kind, "<u4", "<u8") for d in rows.column("data")]
        h = np.concatenate([np.repeat(o[0], o[1]) for o in own]).astype(np.int64)
        hot = np.concatenate([np.repeat(o[2], o[1]) for o in own]) % 2 == 1
        w, training, frequency = (np.concatenate([o[i] for o in own]).astype(np.int64) for i in (3, 4, 5))
        order = np.argsort(h.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)) if kind == "<u4" else np.lexsort((w, h))
        sh, sw = h[order], w[order]
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1])])
        pair = np.cumsum(new) - 1
        first = order[new]
        total = np.bincount(pair, training[order]).astype(np.int64)
        counts = np.empty(len(h), np.int64)
        counts[order] = total[pair]
        heads = sh[new]
        starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        context = heads[starts]
        at = np.cumsum(np.concatenate([[True], heads[1:] != heads[:-1]])) - 1
        seen = total > 0
        classes = np.zeros((len(context), LARGEST), np.int64)
        small = seen & (total <= LARGEST)
        np.add.at(classes, (at[small], total[small] - 1), 1)
        larger = np.bincount(at, np.where(total > LARGEST, total, 0), len(context)).astype(np.int64)
        below = np.bincount(at, np.where(seen, words.probability(frequency[first]), 0.0), len(context))
        has_small = classes.any(axis=1)
        out, begin = [], 0
        for chunk, o in zip(chunks, own, strict=True):
            n = len(o[3])
            told = counts[begin : begin + n]
            begin += n
            if not len(o[0]):
                continue
            firsts = np.cumsum(o[1].astype(np.int64)) - o[1]
            unseen = np.minimum.reduceat(told, firsts) == 0
            cold = o[2] % 2 == 0
            # Only a context with an unseen follower in this chunk needs its weight there.
            weighted = cold & (unseen | (o[2] >= 2))
            place = np.searchsorted(context, o[0].astype(np.int64))
            mine = place[weighted]
            out.append(
                (
                    chunk,
                    key[0].as_py(),
                    _pack(
                        told.astype("<u8"),
                        (weighted + 2 * (cold & has_small[place])).astype("u1"),
                        classes[mine].astype("<u8").ravel(),
                        larger[mine].astype("<u8"),
                        below[mine],
                    ),
                )
            )
        is_hot = np.zeros(len(context), bool)
        is_hot[at[hot[first]]] = True
        frequent = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2]
        sums = [(-1, *frequent.tolist(), 0, 0.0)]
        sums += [(int(context[i]), *classes[i].tolist(), 0, int(larger[i]), float(below[i])) for i in np.flatnonzero(is_hot)]
        columns = [pa.array([r[i] for r in out] + [None] * len(sums), k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        kinds = [pa.int64()] * (LARGEST + 3) + [pa.float64()]
        columns += [pa.array([None] * len(out) + [s[i] for s in sums], k) for i, k in enumerate(kinds)]
        names = ["chunk", "part", "data", "context", *(f"n{r}" for r in range(1, LARGEST + 2)), "larger", "below"]
        return pa.Table.from_arrays(columns, names)

    return run


def _score(words: Words, parts: int):
    """Scores of a chunk's documents from all answers. ``step`` is 1 for words, 2 for pairs, 3 for sums."""

    def run(key, rows, answers):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        chunk = Chunk(rows)
        steps = [answers.filter(pc.equal(answers.column("step"), s)) for s in (1, 2, 3)]
        ids, counts = _word_answers(steps[0])
        order, part, context, word, _, place, all_ids, all_counts, hot, _ = _dealt_pairs(chunk, ids, counts, words, parts)
        told = steps[1].sort_by("part").column("data")
        own = [_unpack(d.as_py(), "<u8", "u1", "<u8", "<u8", "<f8") for d in told]
        seen = np.concatenate([o[0] for o in own]).astype(np.int64) if own else np.zeros(0, np.int64)
        n = len(chunk.words) + 1
        classes, larger, below = np.zeros((n, LARGEST)), np.zeros(n), np.zeros(n)
        # Each part answered for the contexts it was asked for, in this order.
        asked = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (part[1:] != part[:-1])])) if len(context) else np.zeros(0, int)
        discounts_here = np.ones(n, dtype=bool)
        if own:
            flags = np.concatenate([o[1] for o in own])
            cold = ~hot[asked]
            discounts_here[context[asked[cold]]] = flags[cold] >= 2
            heads = context[asked[flags % 2 == 1]]
            classes[heads] = np.concatenate([o[2] for o in own]).reshape(-1, LARGEST)
            larger[heads], below[heads] = (np.concatenate([o[i] for o in own]) for i in (3, 4))
        frequent = [0] * (LARGEST + 1)
        sums = (steps[2].column("sums")[0].as_py() or []) if steps[2].num_rows else []
        by_id = np.argsort(all_ids)
        at = np.minimum(np.searchsorted(all_ids, [e["context"] for e in sums], sorter=by_id), n - 1)
        for entry, k in zip(sums, by_id[at].tolist(), strict=True):
            if entry["context"] == -1:
                frequent = [entry[f"n{r}"] for r in range(1, LARGEST + 2)]
            elif entry["context"] == all_ids[k]:
                classes[k] = [entry[f"n{r}"] for r in range(1, LARGEST + 1)]
                larger[k], below[k] = entry["larger"], entry["below"]
                discounts_here[k] = classes[k].sum() > 0
        d = discounts(frequent)
        scale, weight = context_shares(all_counts, classes, larger, below, d, discounts_here)
        single = words.probability(np.concatenate([counts, [0]]))
        of_pair = np.where(seen > 0, discounted(seen, d) * scale[context], weight[context] * single[word])
        by_place = np.empty(len(order))
        by_place[order] = of_pair
        p = weight[chunk.context] * single[chunk.tokens]
        p[place >= 0] = by_place[place[place >= 0]]
        frequency = counts[chunk.tokens]
        base = np.log10((frequency + 0.5) / (words.tokens + 0.5 * (words.distinct + 1)))
        sums = [np.add.reduceat(v, chunk.firsts) for v in ((frequency > 0).astype(np.int64), base, np.log10(p))]
        values = [chunk.ids, [is_held_out(i) for i in chunk.ids], chunk.sizes, *sums]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key as doc_id with held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows that are not held out. A null or empty text has one
    token, its end. Null ids are not held out. Repeated rows count, and are scored, as often
    as they stand. Without training rows every word is of the one unknown class, with
    probability 1. An empty table gives none.
    """
    spark = docs.sparkSession
    source = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, word_parts, pair_parts = (max(1, -(-total // n)) for n in (CHUNK_BYTES, WORD_PART_BYTES, PAIR_PART_BYTES))
    counted = stored(count_words(source, word_parts), "words")
    offsets, at, tokens, frequent = {}, 0, 0, [0] * (LARGEST + 1)
    for row in counted.select("part", "n", "tokens", "frequent").orderBy("part").collect():
        offsets[row["part"]] = at
        at, tokens = at + row["n"], tokens + row["tokens"]
        frequent = [a + b for a, b in zip(frequent, row["frequent"], strict=True)]
    training = source.where(~held_out(F.col("doc_id"))).count()
    words = Words.of(tokens, at, training, frequent)
    kind = "<u4" if at < 2**32 - 1 else "<u8"
    to_part, to_chunk = "part bigint, chunk bigint, data binary", "chunk bigint, part bigint, data binary"
    dealt = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    asked = dealt.groupBy("chunk").applyInArrow(_ask_words(word_parts), to_part)
    told = asked.groupBy("part").cogroup(counted.select("part", "data").groupBy("part")).applyInArrow(_tell_words(offsets), to_chunk)
    asked_pairs = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask_pairs(words, pair_parts, kind), to_part)
    told_pairs = asked_pairs.groupBy("part").applyInArrow(_tell_pairs(words, kind), _PAIR_SCHEMA)
    numbers = [f"n{r}" for r in range(1, LARGEST + 2)] + ["larger", "below"]
    sums = (
        told_pairs.where("context is not null")
        .groupBy("context")
        .agg(*[F.sum(c).alias(c) for c in numbers])
        .agg(F.collect_list(F.struct("context", *numbers)).alias("sums"))
    )
    sums_type = sums.schema["sums"].dataType
    no_sums = F.lit(None).cast(sums_type).alias("sums")
    answers = (
        told.select("chunk", "part", "data", F.lit(1).alias("step"), no_sums)
        .unionAll(told_pairs.where("chunk is not null").select("chunk", "part", "data", F.lit(2).alias("step"), no_sums))
        .unionAll(
            spark.range(chunks).select(
                F.col("id").alias("chunk"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("data"), F.lit(3).alias("step"), sums.scalar().alias("sums")
            )
        )
    )
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(words, pair_parts), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the base formula and by the Katz model."""
    return score_texts(table(spark, sf_dir, "documents"))
