"""Benchmark decontamination by edit distance, through the CGK embedding.

Items and documents are compared as words. The embedding walks over a sequence with random
steps that depend on the word: at each step it writes the current word and then stays or
moves on. Two sequences that differ by few edits fall into step again after an edit, so
most of what they write is equal, place by place: edit distance has become Hamming distance.
Sampling a few places gives a signature that close sequences share with a known chance,
and enough repetitions, each with its own walk and places, reach the target recall.

Documents are embedded in windows of the size of an item, one for each distinct size.
Windows reach over both ends of a text by as many words as an item may lose there. An
edit breaks at most two word pairs of an item, so a window within k edits of an item of n
words has at least n - 1 - 2k of its pairs; a table of fixed size that tells in which sizes
of items a pair occurs rules most windows out before any embedding, and none that counts.
Windows of a document that overlap and whose signatures may occur in the index become one
region; regions meet items by an equi-join on signatures and are verified by exact edit
distance.

Only tables of fixed size and the list of sizes are sent to all tasks. Items are rows of a
table, and an item that leaks into a third of all documents is a hot key of a join whose
other side has one row for it.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import slices, stored, table

#: Least similarity, as 1 - edits / words of the item.
SIMILARITY = 0.8
#: Items of fewer words may not lose any at the least similarity, so they are searched word
#: for word, without an embedding.
LEAST_WORDS = 5
#: Places of a signature, and chance that one place agrees at the least similarity
#: (measured, see the tests).
SAMPLES, AGREEMENT = 2, 0.25
RECALL = 0.97
#: Bits of the bitmap of signatures, and entries of the table of word pairs.
BITS = 1 << 23
SLOTS = 1 << 20
SEED = 20
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The word in front of a text. It is not 0, where a walk would stay.
_BEFORE = np.uint64(0xD6E8FEB86659FD93)


def repetitions(recall: float = RECALL, agreement: float = AGREEMENT, samples: int = SAMPLES) -> int:
    """So many that a pair at the least similarity shares a signature with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**samples))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; punctuation and white space do not count."""
    return _WORD.findall((text or "").lower())


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of ``n`` words may differ by."""
    return int((1 - similarity) * n + 1e-9)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher(dict):
    """64-bit hash of each word, as a dictionary that fills itself; emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Embedding:
    """Signatures of windows of one size: sampled places of repeated random walks."""

    def __init__(self, size: int, repeats: int, samples: int = SAMPLES):
        rng = np.random.default_rng([SEED, size])
        self.size = size
        # After 1.6 steps a word few walks have passed the end, where all sequences agree.
        places = np.sort(rng.integers(0, int(1.6 * size), (repeats, samples)), axis=1)
        # Repetitions in the order of their last place: those that are done come first.
        self.places = places[np.argsort(places[:, -1], kind="stable")]
        self.steps = int(self.places.max()) + 1
        self.salts = rng.integers(0, 1 << 63, (self.steps, repeats), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.first = _scramble(np.arange(repeats, dtype=np.uint64) + np.uint64(size << 20) + _ODD)

    def signatures(self, words: np.ndarray, starts: np.ndarray, begins=None, ends=None) -> np.ndarray:
        """One row of signatures for each window of ``words``; past its end the word is 0.

        Windows may reach over their text, which goes from ``begins`` to ``ends``: the word
        behind it is 0 too, the one in front of it is ``_BEFORE``."""
        n, repeats = len(starts), len(self.first)
        windows = np.zeros((n, self.size + 1), dtype=np.uint64)
        over = np.zeros(n, dtype=bool) if begins is None else (starts < begins) | (starts + self.size > ends)
        if not over.all():
            windows[~over, :-1] = np.lib.stride_tricks.sliding_window_view(words, self.size)[starts[~over]]
        if over.any():
            at = starts[over][:, None] + np.arange(self.size)
            own = words[np.clip(at, 0, len(words) - 1)]
            own[at < begins[over][:, None]] = _BEFORE
            own[at >= ends[over][:, None]] = 0
            windows[over, :-1] = own
        flat = windows.ravel()
        at = np.repeat(np.arange(n)[:, None] * (self.size + 1), repeats, axis=1)
        out = np.tile(self.first, (n, 1))
        done = np.searchsorted(self.places[:, -1], np.arange(self.steps))
        for step in range(self.steps):
            # A product with the word 0 is 0, so a walk that has reached the end stays there.
            word = flat[at[:, done[step] :]]
            for column in np.flatnonzero((self.places == step).any(axis=1)):
                out[:, column] = _scramble(out[:, column] * _ODD + word[:, column - done[step]])
            word *= self.salts[step, done[step] :]
            word >>= np.uint64(63)
            at[:, done[step] :] += word.view(np.int64)
        return out


def bit_of(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(BITS - 1)).astype(np.int64)


def slots_of(words: np.ndarray) -> np.ndarray:
    """Entry of each pair of neighbouring words in the table."""
    mixed = words[:-1] * _ODD
    mixed += words[1:]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(44)
    return mixed.astype(np.int64)


def codes_of(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of so many words."""
    n = max(len(words) - size + 1, 0)
    codes = np.full(n, SEED + size, dtype=np.uint64)
    for k in range(size):
        codes = _scramble(codes * _ODD + words[k : k + n])
    return codes


def index_items(items: DataFrame, similarity: float = SIMILARITY, repeats: int | None = None) -> DataFrame:
    """Items as rows: item_id, size, words, signatures and the table entries of their pairs.

    Items of fewer than ``LEAST_WORDS`` words have the code of all their words for a
    signature; null items and those without a word are left out."""
    repeats = repeats or repetitions()

    def run(batches):
        import pyarrow as pa

        hashes, embeddings = Hasher(), {}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array([hashes[w] for w in words_of(text)], dtype=np.uint64)
                size = len(words)
                if not size:
                    continue
                if size < LEAST_WORDS:
                    rows.append((key, size, words.view(np.int64).tolist(), codes_of(words, size).view(np.int64).tolist(), []))
                    continue
                if size not in embeddings:
                    embeddings[size] = Embedding(size, repeats)
                signatures = embeddings[size].signatures(words, np.zeros(1, np.int64))[0]
                slots = np.unique(slots_of(words))
                rows.append((key, size, words.view(np.int64).tolist(), signatures.view(np.int64).tolist(), slots.tolist()))
            longs = pa.list_(pa.int64())
            kinds = (batch.schema.field(0).type, pa.int32(), longs, longs, longs)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "size", "words", "signatures", "slots"])

    schema = T.StructType(
        [
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("size", T.IntegerType()),
            *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("words", "signatures", "slots")),
        ]
    )
    return items.select("item_id", "text").where("text is not null").mapInArrow(run, schema)


def bitmap(bits: DataFrame) -> bytes:
    """The bitmap of the positions in ``bits`` (bit): rows of fixed number and size are collected."""
    parts = (
        bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
        .collect()
    )
    whole = np.zeros(BITS // 8, dtype=np.uint8)
    for row in parts:
        own = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        at = (row["part"] - 1) * 4096
        whole[at : at + len(own)] = own
    return whole.tobytes()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def pair_table(index: DataFrame, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Used entries and their masks: bit k stands for the k-th size, modulo 64. At most ``SLOTS``."""
    bit = (F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col("size")) - 1) % 64
    rows = (
        index.select(F.explode("slots").alias("slot"), bit.cast("int").alias("bit"))
        .groupBy("slot")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        .collect()
    )
    return np.array([r["slot"] for r in rows], np.int64), np.array([r["mask"] for r in rows], np.int64)


class Scanner:
    """Finds the regions of texts that may hold an item."""

    def __init__(self, sizes: list[int], pairs, signatures: bytes, similarity: float, repeats: int):
        self.sizes = sizes
        self.masks = np.zeros(SLOTS, dtype=np.uint64)
        self.masks[pairs[0]] = pairs[1].view(np.uint64)
        self.signed = np.frombuffer(signatures, dtype=np.uint8)
        self.similarity, self.repeats = similarity, repeats
        self.embeddings: dict[int, Embedding] = {}
        self.hashes = Hasher()

    def regions(self, texts: list[str | None]) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(text, size, first word, words, signatures) of each region of these texts."""
        split = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        ends = np.cumsum(lengths)
        words = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(split)), np.uint64, count=int(lengths.sum()))
        if len(words) < 2:
            return []
        begins = ends - lengths
        masks = self.masks[slots_of(words)]
        masks[ends[(ends > 0) & (ends < len(words))] - 1] = 0  # no pair goes from one text to the next
        known = np.flatnonzero(masks)
        masks, text = masks[known], np.searchsorted(ends, known, side="right")
        out = []
        for k, size in enumerate(self.sizes):
            slack = allowed(size, self.similarity)
            least = size - 1 - 2 * slack
            chosen = masks >> np.uint64(k % 64) & np.uint64(1) == 1
            own, owner = known[chosen], text[chosen]
            if len(own) < least:
                continue
            # Any ``least`` of the pairs that lie within a window allow a range of starts.
            first, last = own[: len(own) - least + 1], own[least - 1 :]
            close = (last - first <= size - 2) & (owner[: len(first)] == owner[least - 1 :])
            first, last, owner = first[close], last[close], owner[: len(close)][close]
            # An item that lost words at an end of a text is shorter than a window there, so
            # windows reach over both ends by as many words as an item may lose.
            low = np.maximum(last - size + 2, begins[owner] - slack)
            high = np.minimum(first, ends[owner] - size + slack)
            some = low <= high
            low, high, owner = low[some], high[some], owner[some]
            if not len(low):
                continue
            # Two texts share no place when each is moved by what windows reach over before it.
            moved = 2 * slack * owner
            places = np.unique(_ranges(low + moved, high - low + 1))
            owner = np.searchsorted(ends + slack + 2 * slack * np.arange(len(ends)), places, side="right")
            out += self._hits(size, words, places - 2 * slack * owner, owner, begins, ends)
        return out

    def _hits(self, size, words, starts, owner, begins, ends):
        if size not in self.embeddings:
            self.embeddings[size] = Embedding(size, self.repeats)
        out = []
        slack = allowed(size, self.similarity)
        for at in range(0, len(starts), 4096):
            s, o = starts[at : at + 4096], owner[at : at + 4096]
            signatures = self.embeddings[size].signatures(words, s, begins[o], ends[o])
            hit = _has(self.signed, bit_of(signatures))
            some = hit.any(axis=1)
            s, o, signatures, hit = s[some], o[some], signatures[some], hit[some]
            if not len(s):
                continue
            new = np.concatenate([[True], (s[1:] > s[:-1] + size) | (o[1:] != o[:-1])])
            cuts = np.flatnonzero(np.concatenate([new, [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                doc = int(o[a])
                low = max(int(begins[doc]), int(s[a]) - slack)
                high = min(int(ends[doc]), int(s[b - 1]) + size + slack)
                own = np.unique(signatures[a:b][hit[a:b]])
                out.append((doc, size, low - int(begins[doc]), words[low:high], own))
        return out


def _myers(pattern: list[int], text: list[int]) -> list[int]:
    """Edits between the pattern and the best stretch that ends at each place of the text."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    plus, minus, score, out = full, 0, n, []
    for word in text:
        eq = where.get(word, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        out.append(score)
    return out


def best_match(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of the region that is closest to the item.

    On ties the one that ends first, then the shortest."""
    ends = _myers(item, region)
    least = min(ends)
    if least >= len(item):
        return len(item), 0, 0
    end = ends.index(least) + 1
    back = _prefix_edits(item[::-1], region[:end][::-1])
    return least, end - back, end


def _prefix_edits(pattern: list[int], text: list[int]) -> int:
    """Length of the shortest beginning of the text with the fewest edits to the pattern."""
    row = list(range(len(pattern) + 1))
    best, length = row[-1], 0
    for j, word in enumerate(text[: 2 * len(pattern)], 1):
        diagonal, row[0] = row[0], j
        for i, own in enumerate(pattern, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (own != word))
        if row[-1] < best:
            best, length = row[-1], j
    return length


def short_leaks(docs: DataFrame, index: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """Key, item and first place of the items of few words that stand in a document word for word.

    A bitmap of fixed size, made of the items, rules most places out in the task that reads
    the document; what is left is one row per document and different wording, and meets the
    items by an equi-join on all their words."""
    listed = index.where(F.col("size") < LEAST_WORDS).select("item_id", F.col("words").alias("_words"), F.col("signatures")[0].alias("code"))
    coded = bitmap(listed.select(F.pmod(F.col("code"), F.lit(BITS)).alias("bit")))

    def scan(batches):
        import pyarrow as pa

        hashes, bits = Hasher(), np.frombuffer(coded, dtype=np.uint8)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    words = np.array([hashes[w] for w in words_of(value)], dtype=np.uint64)
                    for size in sizes:
                        codes = codes_of(words, size)
                        at = bit_of(codes)
                        starts = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                        found, first = np.unique(codes[starts], return_index=True)
                        for code, start in zip(found.view(np.int64).tolist(), starts[first].tolist(), strict=True):
                            rows.append((row, start, code, words[start : start + size].view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["_key", "first", "code", "words"],
                )

    schema = T.StructType(
        [
            T.StructField("_key", docs.schema[key].dataType),
            T.StructField("first", T.LongType()),
            T.StructField("code", T.LongType()),
            T.StructField("words", T.ArrayType(T.LongType())),
        ]
    )
    places = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(scan, schema)
    met = places.join(listed, "code").where(F.col("words") == F.col("_words"))
    none = F.lit(0).cast("long")
    n = F.size("words").cast("long")
    return met.select("_key", "item_id", none.alias("edits"), n.alias("n_words"), F.col("first").alias("first_word"), (F.col("first") + n).alias("last_word"))


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row for each document key and item that it holds: the best place of the item.

    Columns: the key, item_id, edits, n_words of the item, similarity, first_word and
    last_word (exclusive) of the stretch; of equal places the first. Items of fewer than
    ``LEAST_WORDS`` words are found where they stand word for word. Repeated rows and rows
    of one key count together, null keys are one key, null texts are empty. No items or no
    documents give no rows.
    """
    repeats = repetitions(recall)
    whole_index = stored(index_items(items, similarity, repeats), "benchmark")
    all_sizes = sorted(r["size"] for r in whole_index.select("size").distinct().collect())
    few, sizes = ([n for n in all_sizes if (n < LEAST_WORDS) == short] for short in (True, False))
    index = whole_index.where(F.col("size") >= LEAST_WORDS)
    pairs = pair_table(index, sizes) if sizes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    signed = bitmap(index.select(F.explode("signatures").alias("s")).select(F.pmod(F.col("s"), F.lit(BITS)).alias("bit")))

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner(sizes, pairs, signed, similarity, repeats)
        longs = pa.list_(pa.int64())
        for whole in batches:
            for batch in slices(whole, 1):
                found = scanner.regions(batch.column(1).to_pylist())
                keys = batch.column(0).take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([r[1] for r in found], pa.int32()),
                        pa.array([r[2] for r in found], pa.int64()),
                        pa.array([r[3].view(np.int64).tolist() for r in found], longs),
                        pa.array([r[4].view(np.int64).tolist() for r in found], longs),
                    ],
                    ["_key", "size", "first", "region", "signatures"],
                )

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, (first, region, words) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("first", "region", "words")), strict=True)
            ):
                inside = set(region)
                most = allowed(len(words), similarity)
                if sum(w not in inside for w in words) > most:
                    continue  # each absent word costs an edit
                edits, a, b = best_match(words, region)
                if edits <= most:
                    rows.append((i, edits, len(words), first + a, first + b))
            places = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(places),
                    batch.column("item_id").take(places),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4)),
                ],
                ["_key", "item_id", "edits", "n_words", "first_word", "last_word"],
            )

    key_type, item_type = docs.schema[key].dataType, items.schema["item_id"].dataType
    longs = T.ArrayType(T.LongType())
    region_schema = T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("size", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("region", longs),
            T.StructField("signatures", longs),
        ]
    )
    regions = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(scan, region_schema)
    by_signature = index.select("item_id", "size", "words", F.explode("signatures").alias("signature"))
    met = (
        regions.select("_key", "size", "first", "region", F.explode("signatures").alias("signature"))
        .join(by_signature, ["size", "signature"])
        .groupBy("_key", "size", "first", "region", "item_id", "words")
        .agg(F.count("*").alias("n"))
    )
    match_schema = T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("item_id", item_type),
            *(T.StructField(c, T.LongType()) for c in ("edits", "n_words", "first_word", "last_word")),
        ]
    )
    matches = met.select("_key", "item_id", "first", "region", "words").mapInArrow(verify, match_schema)
    if few:
        matches = matches.unionByName(short_leaks(docs, whole_index, key, text, few))
    best = matches.groupBy("_key", "item_id").agg(F.min(F.struct("edits", "first_word", "last_word", "n_words")).alias("m"))
    return best.select(
        F.col("_key").alias(key),
        "item_id",
        "m.edits",
        "m.n_words",
        (1 - F.col("m.edits") / F.col("m.n_words")).alias("similarity"),
        "m.first_word",
        "m.last_word",
    )


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item and its place."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
