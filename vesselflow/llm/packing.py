"""Training sequences of fixed length: all documents in one line of tokens, cut at fixed places.

A document is its token ids and an end id. The documents of a partition stand one after the
other, the partitions too, so a document's place in the whole line is the number of tokens
before its partition plus the number before it there. The first pass counts tokens by
partition, the second adds the counts up; then every document knows by arithmetic which
windows it lies in, and each stretch of a document in a window is a boundary record.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import slices, stored, table

LENGTH = 2048
#: Id behind the last token of every document.
END_ID = 1
PAD_ID = 0
#: Bytes of words that are looked up at once, words that a worker remembers at most (about 60
#: bytes each), and bytes of a word above which it is not remembered.
GROUP_BYTES, REMEMBERED, LONG = 1 << 20, 1_500_000, 1024
#: An odd number, so it has an inverse among the numbers of 64 bits.
BASE = 0x9E3779B97F4A7C15
#: Partitions whose first places (16 bytes each) are sent to all executors; more are joined.
MOST_SENT = 2_000_000
#: Partitions that are added up in one group.
GROUP = 1000


def tokenizer_file() -> str:
    """The public byte-level tokenizer, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Letters 1, digits 2, other printable signs 3, apostrophe 4, blank 5, other white space 6, else 0."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[0x21:0x7F] = 3
    kinds[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[ord("'")] = 4
    kinds[32], kinds[9:14] = 5, 6
    return kinds


def _borders() -> np.ndarray:
    """Pairs of classes (16 * left + right) between which no token of the byte-level pattern reaches.

    Letters, digits and other signs make separate tokens, but an apostrophe may belong to
    the letters behind it; white space belongs to what follows, so only its left end parts."""
    parts = np.zeros(256, dtype=bool)
    for left, right in [(1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)]:
        parts[16 * left + right] = True
    for left in (1, 2, 3, 4):
        parts[[16 * left + 5, 16 * left + 6]] = True
    return parts


class Tokens:
    """Ids of texts by the ``tokenizers`` library, each different word of a worker looked up once.

    Texts are cut where no token can reach over: between signs of different classes, all
    ASCII, and before white space. So the ids of a text are those of its words one after the
    other. Words are told apart by a rolling hash, and every occurrence is compared with the
    word that the ids are of, byte by byte. Only words not seen before go to the library,
    many at a time. A text with the name of a special token is one word, and so is every
    text if the file names another way to cut than byte-level tokens do.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before = described.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuttable = bool(plain and not described.get("normalizer"))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kinds, self.parts = _classes(), _borders()
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(GROUP_BYTES + LONG, BASE, dtype=np.uint64))
            inverse = np.cumprod(np.full(GROUP_BYTES + LONG, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        one = np.ones(1, dtype=np.uint64)
        self.powers, self.inverse = np.concatenate([one, powers]), np.concatenate([one, inverse])
        self._forget()

    def _forget(self) -> None:
        """Known words: their hashes in order with their numbers, bytes and ids."""
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.bytes, self.byte_ends = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.id_ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ends of the words of all texts; ``ends`` are those of the texts."""
        if not self.cuttable or not len(data):
            return np.unique(ends)
        kind = self.kinds[data]
        parted = np.zeros(len(data) + 1, dtype=bool)
        parted[1:-1] = self.parts[16 * kind[:-1] + kind[1:]]
        # Before white space behind a letter outside of ASCII: its first byte tells that it is no
        # white space itself, which has first bytes C2, E1, E2, E3 and EF.
        spaces = np.flatnonzero((kind >= 5)[1:] & (data[:-1] >= 0x80)) + 1
        second, third, fourth = (np.where(spaces >= k, data[np.maximum(spaces - k, 0)], 0) for k in (2, 3, 4))
        sure = (second >= 0xC3) & (second <= 0xDF) | (third == 0xE0) | (third >= 0xE4) & (third <= 0xEE) | (fourth >= 0xF0)
        parted[spaces[sure]] = True
        parted[ends] = True
        # A single line end or tab between words is a token of its own; a blank is not.
        alone = np.flatnonzero((kind[:-1] == 6) & (kind[1:] >= 1) & (kind[1:] <= 4) & (parted[:-2] | (np.arange(len(data) - 1) == 0)))
        parted[alone + 1] = True
        for name in self.special:
            self._join_whole(data, ends, parted, name)
        return np.flatnonzero(parted)

    @staticmethod
    def _join_whole(data: np.ndarray, ends: np.ndarray, parted: np.ndarray, name: bytes) -> None:
        """No cut inside a text that has the name of a special token."""
        view, at = memoryview(data).tobytes(), 0
        while (at := view.find(name, at)) >= 0:
            text = int(np.searchsorted(ends, at, "right"))
            start, at = int(ends[text - 1]) if text else 0, int(ends[text])
            parted[start + 1 : at] = False

    def _library_ids(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = self._library_ids(words)
        numbers = len(self.id_ends) - 1 + np.arange(len(words))
        order = np.searchsorted(self.hashes, hashes)
        # All at once: a task that fails here leaves what is known as it was.
        self.bytes, self.byte_ends, self.ids, self.id_ends, self.hashes, self.numbers = (
            np.concatenate([self.bytes, np.frombuffer(b"".join(words), dtype=np.uint8)]),
            np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(w) for w in words])]),
            np.concatenate([self.ids, np.array(list(chain.from_iterable(found)), dtype=np.uint32)]),
            np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(f) for f in found])]),
            np.insert(self.hashes, order, hashes),
            np.insert(self.numbers, order, numbers),
        )

    def _short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie within ``data``, and their numbers of ids."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + 1) * self.powers[: len(data)])])
            # The length sets apart words whose sums are alike, as far as it can.
            hashes = (sums[starts + sizes] - sums[starts]) * self.inverse[starts] ^ sizes.astype(np.uint64)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        new = np.ones(len(different), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != different[inside]
        if new.any():
            begins, lengths = starts[first[new]].tolist(), sizes[first[new]].tolist()
            self._learn(different[new], [data[b : b + n].tobytes() for b, n in zip(begins, lengths, strict=True)])
            at = np.searchsorted(self.hashes, different)
        number = self.numbers[at][which]
        known_start = self.byte_ends[number]
        alike = self.byte_ends[number + 1] - known_start == sizes
        both = np.where(alike, sizes, 0)
        shift = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        same = data[np.repeat(starts, both) + shift] == self.bytes[np.repeat(known_start, both) + shift]
        if not alike.all() or not same.all():
            # Two words with one hash: such a group goes to the library word by word.
            found = self._library_ids([data[b : b + n].tobytes() for b, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
            return np.array([i for f in found for i in f], dtype=np.uint32), np.array([len(f) for f in found], dtype=np.int64)
        counts = self.id_ends[number + 1] - self.id_ends[number]
        shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(self.id_ends[number], counts) + shift], counts

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand one after the other in ``data``, and the ends of each text's ids."""
        cuts = self._cuts(data, ends)
        cuts = cuts[cuts > 0]
        starts = np.concatenate([np.zeros(1, dtype=np.int64), cuts[:-1]])[: len(cuts)]
        sizes = cuts - starts
        # Long words and groups of short ones, in their order.
        turn = np.concatenate([np.flatnonzero(sizes > LONG), [len(sizes)]]).tolist()
        parts, counts, at = [], [], 0

        def short(begin: int, end: int) -> None:
            while begin < end:
                stop = max(begin + 1, int(np.searchsorted(cuts[:end], starts[begin] + GROUP_BYTES, "right")))
                low, high = int(starts[begin]), int(cuts[stop - 1])
                ids, number = self._short(data[low:high], starts[begin:stop] - low, sizes[begin:stop])
                parts.append(ids)
                counts.append(number)
                begin = stop

        for long in turn:
            short(at, long)
            if long < len(sizes):
                (ids,) = self._library_ids([data[starts[long] : cuts[long]].tobytes()])
                parts.append(np.array(ids, dtype=np.uint32))
                counts.append(np.array([len(ids)], dtype=np.int64))
            at = long + 1
        totals = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *counts]))])
        return np.concatenate([np.zeros(0, dtype=np.uint32), *parts]), totals[np.searchsorted(cuts, ends, "right")]

    def of(self, texts: list[str]) -> list[list[int]]:
        """Ids of some texts, as lists."""
        encoded = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        ids, ends = self(data, np.cumsum([len(e) for e in encoded], dtype=np.int64))
        return [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []


def kept_tokens(path: str) -> Tokens:
    """The tokenizer of this Python worker, with the words that earlier tasks looked up."""
    import sys
    import types

    kept = sys.modules.setdefault("words_of_earlier_tasks", types.ModuleType("words_of_earlier_tasks"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.tokens = path, Tokens(path)
    return kept.tokens


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text column and the ends of its texts; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: (part, local, doc_id, n, ids) per document, written to the shared folder.

    ``part`` is the partition that the document was read in, ``local`` the number of tokens
    before it there, ``ids`` little-endian numbers of 16 bits, or of 32 if a vocabulary has
    more than 65,536 ids. Texts are turned into tokens once; what is written counts, so a
    lost executor cannot change the order afterwards. Null and empty texts have the end id
    alone, repeated rows count each.
    """
    path = path or tokenizer_file()
    number = _number(path, end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, part, local = kept_tokens(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                found, ends = tokens(*_flat(batch.column(1)))
                # The end id of each text goes in behind its own ids.
                ids = np.insert(found, ends, end_id).astype(number)
                counts = np.diff(ends, prepend=0) + 1
                ends = np.cumsum(counts)
                offsets = pa.py_buffer(np.concatenate([[0], ends * number.itemsize]).astype(np.int64))
                binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, dtype=np.int64)),
                        pa.array(local + ends - counts),
                        batch.column(0),
                        pa.array(counts),
                        binary.cast(pa.binary()),
                    ],
                    ["part", "local", "doc_id", "n", "ids"],
                )
                local += int(ends[-1])

    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("local", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


def _number(path: str, end_id: int) -> np.dtype:
    """The narrowest type for the ids of a vocabulary."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return np.dtype("<u4" if most >= 1 << 16 else "<u2")


def part_starts(tokens: DataFrame) -> DataFrame:
    """Second pass: (part, before), the tokens before each partition.

    Counts are added up within groups of partitions and then over the groups, so no task
    sees more rows than a group has partitions, or than there are groups."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"part div {GROUP}"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("n").alias("n"))
    first = groups.select("group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    local = totals.select("part", "group", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return local.join(first, "group").select("part", (F.col("first") + F.col("inside")).alias("before"))


class Windows:
    """Where sequences begin: one every ``length`` tokens; what is left at the end is cut into
    powers of two, the largest first, so that nothing needs padding."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        left, at, ends = total % length, self.full * length, []
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                ends.append(at)
                at += 1 << bit
        self.tail = np.array([*ends, total], dtype=np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Number of the sequence that a place lies in."""
        inside = np.searchsorted(self.tail, places, "right") - 1
        return np.where(places < self.full * self.length, places // self.length, self.full + inside)

    def start(self, sequences: np.ndarray) -> np.ndarray:
        late = np.clip(sequences - self.full, 0, len(self.tail) - 1)
        return np.where(sequences < self.full, sequences * self.length, self.tail[late])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Boundary records of all documents in sequences of at most ``length`` tokens.

    (doc_id, start, length, doc_tokens, sequence_id, offset, ids): the tokens of a document
    from ``start`` on, which stand in a sequence from ``offset`` on; ``ids`` are little-endian
    numbers of 32 bits. Each token lies in exactly one record, sequences have no gaps, and
    only the last ones are shorter, each a power of two. A null or empty text is the end id
    alone; a null or repeated doc_id is a document like any other; no rows give no records.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.

    Neither texts nor ids are shuffled: they are written once and read once, and a partition
    finds its first place in a table with one row per partition.
    """
    tokens = tokenized(docs, path, end_id)
    starts = stored(part_starts(tokens), "starts")
    parts = starts.count()
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if parts <= MOST_SENT:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, "part").select("doc_id", "n", (F.col("before") + F.col("local")).alias("at"), "ids")
    number = _number(path or tokenizer_file(), end_id)

    def run(batches):
        import pyarrow as pa

        windows = Windows(total, length)
        for whole in batches:
            for batch in slices(whole, 3):
                n, at = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
                first, last = windows.at(at), windows.at(at + n - 1)
                pieces = last - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = np.maximum(at[row], windows.start(sequence))
                end = np.minimum((at + n)[row], windows.start(sequence + 1))
                column, cut = batch.column(3), []
                for r, b, e in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
                    view = np.frombuffer(column[r].as_buffer(), dtype=number, count=e - b, offset=b * number.itemsize)
                    cut.append(view.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(begin - at[row]),
                        pa.array(end - begin),
                        pa.array(n[row]),
                        pa.array(sequence),
                        pa.array(begin - windows.start(sequence)),
                        pa.array(cut, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *[T.StructField(c, T.LongType()) for c in longs],
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """The sequences themselves: (sequence_id, ids, boundaries) from the records of :func:`pack`.

    ``ids`` is padded to ``length`` unless its own length is a power of two; ``boundaries``
    lists the records of the sequence by offset. One shuffle by sequence, whose records are
    at most ``length``."""
    record = F.struct("offset", "doc_id", "start", "length", "doc_tokens", "ids")
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(record)).alias("records"))
    boundaries = F.transform("records", lambda r: r.dropFields("ids"))
    # Binary values have no sum; their concatenation is an aggregate over the sorted records.
    joined = F.aggregate("records", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    rows = gathered.select("sequence_id", joined.alias("bytes"), boundaries.alias("boundaries"))
    plain = rows.schema["boundaries"].dataType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            arrays = []
            for value in batch.column(1).to_pylist():
                ids = np.frombuffer(value, dtype="<u4").astype(np.int32)
                if len(ids) & (len(ids) - 1):
                    ids = np.concatenate([ids, np.full(length - len(ids), pad_id, dtype=np.int32)])
                arrays.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(arrays, pa.list_(pa.int32())), batch.column(2)],
                ["sequence_id", "ids", "boundaries"],
            )

    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("boundaries", plain),
        ]
    )
    return rows.mapInArrow(run, schema)


def crc_of_ids(ids: str = "ids") -> Column:
    """CRC-32 of the ids as little-endian numbers of 32 bits."""
    return F.crc32(ids)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary records of all documents, their ids as a checksum."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", crc_of_ids().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
