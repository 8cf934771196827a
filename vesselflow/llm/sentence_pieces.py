"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The best segmentation of a text is the one whose pieces have the largest sum of scores.
Pieces contain the blank sign only at their beginning, so the search falls apart into
words: a run of blanks with what follows it. Distinct words of a batch that have equal
length stand in one matrix and advance together: for each end and each piece length, the
hashes of all their substrings are looked up among the sorted hashes of the pieces of that
length, and a maximum over the lengths stores the back-pointers of the whole matrix. A
found path is compared with its word, so a hash that two strings share cannot change a
result; such a word is searched again by the pieces themselves.

A character that no piece covers is written as its UTF-8 bytes. Decoding is exact for every
text, including one that contains the blank sign itself: it is written as bytes, too.

The given model files are byte-pair models read as unigram ones: pieces and scores are the
file's, and the segmentation is the one of largest total score (on ties, with the longest
last piece), as the format's own unigram search defines it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vesselflow.llm.common import slices, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Below the worst piece, what a character without a piece costs.
PENALTY = 10.0
#: Words up to this length share matrices; longer ones are searched one by one.
LONG = 192
#: Cells of one matrix.
CELLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    x = codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE))])


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the words in the rows of ``codes``."""
    mixed = _mix(codes)
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + mixed[:, k]
    return out


@dataclass
class PieceModel:
    """Pieces that occur in texts, the ids of single bytes, and the tables of the search."""

    pieces: list[str]
    scores: list[float]
    ids: list[int]
    byte_ids: list[int]
    total: int
    prefix: bool = True
    tables: dict = field(init=False, repr=False)
    covered: set = field(init=False, repr=False)

    def __post_init__(self):
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece continues over a blank; words cannot be searched on their own")
        self.longest = max(map(len, self.pieces))
        self.by_text = {p: (s, i) for p, s, i in zip(self.pieces, self.scores, self.ids, strict=True)}
        self.unknown = min(self.scores) - PENALTY
        self.powers = _powers(self.longest)
        self.tables = {}
        for length in sorted({len(p) for p in self.pieces}):
            own = [k for k, p in enumerate(self.pieces) if len(p) == length]
            codes = np.stack([_codes(self.pieces[k]) for k in own])
            keys = _prefix_hashes(codes)[:, -1]
            order = np.argsort(keys, kind="stable")
            self.tables[length] = (
                keys[order],
                np.array([self.scores[own[k]] for k in order]),
                np.array([self.ids[own[k]] for k in order], dtype=np.int32),
            )
        self.covered = {c for p in self.pieces for c in p} | {" "}
        # No piece has a line break in it, so it bounds words as a blank does.
        self.splitter = re.compile(" *[^ ]+| +" if "\n" in self.covered else "\n| *[^ \n]+| +")
        self.spelled: list[bytes] = [b""] * self.total
        for p, i in zip(self.pieces, self.ids, strict=True):
            self.spelled[i] = p.replace(BLANK, " ").encode()
        for value, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([value])


def load_model(path: str = MODEL_FILE) -> PieceModel:
    """Read a model file with byte fallback and without normalisation."""
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=path)
    size = source.get_piece_size()
    usual = [
        i
        for i in range(size)
        if not (source.is_control(i) or source.is_unknown(i) or source.is_byte(i) or source.is_unused(i))
    ]
    byte_ids = [source.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(source.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no pieces for single bytes")
    if source.normalize("a  ①") not in (BLANK + "a" + BLANK * 2 + "①", "a" + BLANK * 2 + "①"):
        raise ValueError("the model normalises texts, so decoding could not give them back")
    return PieceModel(
        [source.id_to_piece(i) for i in usual],
        [source.get_score(i) for i in usual],
        usual,
        byte_ids,
        size,
        source.normalize("a").startswith(BLANK),
    )


def _lookup(model: PieceModel, length: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of the pieces of this length; minus infinity and -1 where there is none."""
    known, scores, ids = model.tables[length]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, scores[at], -np.inf), np.where(hit, ids[at], -1).astype(np.int32)


def viterbi(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of the words, all of one length of at least 1: ids side by side, and
    how many each word has. -1 stands for a character without a piece."""
    n, length = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, length)
    hashes = np.ascontiguousarray(_prefix_hashes(codes).T)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), dtype=np.int32)
    chosen = np.zeros((length + 1, n), dtype=np.int32)
    rows = np.arange(n)
    for end in range(1, length + 1):
        sizes = [k for k in sorted(model.tables, reverse=True) if k <= end]
        totals = np.empty((len(sizes), n))
        ids = np.empty((len(sizes), n), dtype=np.int32)
        for j, k in enumerate(sizes):
            keys = hashes[end] - hashes[end - k] * model.powers[k]
            score, ids[j] = _lookup(model, k, keys)
            if k == 1:
                score = np.where(ids[j] < 0, model.unknown, score)
            np.add(best[end - k], score, out=totals[j])
        top = np.argmax(totals, axis=0)
        best[end] = totals[top, rows]
        back[end] = end - np.array(sizes, dtype=np.int32)[top]
        chosen[end] = ids[top, rows]
    steps, at = [], np.full(n, length, dtype=np.int32)
    while at.any():
        steps.append(np.where(at > 0, chosen[at, rows], -2))
        at = np.where(at > 0, back[at, rows], 0)
    paths = np.stack(steps[::-1], axis=1)
    used = paths != -2
    return paths[used], used.sum(axis=1)


def viterbi_exact(model: PieceModel, word: str) -> np.ndarray:
    """The same for one word of any length, by the pieces themselves."""
    n = len(word)
    best, back, chosen = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
    by_text, longest, unknown = model.by_text, model.longest, model.unknown
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            found = by_text.get(word[start:end])
            if found is None:
                if start < end - 1:
                    continue
                found = (unknown, -1)
            total = best[start] + found[0]
            if total > best[end]:
                best[end], back[end], chosen[end] = total, start, found[1]
    out, at = [], n
    while at:
        out.append(chosen[at])
        at = back[at]
    return np.array(out[::-1], dtype=np.int32)


def _spelled(model: PieceModel, word: str, path: list[int]) -> list[int] | None:
    """Ids with bytes for uncovered characters; None if the path does not spell the word."""
    out, at = [], 0
    for piece in path:
        if piece < 0:
            out += [model.byte_ids[b] for b in word[at].encode()]
            at += 1
        else:
            size = len(model.spelled[piece].decode())
            if model.spelled[piece] != word[at : at + size].replace(BLANK, " ").encode():
                return None
            out.append(piece)
            at += size
    return out if at == len(word) else None


def _encode_group(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers for words of one length."""
    if len(words[0]) > LONG:
        paths = [_spelled(model, w, viterbi_exact(model, w).tolist()) for w in words]
        return np.array([i for p in paths for i in p], np.int32), np.array([len(p) for p in paths])
    ids, counts = viterbi(model, words)
    # Pieces have the lengths of their tables, so one comparison of all words checks each.
    if (ids >= 0).all():
        if b"".join(map(model.spelled.__getitem__, ids.tolist())) == "".join(words).replace(BLANK, " ").encode():
            return ids, counts
    ends = np.cumsum(counts)
    paths = []
    for word, a, b in zip(words, (ends - counts).tolist(), ends.tolist(), strict=True):
        path = _spelled(model, word, ids[a:b].tolist())
        paths.append(_spelled(model, word, viterbi_exact(model, word).tolist()) if path is None else path)
    return np.array([i for p in paths for i in p], np.int32), np.array([len(p) for p in paths])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Encoder:
    """Encodes texts; words met before in the task are not searched again."""

    def __init__(self, model: PieceModel, most_words: int = 300_000):
        self.model, self.most = model, most_words
        self._forget()

    def _forget(self) -> None:
        """Known words and where their ids stand; the first entry is the blank sign in bytes."""
        sign = [self.model.byte_ids[b] for b in BLANK.encode()]
        self.known: dict[str | None, int] = {None: 0}
        self.ids = np.array(sign, dtype=np.int32)
        self.begins, self.counts = np.zeros(1, np.int64), np.array([len(sign)])

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        parts, counts, order = [self.ids], [self.counts], []
        for length, own in by_length.items():
            size = max(1, CELLS // (length * (len(self.model.tables) + 4)))
            covered: dict[bool, list[str]] = {}
            for word in own:
                covered.setdefault(self.model.covered.issuperset(word), []).append(word)
            for group in covered.values():
                for at in range(0, len(group), size):
                    words_here = group[at : at + size]
                    ids, n = _encode_group(self.model, [w.replace(" ", BLANK) for w in words_here])
                    parts.append(ids)
                    counts.append(n)
                    order += words_here
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        self.ids, self.counts = np.concatenate(parts), np.concatenate(counts)
        self.begins = np.cumsum(self.counts) - self.counts

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and how many each text has."""
        split = []
        for text in texts:
            text = text or ""
            if self.model.prefix and text:
                text = " " + text
            parts = text.split(BLANK)
            words: list[str | None] = self.model.splitter.findall(parts[0])
            for part in parts[1:]:
                words.append(None)
                words += self.model.splitter.findall(part)
            split.append(words)
        distinct = set().union(*split)
        fresh = distinct - self.known.keys()
        if len(self.known) + len(fresh) > self.most:
            self._forget()
            fresh = distinct - self.known.keys()
        if fresh:
            self._learn(sorted(fresh))
        sizes = [len(words) for words in split]
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, count=sum(sizes))
        counts = self.counts[places]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)] if sizes else np.zeros(0, np.int64)
        return self.ids[_ranges(self.begins[places], counts)], np.diff(ends, prepend=0)


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text of a sequence of ids; bytes that are no UTF-8 become replacement signs."""
    spelled = b"".join(map(model.spelled.__getitem__, ids))
    if model.prefix and spelled[:1] == b" ":
        spelled = spelled[1:]
    return spelled.decode("utf-8", "replace")


class Decoder:
    """Decodes sequences of ids that stand side by side, all at once."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.sizes = np.array([len(s) for s in model.spelled], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(model.spelled), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        sizes = self.sizes[ids]
        spelled = self.bytes[_ranges(self.begins[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        out = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            skip = self.model.prefix and spelled[a : a + 1] == b" " and a < b
            out.append(spelled[a + skip : b].decode("utf-8", "replace"))
        return out


def encode_pieces(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and their ids; a null or empty text has none. No row moves.

    A column of that name is replaced. Repeated rows give repeated rows."""
    docs = docs.drop(ids)
    columns = docs.columns
    at = columns.index(text)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(model)
        for whole in batches:
            for batch in slices(whole, at):
                values, counts = encoder(batch.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*columns, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_pieces(encoded: DataFrame, model: PieceModel, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and their texts; null ids give an empty text."""
    encoded = encoded.drop(decoded)
    columns = encoded.columns
    at = columns.index(ids)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        decoder = Decoder(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                column = batch.column(at)
                counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
                made = decoder(np.asarray(column.flatten(), dtype=np.int64), counts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*columns, decoded])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded, T.StringType())]))


def encoded_documents(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, number of ids, whether they decode to the whole text, and the ids.

    Encoded and decoded in one visit, so texts and ids do not travel once more."""
    model = load_model(model_file)

    def run(batches):
        import pyarrow as pa

        encoder, decoder = Encoder(model), Decoder(model)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                values, counts = encoder(texts)
                equal = [d == (t or "") for d, t in zip(decoder(values, counts), texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(equal), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "round_trip", "ids"])

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("round_trip", T.BooleanType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encoded_documents(table(spark, sf_dir, "documents"))
