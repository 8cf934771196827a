"""Repeated strings across documents, by prefix-free parsing and suffix order.

Every 50-byte string that also starts in a document with a smaller id is removed. Texts are
parsed into phrases by a rolling hash: the trigger of a 50-byte window is the smallest hash
among its 20-byte strings, and windows in a row with the same trigger are one phrase,
together with the bytes up to the end of the last window. Equal windows have equal
triggers wherever they stand, so a text and its copy are cut alike, and only phrases with
the same trigger can share a window.

1. *Parse.* Documents are dealt into chunks. A chunk turns its phrases into a dictionary of
   distinct ones with the smallest id of each.
2. *Dictionary.* Phrases meet by trigger. Of equal phrases the smallest id wins, and all
   windows of the others are known to be repeated. Only triggers with different phrases of
   different documents, the ends of repeated passages for the most part, need more.
3. *Suffix order.* Those phrases are fetched with their bytes. Their suffixes of 50 bytes
   are sorted, so equal windows stand side by side, and the smallest id of each is found.
4. *Corpus order.* Answers go back to the chunks, which hold the texts: the parse places
   the windows in their documents, and covered bytes are cut out.

The suffix array of the parse, which prefix-free parsing combines with that of the dictionary
into the order of the corpus, is left out: grouping by trigger and sorting windows of fixed
length tell the smallest id of each window, and nothing else is asked for.

Nothing is compared by all pairs, and no row is sent for a repeated phrase of a chunk but
one. A trigger with very many phrases in a chunk (the end of a line that a third of all
documents has) sends one mark, and its windows are dealt by their own hash instead of by
the trigger, so they spread over all tasks. Chunks and dictionary parts have bounded size;
their number follows the input. The texts are shuffled once; the plan reuses that exchange
for all three visits to them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm.common import table

LENGTH = 50
GRAM = 20
#: Distinct phrases of one trigger in a chunk, and in a dictionary part, that make it crowded.
CROWDED_HERE, CROWDED = 32, 2048
CHUNK_BYTES = 3 << 20
PART_BYTES = 8 << 20
#: Bytes of a phrase's row for each byte of text, measured.
ROW_BYTES_PER_BYTE = 1.6
SLICE = 1 << 15
_FACTOR = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, k, 2**64))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of each 20-byte string, from those of 1, 2, 4, 8 and 16 bytes."""
    part = _TABLE[data]
    by_size = {1: part}
    for size in (1, 2, 4, 8):
        joined = part[:-size] * _power(size)
        joined += part[size:]
        by_size[2 * size] = part = joined
    n = len(data) - GRAM + 1
    whole = by_size[16][:n] * _power(4)
    whole += by_size[4][16 : 16 + n]
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(0xD6E8FEB86659FD93)
    whole ^= whole >> np.uint64(32)
    return whole


def triggers(data: np.ndarray) -> np.ndarray:
    """The smallest hash of the 20-byte strings in each window of 50 bytes."""
    width = LENGTH - GRAM + 1
    least = _rolling(data)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Chunk:
    """Documents side by side in one buffer, their phrases, and the dictionary of these.

    Rows are put in the order of (id, text), so every visit numbers phrases alike. Phrases of
    documents with a null id are not parsed: null is neither smaller nor larger."""

    def __init__(self, rows):
        import xxhash

        ids = rows.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.raw = b"".join(self.texts)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        data = np.frombuffer(self.raw, dtype=np.uint8)
        starts, found = [], []
        n = len(data) - LENGTH + 1
        for at in range(0, max(n, 0), SLICE):
            own = triggers(data[at : min(at + SLICE, n) + LENGTH - 1])
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            starts.append(cut + at)
            found.append(own[cut])
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        trigger = np.concatenate(found) if found else np.zeros(0, np.uint64)
        # Runs are cut where documents begin and where the last window of one ends.
        known = np.array([i is not None for i in self.ids], dtype=bool)
        long = known & (sizes >= LENGTH)
        edges = np.concatenate([self.begins[long], self.ends[long] - LENGTH + 1])
        where = np.searchsorted(start, edges, side="right") - 1
        inside = edges < n
        cuts, at = np.unique(np.concatenate([start, edges[inside]]), return_index=True)
        trigger = np.concatenate([trigger, trigger[where[inside]]])[at]
        stops = np.concatenate([cuts[1:], [max(n, 0)]])
        owner = np.searchsorted(self.ends, cuts, side="right")
        owner = np.minimum(owner, max(0, len(sizes) - 1))
        whole = long[owner] & (cuts >= self.begins[owner]) & (stops + LENGTH - 1 <= self.ends[owner]) if len(cuts) else np.zeros(0, bool)
        cuts, trigger, stops, owner = cuts[whole], trigger[whole], stops[whole], owner[whole]
        # A run that a slice boundary cut is one phrase.
        same = (cuts[1:] == stops[:-1]) & (trigger[1:] == trigger[:-1]) & (owner[1:] == owner[:-1])
        first = np.concatenate([[True], ~same]) if len(cuts) else np.zeros(0, bool)
        last = np.concatenate([~same, [True]]) if len(cuts) else np.zeros(0, bool)
        self.start, self.stop, self.owner = cuts[first], stops[last], owner[first]
        key, raw, digest = _scramble(trigger[first]), self.raw, xxhash.xxh3_64_intdigest
        spans = zip(self.start.tolist(), (self.stop + LENGTH - 1).tolist(), strict=True)
        phrase = np.fromiter((digest(raw[a:b]) for a, b in spans), dtype=np.uint64, count=len(key))
        doc = np.array([i if i is not None else 0 for i in self.ids], dtype=np.int64)
        self.doc = doc[self.owner] if len(key) else np.zeros(0, np.int64)
        # The dictionary: entries by (key, phrase), each with its first occurrence.
        order = np.lexsort((self.start, self.doc, phrase, key))
        k, p = key[order], phrase[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]) if len(k) else np.zeros(0, bool)
        self.key, self.phrase, self.first = k[new], p[new], order[new]
        self.entry = np.empty(len(k), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.least = self.doc[self.first]
        self.group = np.cumsum(np.concatenate([[True], self.key[1:] != self.key[:-1]])) - 1 if len(self.key) else np.zeros(0, np.int64)
        self.crowded = np.bincount(self.group, minlength=1)[self.group] > CROWDED_HERE if len(self.key) else np.zeros(0, bool)

    def bytes_of(self, entry: int) -> bytes:
        at = self.first[entry]
        return self.raw[self.start[at] : self.stop[at] + LENGTH - 1]

    def crowded_windows(self, marked: np.ndarray):
        """Distinct windows of the entries of crowded triggers, in order: (window bytes,
        smallest id, and for each entry its windows as places in that order)."""
        entries = np.union1d(np.flatnonzero(self.crowded), marked).astype(np.int64)
        at = self.first[entries]
        counts = self.stop[at] - self.start[at]
        if not len(entries):
            return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), entries, np.zeros(0, np.int64), counts
        windows = _windows(np.frombuffer(self.raw, np.uint8), _ranges(self.start[at], counts))
        place, order, new = _ranked(windows)
        docs = np.repeat(self.least[entries], counts)
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        return windows[order][new], least, entries, place, counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def _windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts]


def _ranked(windows: np.ndarray):
    """Place of each window among the distinct ones, the sorting order, and where a new one begins in it."""
    flat = np.ascontiguousarray(windows).view(f"V{LENGTH}").ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(flat), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order, new


def _pack(*arrays: np.ndarray) -> bytes:
    """Lengths, then arrays; their first bytes together, then the second ones and so on.

    High bytes are alike among neighbours, so most planes compress well."""
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


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys, so sorted entries of a part are neighbours."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(part: np.ndarray):
    """(part, from, to) of the stretches of a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), a, b


def _messages(rows, names):
    import pyarrow as pa

    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
    return pa.Table.from_arrays(columns, names)


def _parse(parts: int):
    """Chunk to dictionary parts: keys, phrases, smallest ids; crowded triggers as marks."""

    def run(key, rows):
        chunk = Chunk(rows)
        out = []
        part = _part_of(chunk.key, parts)
        for p, a, b in _by_part(part):
            light = np.flatnonzero(~chunk.crowded[a:b]) + a
            heavy = np.flatnonzero(chunk.crowded[a:b]) + a
            first = heavy[np.concatenate([[True], chunk.key[heavy[1:]] != chunk.key[heavy[:-1]]])] if len(heavy) else heavy
            marks = np.minimum.reduceat(chunk.least[heavy], np.searchsorted(heavy, first)) if len(heavy) else np.zeros(0, np.int64)
            steps = np.diff(light, prepend=0).astype("<u4")
            payload = _pack(chunk.key[light], chunk.phrase[light], chunk.least[light], steps, chunk.key[first], marks)
            out.append((p, key[0].as_py(), payload))
        return _messages(out, ["part", "chunk", "data"])

    return run


def _settle(key, rows):
    """Dictionary part to answers for its chunks: smaller ids of equal phrases, and entries to fetch."""
    chunks, own = rows.column("chunk").to_pylist(), []
    for data in rows.column("data"):
        own.append(_unpack(data.as_py(), "<u8", "<u8", "<i8", "<u4", "<u8", "<i8"))
        own[-1][3] = np.cumsum(own[-1][3], dtype=np.uint32)
    k, p, least, entry = (np.concatenate([o[i] for o in own]) for i in range(4))
    at = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
    marked = np.unique(np.concatenate([o[4] for o in own]))
    order = np.lexsort((np.array(chunks)[at], least, p, k))
    k, p, least, entry, at = k[order], p[order], least[order], entry[order], at[order]
    if not len(k):
        return _messages([], ["chunk", "part", "data"])
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
    firsts = np.flatnonzero(new)
    smallest = least[firsts][np.cumsum(new) - 1]
    repeated = smallest < least
    fk, fl = k[firsts], least[firsts]
    group_new = np.concatenate([[True], fk[1:] != fk[:-1]])
    groups = np.flatnonzero(group_new)
    member = np.cumsum(group_new) - 1
    low, high = np.minimum.reduceat(fl, groups), np.maximum.reduceat(fl, groups)
    size = np.diff(np.concatenate([groups, [len(fk)]]))
    mark = np.isin(fk[groups], marked)
    unsettled = ((low < high) | mark)[member]
    crowded = ((size > CROWDED) | mark)[member]
    out = []
    fetch = np.zeros(len(k), dtype=np.uint8)
    # Rows of one id may lie in several chunks; each has its own windows to lose.
    which, least_here = np.cumsum(new) - 1, ~repeated
    fetch[least_here & unsettled[which]] = 1
    fetch[least_here & (unsettled & crowded)[which]] = 2
    told = np.flatnonzero(repeated | (fetch > 0))
    told = told[np.argsort(at[told], kind="stable")]
    for c, a, b in _by_part(at[told]):
        own_rows = told[a:b]
        r, f = own_rows[repeated[own_rows]], own_rows[fetch[own_rows] > 0]
        out.append((chunks[c], key[0].as_py(), _pack(entry[r], smallest[r], entry[f], fetch[f])))
    return _messages(out, ["chunk", "part", "data"])


def _answers(rows):
    """All answers to a chunk: repeated entries with their smaller ids, entries to fetch, crowded ones."""
    own = [_unpack(d.as_py(), "<u4", "<i8", "<u4", "u1") for d in rows.column("data")]
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    entry, smaller, fetch, how = (np.concatenate([o[i] for o in own]) for i in range(4))
    return entry.astype(np.int64), smaller, np.sort(fetch[how == 1]).astype(np.int64), np.sort(fetch[how == 2]).astype(np.int64)


def _fetch(parts: int):
    """Chunk and answers to unsettled phrases with their bytes, dealt by trigger, or by window if crowded."""

    def run(key, rows, answers):
        import xxhash

        out = []
        if rows.num_rows and (rows.num_rows > 0):
            _, _, wanted, crowded = _answers(answers)
            chunk = Chunk(rows)
            for p, a, b in _by_part(_part_of(chunk.key[wanted], parts)):
                own = wanted[a:b]
                words = [chunk.bytes_of(e) for e in own.tolist()]
                sizes = np.array([len(w) for w in words], dtype="<u4")
                out.append((p, key[0].as_py(), _pack(own.astype("<u4"), chunk.least[own], sizes, np.frombuffer(b"".join(words), np.uint8), np.zeros(1, np.uint8))))
            windows, least, _, _, _ = chunk.crowded_windows(crowded)
            if len(windows):
                hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.tobytes()) for w in windows), np.uint64, count=len(windows))
                part = _part_of(_scramble(hashed), parts)
                order = np.argsort(part, kind="stable")
                for p, a, b in _by_part(part[order]):
                    own = order[a:b]
                    sizes = np.full(len(own), LENGTH, dtype="<u4")
                    out.append((p, key[0].as_py(), _pack(own.astype("<u4"), least[own], sizes, windows[own].ravel(), np.ones(1, np.uint8))))
        return _messages(out, ["part", "chunk", "data"])

    return run


def _sort_suffixes(key, rows):
    """Phrases to the windows of each that a smaller id has: all suffixes of the part, in order."""
    chunks, own = rows.column("chunk").to_pylist(), []
    for data in rows.column("data"):
        own.append(_unpack(data.as_py(), "<u4", "<i8", "<u4", "u1", "u1"))
    entry, least, sizes, data = (np.concatenate([o[i] for o in own]) for i in range(4))
    at = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
    crowded = np.array([o[4][0] for o in own], dtype=bool)
    sizes = sizes.astype(np.int64)
    begins, counts = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    _, order, new = _ranked(_windows(data, _ranges(begins, counts)))
    phrase = np.repeat(np.arange(len(entry)), counts)
    offset = _ranges(np.zeros(len(counts), np.int64), counts)
    docs = least[phrase]
    smallest = np.empty(len(docs), dtype=np.int64)
    smallest[order] = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.flatnonzero(smallest < docs)
    out = []
    for c, a, b in _by_part(at[phrase[hit]]):
        w = hit[a:b]
        out.append((chunks[c], key[0].as_py(), _pack(entry[phrase[w]], offset[w].astype("<u4"), smallest[w], crowded[c : c + 1].astype(np.uint8))))
    return _messages(out, ["chunk", "part", "data"])


def _cut(key, rows, answers):
    """Chunk and all answers to its documents without the covered bytes."""
    import pyarrow as pa

    if not rows.num_rows:
        return _documents([])
    is_first = np.array(answers.column("step").to_pylist()) == 1 if answers.num_rows else np.zeros(0, bool)
    first, second = answers.filter(pa.array(is_first)), answers.filter(pa.array(~is_first))
    entry, smaller, _, crowded = _answers(first)
    chunk = Chunk(rows)
    least = chunk.least.copy()
    np.minimum.at(least, entry, smaller)
    whole = np.flatnonzero(chunk.doc > least[chunk.entry]) if len(chunk.doc) else np.zeros(0, np.int64)
    lows, highs = [chunk.start[whole]], [chunk.stop[whole]]
    light, by_window = [], []
    for data in second.column("data"):
        e, o, s, kind = _unpack(data.as_py(), "<u4", "<u4", "<i8", "u1")
        (by_window if kind[0] else light).append((e.astype(np.int64), o.astype(np.int64), s))
    # Only occurrences in the document that an entry was asked for can still be open; the others are gone.
    open_places = np.flatnonzero(chunk.doc == chunk.least[chunk.entry]) if len(chunk.doc) else np.zeros(0, np.int64)
    by_entry = open_places[np.argsort(chunk.entry[open_places], kind="stable")]
    sorted_entries = chunk.entry[by_entry]

    def remove(entries, offsets):
        """Windows at these offsets in every open occurrence of these entries."""
        a, b = np.searchsorted(sorted_entries, entries), np.searchsorted(sorted_entries, entries, side="right")
        places = by_entry[_ranges(a, b - a)]
        low = chunk.start[places] + np.repeat(offsets, b - a)
        lows.append(low)
        highs.append(low + 1)

    for e, o, _ in light:
        remove(e, o)
    windows, window_least, entries, place, counts = chunk.crowded_windows(crowded)
    if len(windows):
        for r, _, s in by_window:
            np.minimum.at(window_least, r, s)
        hit = window_least[place] < np.repeat(chunk.least[entries], counts)
        offsets = _ranges(np.zeros(len(counts), np.int64), counts)
        remove(np.repeat(entries, counts)[hit], offsets[hit])
    low, high = np.concatenate(lows), np.concatenate(highs)
    change = np.zeros(len(chunk.raw) + 1, dtype=np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + LENGTH - 1, -1)
    covered = np.cumsum(change[:-1]) > 0
    out = []
    for doc, text, a, b in zip(chunk.ids, chunk.texts, chunk.begins.tolist(), chunk.ends.tolist(), strict=True):
        own = covered[a:b]
        if not own.any():
            out.append((doc, len(text), [], text))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        spans = edges.reshape(-1, 2).tolist()
        out.append((doc, len(text), [{"start": s, "end": e} for s, e in spans], np.frombuffer(text, np.uint8)[~own].tobytes()))
    return _documents(out)


def _documents(rows):
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), span, pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, ``spans`` of removed bytes (end exclusive) and the ``kept`` bytes.

    One row for each row of ``docs``; ids are integers. Null and short texts lose nothing.
    Rows of one id are one document: they do not remove from each other. A null id is neither
    smaller nor larger than another, so such rows keep all and remove nothing. An empty table
    gives none.
    """
    total = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    parts = max(1, int(total * ROW_BYTES_PER_BYTE / PART_BYTES) + 1)
    source = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    dealt = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    by_chunk, by_part = "chunk bigint, part bigint, data binary", "part bigint, chunk bigint, data binary"
    parsed = dealt.groupBy("chunk").applyInArrow(_parse(parts), by_part)
    settled = parsed.groupBy("part").applyInArrow(_settle, by_chunk)
    fetched = dealt.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInArrow(_fetch(parts), by_part)
    ordered = fetched.groupBy("part").applyInArrow(_sort_suffixes, by_chunk)
    answers = settled.select("chunk", "data", F.lit(1).alias("step")).unionAll(ordered.select("chunk", "data", F.lit(2).alias("step")))
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes removed and the digest of the rest."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
