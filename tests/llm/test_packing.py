"""Packing against the tokenizer's own ids of whole texts, cut by hand."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vesselflow.llm import packing
from vesselflow.llm.packing import Windows, pack, sequences

SCHEMA = "doc_id long, text string, ids int, sequence_id string, part double"
WORDS = "Der alte Mann und das Meer 1952 ship's log, 12.5 kn\n\n  two  spaces\tand tabs　ideographic été 你好 \U0001f600!"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.tokenizer_file())


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(library, texts, pieces, length):
    """Every id of every row once, sequences without gaps; returns the lengths of the sequences."""
    pieces = pieces.collect()
    by_row = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        by_row.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for doc_id, text in texts:
        expected = whole(library, text)
        got = sorted(by_row[doc_id])
        assert [i for _, ids, _ in got for i in ids] == expected
        assert {n for _, _, n in got} == {len(expected)}
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = []
    for number in sorted(by_sequence):
        at = 0
        for offset, size in sorted(by_sequence[number]):
            assert offset == at
            at += size
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and max(sizes, default=0) <= length
    assert all(s == length for s in sizes if s & (s - 1)) and sum(sizes) == sum(len(whole(library, t)) for _, t in texts)
    return sizes


def test_all_kinds_of_texts(spark, library):
    texts = [(i, t) for i, t in enumerate([None, "", " ", "\n", WORDS, WORDS * 40, "x" * 5000, "!\x1c! a\x85b ​ c", WORDS])]
    docs = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in texts], SCHEMA).repartition(3, "doc_id")
    sizes = check(library, texts, pack(docs, length=64), 64)
    assert sizes[:-7] and set(sizes[: sum(sizes) // 64]) == {64}


def test_one_window_per_power_of_two_at_the_end(spark, library):
    texts = [(i, "word " * 30) for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = check(library, texts, pack(docs), 2048)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


def test_long_text_passes_in_groups_with_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 100)
    monkeypatch.setattr(packing, "LONG", 20)
    tokens = packing.Tokens(packing.tokenizer_file())
    texts = [WORDS * 50, "a" * 1000, "  \u3000 \u3000 x" * 300, " " * 999, "<|endoftext|> a <|endoftext|>" * 50, "x <|endoftext|>, y", "été la " * 99]
    assert [[*ids, packing.END_ID] for ids in tokens.of(texts)] == [whole(library, t) for t in texts]


def test_ids_equal_the_library_on_any_text(library):
    tokens = packing.Tokens(packing.tokenizer_file())
    random = np.random.default_rng(5)
    signs = [chr(c) for c in (32, 32, 10, 13, 9, 11, 12, 0x1C, 0x1F, 0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    signs += [*"ab'sdtmrevl12.!-_é你ßΩя한", "\U0001f600", "\u0301", "²", "٣", "'s", "'ll", "''", " '"]
    texts = ["".join(random.choice(signs, random.integers(0, 14))) for _ in range(20000)]
    for text, ids in zip(texts, tokens.of(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_words_and_equal_hashes_change_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    tokens = packing.Tokens(packing.tokenizer_file())
    for _ in range(3):
        assert [[*ids, packing.END_ID] for ids in tokens.of([WORDS, "", WORDS[:9]])] == [whole(library, t) for t in (WORDS, "", WORDS[:9])]
    monkeypatch.setattr(packing, "BASE", 1)
    alike = packing.Tokens(packing.tokenizer_file())
    assert [[*ids, packing.END_ID] for ids in alike.of(["ab ba ac", "ba ab bb"])] == [whole(library, t) for t in ("ab ba ac", "ba ab bb")]


def test_another_kind_of_tokenizer_sees_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, library = packing.Tokens(path), Tokenizer.from_file(path)
    assert not tokens.cuttable
    assert tokens.of([WORDS, "", "Ab c"]) == [library.encode(t, add_special_tokens=False).ids for t in (WORDS, "", "Ab c")]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, None)], "doc_id long, text string")
    rows = pack(docs, length=4).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 3 + 1
    assert {r.doc_id: r.doc_tokens for r in rows if r.doc_id} == {7: 3}
    assert sorted(r.doc_tokens for r in rows if r.doc_id is None and r.start == 0) == [1, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs).collect() == [] and sequences(pack(docs)).collect() == []


def test_part_starts_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    counts = [(p, (p * 7) % 5 + 1) for p in range(0, 60, 2)]
    tokens = spark.createDataFrame([(p, n) for p, n in counts for _ in range(2)], "part long, n long")
    starts = {r.part: r.before for r in packing.part_starts(tokens).collect()}
    before = 0
    for p, n in counts:
        assert starts[p] == before
        before += 2 * n


@pytest.mark.parametrize("total", [0, 1, 63, 64, 65, 64 * 5 + 37, 64 * 3 + 63])
def test_windows(total):
    windows = Windows(total, 64)
    places = np.arange(total)
    numbers = windows.at(places)
    begins = windows.start(numbers)
    assert (np.diff(numbers) >= 0).all() and (begins <= places).all()
    sizes = np.bincount(numbers) if total else np.zeros(0, int)
    assert all(s == 64 or not s & (s - 1) for s in sizes.tolist()) and (sizes[: total // 64] == 64).all()


def test_sequences_are_whole(spark, library):
    texts = [(i, WORDS * (i % 4)) for i in range(12)]
    pieces = pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4, "doc_id"), length=128)
    rows = {r.sequence_id: r for r in sequences(pieces, 128, pad_id=9).collect()}
    found = pieces.collect()
    for p in found:
        row = rows[p.sequence_id]
        part = np.array(row.ids[p.offset : p.offset + p.length], dtype="<u4")
        assert part.tobytes() == bytes(p.ids)
        assert (p.offset, p.doc_id, p.start, p.length, p.doc_tokens) in {tuple(b) for b in row.boundaries}
    assert all(len(r.ids) == 128 or not len(r.ids) & (len(r.ids) - 1) for r in rows.values())


def test_checksum(spark):
    ids = np.array([5, 70000, 1], dtype="<u4").tobytes()
    row = spark.createDataFrame([(bytearray(ids),)], "ids binary").select(packing.crc_of_ids().alias("c")).first()
    assert row.c == zlib.crc32(ids)
