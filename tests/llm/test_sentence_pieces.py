import numpy as np
import pytest

from vesselflow.llm import sentence_pieces as S

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return S.load_model()


def as_unigram(data: bytes) -> bytes:
    """The model file marked as a unigram model: field 3 of field 2 becomes 1."""

    def varint(buf, at):
        value = shift = 0
        while True:
            value |= (buf[at] & 127) << shift
            shift += 7
            at += 1
            if buf[at - 1] < 128:
                return value, at

    out, at = bytearray(data), 0
    while at < len(data):
        tag, at = varint(data, at)
        size, at = varint(data, at)
        if tag >> 3 == 2:
            inner, end = at, at + size
            while inner < end:
                t, inner = varint(data, inner)
                if t & 7 == 2:
                    n, inner = varint(data, inner)
                    inner += n
                elif t & 7 == 5:
                    inner += 4
                else:
                    if t >> 3 == 3:
                        out[inner] = 1
                    _, inner = varint(data, inner)
        at += size
    return bytes(out)


def brute(model, word):
    """Score of the best of all segmentations."""
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            score = model.by_text.get(word[start:end], (model.unknown if end - start == 1 else -np.inf,))[0]
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def encoded(model, texts):
    ids, counts = S.Encoder(model)(texts)
    assert len(counts) == len(texts) and counts.sum() == len(ids)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    " two  blanks and\nlines\n\n and\ttabs ",
    "Éclair über Straße niño",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbbbb",
    "",
]
ODD = ["▁ sign▁▁x", "\U0001f600 \u0000 � 漢字 ꙮ", "\n", " ", "   ", "x" * 3000, "ab" * 400 + " \U0001f600" * 50]


def test_equals_the_formats_own_search(model):
    own = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(S.MODEL_FILE, "rb").read()))
    covered = [t.replace("\n", " ").replace("\t", " ") for t in TEXTS]
    for text, ids in zip(covered, encoded(model, covered), strict=True):
        assert ids == own.encode(text), text


def test_words_have_the_best_score_of_all_segmentations(model):
    words = ["▁straightforward", "▁xylophon", "zzzzq", "▁ÆØÅ漢", "▁▁▁a", "\U0001f600b"]
    score = dict(zip(model.ids, model.scores, strict=True))
    for word in words:
        for path in (S.viterbi(model, [word])[0], S.viterbi_exact(model, word)):
            assert sum(score.get(i, model.unknown) for i in path.tolist()) == brute(model, word)


def test_exact_round_trip(model):
    texts = TEXTS + ODD
    for text, ids in zip(texts, encoded(model, texts), strict=True):
        assert S.decode_ids(model, ids) == text
    ids, counts = S.Encoder(model)(texts)
    assert S.Decoder(model)(ids, counts) == texts


def test_matrix_and_single_search_agree(model):
    words = ["▁" + "".join(chr(97 + (i * k + k * k) % 26) for k in range(12)) for i in range(300)]
    ids, counts = S.viterbi(model, words)
    for word, path in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert path.tolist() == S.viterbi_exact(model, word).tolist()


def test_shared_hash_is_noticed(model):
    assert S._spelled(model, "▁nothing", [model.ids[5]]) is None


def test_rows_nulls_repeats_and_other_columns(spark, model):
    rows = [(1, None, 5), (2, "", 6), (3, "a b", None), (3, "a b", None), (None, "x▁", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = S.decode_pieces(S.encode_pieces(docs, model), model)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(map(repr, [(r.doc_id, r.decoded) for r in got.collect()])) == sorted(
        map(repr, [(1, ""), (2, ""), (3, "a b"), (3, "a b"), (None, "x▁")])
    )
    assert S.encode_pieces(docs.limit(0), model).count() == 0
    result = S.encoded_documents(docs).collect()
    assert all(r.round_trip for r in result) and {r.n_tokens for r in result if r.doc_id in (1, 2)} == {0}
