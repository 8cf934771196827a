import random

import numpy as np
import pytest

from vesselflow.llm import simhash as S
from vesselflow.llm.components import connected_components


def brute_fingerprint(text):
    import xxhash

    words = [w for w in __import__("re").split(r"[ \t-\r]+", S_lower(text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def S_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_components(pairs):
    """doc id and fingerprint to component, by comparing all pairs."""
    ids = [i for i, _ in pairs]
    up = {k: k for k in range(len(pairs))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 4:
                up[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, i in enumerate(ids)}


def sample_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Éa", "THE", "ÀB"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 40, 200]))) for _ in range(60)]
    for base in list(texts[:20]):
        for _ in range(4):
            edited = base.split(" ")
            edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append("\n ".join(edited))
    return texts + ["", None, " \t\n", texts[0], texts[0].upper()]


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = sample_texts()
    docs = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = S.near_duplicates(docs).collect()
    expected = {1000 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == expected
    assert {r.doc_id: r.component_id for r in got} == brute_components(sorted(expected.items()))


def test_every_close_pair_shares_a_variant(spark):
    rng = random.Random(3)
    values = []
    for _ in range(40):
        base = rng.getrandbits(64)
        flipped = base
        for bit in rng.sample(range(64), rng.randrange(1, 7)):
            flipped ^= 1 << bit
        values += [base, flipped]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = connected_components(S.find_links(nodes)).collect()
    roots = {r.node: r.root for r in links}
    for a, b in zip(signed[::2], signed[1::2], strict=True):
        near = bin((a ^ b) % 2**64).count("1") <= 4
        assert (roots.get(a, a) == roots.get(b, b)) == near


@pytest.mark.parametrize("block", [4, 4096])
def test_crowded_variants_are_split_without_losing_links(spark, block):
    rng = random.Random(9)
    base = rng.getrandbits(63)
    values = {base}
    while len(values) < 120:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(24)))
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    links = connected_components(S.find_links(nodes, block=block)).collect()
    assert {r.root for r in links} == {values[0]} and len(links) == len(values) - 1


def test_sweep_and_walk_agree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 10, 400).astype(np.uint64)
    groups = np.sort(rng.integers(0, 3, 400))
    assert len(S.walk(np.unique(values), 2)) == len(np.unique(values)) - 1
    assert S.links_of_groups(groups[:0], values[:0], 4) == []


def test_components_of_long_paths_and_repeats(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (3, 4)]
    rows = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, None), (2, "")], schema)
    got = sorted(((r.doc_id or -1), r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == [(-1, 2), (-1, 5), (2, 2), (5, 5), (5, 5)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "q r s t u v")], schema)
    assert S.near_duplicates(alone).first().component_id is None
