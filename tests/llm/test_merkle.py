"""Merkle manifest against a plain recursion over all levels."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vesselflow.llm import merkle
from vesselflow.llm.merkle import fold, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root int, idx string, key int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes):
    """The top, and per node the steps (place, others)."""
    steps, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, members = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j, group in enumerate(below[k : k + 3]):
                for i in group:
                    steps[i].append((j, run[:j] + run[j + 1 :]))
            upper.append(digest(*run))
            members.append([i for g in below[k : k + 3] for i in g])
        nodes, below = upper, members
    return nodes[0], steps


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for name in names:
        by_source[name].sort(key=lambda x: x[:3])
        tops.append(climb([x[2] for x in by_source[name]]))
    root, upper = climb([t for t, _ in tops])
    result = []
    for name, (top, steps), last in zip(names, tops, upper, strict=True):
        for (_, _, own, row), path in zip(by_source[name], steps, strict=True):
            whole = path + last
            result.append((row[0], row[1], own, top, root, [s for _, o in whole for s in o], [p for p, _ in whole]))
    return result


def plain(rows):
    return sorted(rows, key=repr)


def check(spark, rows, every):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)
    proofs = manifest(docs, every=every).proofs().collect()
    found = [(p.doc_id, p.source, p.leaf, p.subroot, p.root, p.siblings, p.positions) for p in proofs]
    assert plain(found) == plain(expected(rows))
    assert all(len(p.siblings) == sum(p.widths) - len(p.widths) for p in proofs)


def some(counts):
    return [
        (i * 7 % 101, source, "en" if i % 3 else None, i, f"text {i}\n" if i % 5 else None)
        for source, n in counts.items()
        for i in range(n)
    ]


@pytest.mark.parametrize("every", [1, 2, 4])
def test_trees_of_many_heights(spark, every):
    check(spark, some({"a": 1, "b": 2, "c": 3, "d": 4, "é": 28, None: 10, "": 9, "Z": 82}), every)


def test_a_source_with_most_rows(spark):
    check(spark, some({"hot": 300, "x": 1}), 2)


def test_one_row(spark):
    check(spark, [(5, None, None, None, None)], 4)
    docs = spark.createDataFrame([(5, None, None, None, None, 1, 2, "x", 3)], SCHEMA)
    proof = manifest(docs).proofs().first()
    assert proof.leaf == proof.subroot == proof.root == digest("1:5----") and proof.siblings == []


def test_repeated_rows_null_ids_and_empty_texts(spark):
    rows = [(1, "s", "en", 0, "")] * 7 + [(None, "s", None, None, None)] * 5 + [(1, "s", "en", 1, "b"), (2, None, "", 3, "c\n")]
    check(spark, rows, 2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    made = manifest(docs)
    assert made.root is None and made.proofs().collect() == []


def test_very_long_text(spark):
    check(spark, [(1, "s", "en", 5_000_000, "abcd\n" * 1_000_000), (2, "s", "en", 1, "x")], 4)


def test_levels_between_are_not_kept(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in some({"a": 100})], SCHEMA)
    made = manifest(docs, every=2)
    assert sorted(made.leaves.levels) == [0, 2, 4]
    assert [made.leaves.levels[k].count() for k in (0, 2, 4)] == [100, 12, 2]


def test_a_changed_leaf_or_sibling_is_found(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in some({"a": 40, "b": 5})], SCHEMA)
    proofs = manifest(docs).proofs()
    assert fold(proofs, "leaf", "folded").where("folded = root").count() == 45
    wrong = proofs.withColumn("leaf", F.sha2("leaf", 256))
    assert fold(wrong, "leaf", "folded").where("folded = root").count() == 0
    swapped = proofs.withColumn("siblings", F.reverse("siblings"))
    alike = swapped.where(F.col("siblings") == F.reverse("siblings")).count()
    assert fold(swapped, "leaf", "folded").where("folded = root").count() == alike
    none = fold(proofs.withColumn("leaf", F.lit(None).cast("string")), "leaf", "folded")
    assert none.where("folded is not null").count() == 0


def test_query_against_recursion(spark, tmp_path):
    rows = some({"a": 30, "b": 4, None: 2}) + [(None, "a", "en", 3, "a\nb")]
    spark.createDataFrame([r[:5] for r in rows], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in merkle.op13_merkle(spark, str(tmp_path)).collect():
        found.setdefault(r.leaf, []).append(r)
    texts = {}
    for row in rows:
        texts.setdefault(leaf(row), []).append(row)
    for doc_id, _, own, top, root, siblings, positions in expected(rows):
        result = found[own][0]
        row = texts[own][0]
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and row[4] is not None and "\n" in row[4]
        assert (result.doc_id, result.subroot, result.root) == (doc_id, top, root)
        assert changed != result.verified and (result.folded_root == root) == result.verified
        if len(found[own]) == 1:
            assert result.proof_sha256 == digest(*siblings)
