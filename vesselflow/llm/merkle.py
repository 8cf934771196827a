"""Merkle manifest of a data set, with proofs from a few stored levels.

Each row is a leaf; the leaves of a source, in order, are hashed in runs of three up to one
node, and the sources' nodes, in order, up to the root. Of every tree only each ``every``-th
level is kept (``every`` = 4: of 81 leaves one node). A proof needs the levels between, too:
it takes an aligned subtree's stored nodes, hashes the missing levels anew, gives every
stored node its siblings, and forgets them.

All hashes are SHA-256 in lower-case hexadecimal digits, and what is hashed are such digits
one after the other; tables keep them as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that are hashed together, and levels from one that is kept to the next.
FANOUT, EVERY = 3, 4
#: Levels of the tallest tree, 3^39 leaves.
MOST_LEVELS = 39
PATH = ["siblings", "positions", "widths"]


def digest_of(*values: Column) -> Column:
    """SHA-256 over the values: ``-`` for null, else the number of bytes, ``:`` and the text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(binary) -> Column:
    return F.lower(F.hex(binary))


def _height() -> Column:
    """Levels above the leaves of a tree of ``n``: the powers of three below ``n``."""
    powers = F.array(*[F.lit(FANOUT**k) for k in range(MOST_LEVELS)])
    return F.size(F.filter(powers, lambda p: p < F.col("n")))


def _folds(level: int, every: int) -> Column:
    return F.least(F.lit(every), _height() - level)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``idx`` within their ``key`` and the number ``n`` of its rows.

    Sorted by ranges over the whole table, so a key with a third of all rows fills many
    partitions. A table with one row per partition and key tells how many rows stand
    before; that is joined, no key is gathered. Rows that are alike in every column of
    ``order`` are told apart by their place in the file, so they fill many partitions, too.
    """
    ranked = [F.col(c).asc_nulls_first() for c in ["key", *order, "_salt"]]
    spread = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*ranked).sortWithinPartitions(*ranked).drop("_salt")
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "nodes")
    # The upper bits of the number are the partition, the lower ones count its rows.
    part = F.shiftright("_at", 33)
    runs = placed.groupBy("key", part.alias("_part")).agg(F.count("*").alias("rows"), F.min("_at").alias("first"))
    whole = Window.partitionBy("key")
    before = F.sum("rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(
        "key", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"), F.sum("rows").over(whole).alias("n")
    )
    joined = placed.withColumn("_part", part).join(stored(shifts, "runs"), ["key", "_part"])
    return joined.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass
class Forest:
    """One tree per key: the kept levels (key, idx, n, digest), leaves first, and the tops."""

    levels: dict[int, DataFrame]
    tops: DataFrame
    every: int


def build(nodes: DataFrame, every: int = EVERY) -> Forest:
    """Hash ``nodes`` (key, idx, n, digest) upwards; every ``every``-th level is written.

    A group is the at most 3^every nodes below one kept node, whatever the size of a tree."""
    most = nodes.agg(F.max(_height())).first()[0]
    width, level, levels, tops = FANOUT**every, 0, {0: nodes}, None
    while True:
        block = F.expr(f"idx div {width}").alias("block")
        grouped = levels[level].groupBy("key", block, "n").agg(
            F.sort_array(F.collect_list(F.struct("idx", _hex("digest").alias("digest"))))["digest"].alias("digests")
        )
        folds = _folds(level, every)
        # A lone node is the top of its tree and is not hashed again.
        folded = F.when(folds <= 0, F.col("digests")).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(folds, F.lit(1))), F.col("digests"), lambda nodes, _: _above(nodes))
        )
        above = stored(grouped.select("key", F.col("block").alias("idx"), "n", F.unhex(folded[0]).alias("digest")), "nodes")
        level += every
        done = above.where(_height() <= level).select("key", "n", "digest")
        tops = done if tops is None else tops.unionAll(done)
        if most is None or level >= most:
            return Forest(levels, tops, every)
        levels[level] = above.where(_height() > level)


def _above(nodes: Column) -> Column:
    """The nodes over a list of nodes, each the hash of at most three."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.sha2(F.array_join(F.slice(nodes, k * FANOUT + 1, FANOUT), "").cast("binary"), 256),
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _paths_below(digests: list[str], folds: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """For each node of a subtree: siblings, own place and run length by level."""
    levels = [digests]
    for _ in range(folds):
        nodes = levels[-1]
        levels.append([_sha("".join(nodes[k : k + FANOUT])) for k in range(0, len(nodes), FANOUT)])
    for i in range(len(digests)):
        siblings, positions, widths = [], [], []
        for nodes in levels[:folds]:
            place = i % FANOUT
            run = nodes[i - place : i - place + FANOUT]
            siblings += run[:place] + run[place + 1 :]
            positions.append(place)
            widths.append(len(run))
            i //= FANOUT
        yield siblings, positions, widths


def _whole_groups(batches, starts_at: int):
    """Tables of whole groups; a group begins where the column is -1."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        starts = np.flatnonzero(rows.column(starts_at).to_numpy() == -1)
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _extend(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Siblings of all nodes up to the root, from groups with a head row that has the siblings above."""
    columns = rows.columns
    at = {c: columns.index(c) for c in columns}

    def run(batches):
        import pyarrow as pa

        def lists(flat, counts, kind):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))

        for groups in _whole_groups(batches, at["idx"]):
            indices = groups.column(at["idx"]).to_numpy()
            heads = np.flatnonzero(indices == -1).tolist()
            subroots, folds = [], groups.column(at["folds"])
            flat, counts = {c: [] for c in PATH}, {c: [] for c in PATH}
            for head, end in zip(heads, [*heads[1:], len(indices)], strict=True):
                above = [groups.column(at[c])[head].as_py() for c in PATH]
                digests = [d.hex() for d in groups.column(at["digest"]).slice(head + 1, end - head - 1).to_pylist()]
                for path in _paths_below(digests, folds[head].as_py()):
                    for c, own, upper in zip(PATH, path, above, strict=True):
                        flat[c] += own
                        flat[c] += upper
                        counts[c].append(len(own) + len(upper))
                subroots += [groups.column(at["subroot"])[head].as_py()] * len(digests)
            nodes = groups.filter(pa.array(indices != -1)).combine_chunks()
            if not nodes.num_rows:
                continue
            made = {
                "siblings": lists(flat["siblings"], counts["siblings"], pa.string()),
                "positions": lists(flat["positions"], counts["positions"], pa.int32()),
                "widths": lists(flat["widths"], counts["widths"], pa.int32()),
                "subroot": pa.array(subroots, pa.string()),
            }
            arrays = [made[c] if c in made else nodes.column(at[c]).chunk(0) for c in kept]
            yield pa.RecordBatch.from_arrays(arrays, kept)

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept]))


def extract(forest: Forest, heads: DataFrame) -> DataFrame:
    """All leaves of a forest with their siblings up to the root.

    ``heads`` (key, n, subroot and the path of each top) are where the paths go on. From
    the highest kept level downwards: the nodes of a subtree meet the path of the kept
    node over them, the levels between are hashed anew inside the group. Groups have at
    most 3^every nodes; the paths of all but the leaves are small tables that are written.
    """
    every, paths = forest.every, None
    width = FANOUT**every
    head_columns = ["key", "block", "n", "subroot", *PATH]
    for level in sorted(forest.levels, reverse=True):
        here = (_height() > level) & (_height() <= level + every)
        ends = here | (_height() == 0) if level == 0 else here
        tops = heads.where(ends).withColumn("block", F.lit(0).cast("long")).select(*head_columns)
        over = tops if paths is None else tops.unionByName(paths.withColumnRenamed("idx", "block").select(*head_columns))
        nodes = forest.levels[level].withColumn("block", F.expr(f"idx div {width}"))
        rows = over.withColumn("idx", F.lit(-1).cast("long")).unionByName(nodes, allowMissingColumns=True)
        # The head row (idx -1) comes first, so groups are told apart without a look at keys.
        rows = rows.withColumn("folds", F.greatest(_folds(level, every), F.lit(0)))
        grouped = rows.repartition("key", "block").sortWithinPartitions("key", "block", "idx")
        if level == 0:
            kept = [c for c in grouped.columns if c not in ("block", "folds", "idx", "n")]
            return _extend(grouped, kept)
        paths = stored(_extend(grouped, ["key", "idx", "n", "subroot", *PATH]), "paths")
    raise ValueError("a forest without leaves")


@dataclass
class Manifest:
    """The trees of a data set. ``root`` is null for a table without rows."""

    leaves: Forest
    sources: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """(source, leaf, subroot, root, siblings, positions, widths) and what the leaves carry.

        Per level from the leaf to the root, ``positions`` is the node's place in its run and
        ``widths`` the length of the run; ``siblings`` are the others of all runs, left to
        right, level by level."""
        start = self.sources.tops.select("key", "n", _hex("digest").alias("subroot")).select(
            "*",
            F.array().cast("array<string>").alias("siblings"),
            *[F.array().cast("array<int>").alias(c) for c in PATH[1:]],
        )
        sources = extract(self.sources, start).select(
            F.col("carried.key").alias("key"), F.col("carried.n").alias("n"), _hex("digest").alias("subroot"), *PATH
        )
        leaves = extract(self.leaves, stored(sources, "paths"))
        root = F.lit(self.root).cast("string").alias("root")
        return leaves.select("carried.*", _hex("digest").alias("leaf"), "subroot", root, *PATH)


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, every: int = EVERY) -> Manifest:
    """The manifest of all rows: a tree per source, and one over the sources.

    Leaves ascend by doc_id, null first; rows with the same doc_id follow their hash, so
    repeated rows stand side by side and count each. Sources ascend by their UTF-8 bytes,
    null first. Null fields are hashed as ``-``, empty texts as ``0:``. Only the columns of
    :data:`FIELDS` are read (and those that ``carried`` names); other ones cannot clash.
    ``carried`` are columns that each leaf takes along, doc_id and source by default.

    Texts are read once and hashed where they are read; 32 bytes a row travel.
    """
    carried = {"doc_id": docs["doc_id"], "source": docs["source"]} | (carried or {})
    source = docs["source"].cast("string")
    hashed = docs.select(
        # No null, and in the order of the sources with null first.
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        docs["doc_id"].alias("id"),
        digest_of(*[docs[c] for c in FIELDS]).alias("digest"),
        F.struct(*[c.alias(name) for name, c in carried.items()]).alias("carried"),
    )
    leaves = build(_numbered(stored(hashed, "leaves"), ["id", "digest"]).drop("id"), every)
    roots = leaves.tops.select(
        F.lit("").alias("key"), F.col("key").alias("id"), "digest", F.struct("key", "n").alias("carried")
    )
    sources = build(_numbered(roots, ["id"]).drop("id"), every)
    top = sources.tops.select(_hex("digest").alias("root")).first()
    return Manifest(leaves, sources, top and top.root)


def fold(proofs: DataFrame, leaf: str, into: str) -> DataFrame:
    """``proofs`` with the root that a leaf's hash (hex) and its proof lead to; null without a leaf."""
    columns = [*[c for c in proofs.columns if c != into], into]
    rows = proofs.select(*columns[:-1])
    at = [columns.index(c) for c in (leaf, *PATH)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            roots = []
            leaves, siblings, positions, widths = (batch.column(i) for i in at)
            for node, others, places, lengths in zip(
                leaves.to_pylist(), siblings.to_pylist(), positions.to_pylist(), widths.to_pylist(), strict=True
            ):
                begin = 0
                for place, length in zip(places, lengths, strict=True):
                    run_of = others[begin : begin + length - 1]
                    begin += length - 1
                    if node is not None:
                        node = _sha("".join([*run_of[:place], node, *run_of[place:]]))
                roots.append(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], columns)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether the document still leads to the root.

    A document whose doc_id has an even CRC-32 is read without its line ends; one whose
    doc_id is null is left as it is."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    shorter = F.replace(docs["text"], F.lit("\n"), F.lit(""))
    changed = even & docs["text"].contains("\n")
    shown = F.when(changed, digest_of(*[shorter if c == "text" else docs[c] for c in FIELDS]))
    proofs = manifest(docs, {"shown": shown}).proofs()
    read = proofs.withColumn("shown", F.coalesce(_hex("shown"), F.col("leaf")))
    folded = fold(read, "shown", "folded_root")
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _leaf_sql(text: str) -> str:
    fields = [text if c == "text" else c for c in FIELDS]
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields]
    return f"sha256({' || '.join(parts)})"


#: One step of CRC-32 for a bit, and the checksum of the decimal digits of doc_id.
_BITS = "list_reduce(list_prepend({start}, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = f"""xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda sum, byte: {_BITS.format(start='xor(sum, byte)')}))"""
_CLIMB = """
  SELECT key, level + 1 AS level, idx // 3 AS idx, (n + 2) // 3 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
  FROM {climb} WHERE n > 1 GROUP BY key, level, n, idx // 3"""

#: The same results by plain recursion: all levels at once, no kept ones.
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
named AS (
  SELECT *, coalesce('=' || source, '') AS key,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS size FROM hashed),
climb AS (
  SELECT key, CAST(0 AS BIGINT) AS level, CAST(place AS BIGINT) AS idx, CAST(size AS BIGINT) AS n, leaf AS digest FROM named
  UNION ALL {_CLIMB.format(climb='climb')}),
tops AS (
  SELECT key AS name, digest, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS size FROM climb WHERE n = 1),
upper AS (
  SELECT '' AS key, CAST(0 AS BIGINT) AS level, CAST(place AS BIGINT) AS idx, CAST(size AS BIGINT) AS n, digest FROM tops
  UNION ALL {_CLIMB.format(climb='upper')}),
own AS (
  SELECT d.*, t.digest AS subroot, t.place AS upper_place, (SELECT digest FROM upper WHERE n = 1) AS root,
    row_number() OVER () AS row FROM named d JOIN tops t ON d.key = t.name),
nodes AS (
  SELECT 0 AS tree, * FROM climb WHERE n > 1 UNION ALL SELECT 1, * FROM upper WHERE n > 1),
steps AS (
  SELECT o.row, a.tree, a.level, a.idx, a.key FROM own o JOIN nodes a
  ON (a.tree = 0 AND a.key = o.key AND a.idx = o.place // CAST(pow(3, a.level) AS BIGINT))
  OR (a.tree = 1 AND a.idx = o.upper_place // CAST(pow(3, a.level) AS BIGINT))),
around AS (
  SELECT s.row, s.tree, s.level,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < s.idx), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > s.idx), '') AS behind,
    row_number() OVER (PARTITION BY s.row ORDER BY s.tree, s.level) AS step
  FROM steps s JOIN nodes b ON b.tree = s.tree AND b.key = s.key AND b.level = s.level AND b.idx // 3 = s.idx // 3
  GROUP BY s.row, s.tree, s.level, s.idx),
folded AS (
  SELECT row, CAST(0 AS BIGINT) AS step, coalesce(changed, leaf) AS digest FROM own
  UNION ALL
  SELECT f.row, a.step, sha256(a.before || f.digest || a.behind)
  FROM folded f JOIN around a ON a.row = f.row AND a.step = f.step + 1),
last AS (SELECT row, arg_max(digest, step) AS digest FROM folded GROUP BY row),
proofs AS (SELECT row, string_agg(before || behind, '' ORDER BY step) AS siblings FROM around GROUP BY row)
SELECT o.doc_id, o.leaf, o.subroot, o.root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
  l.digest AS folded_root, l.digest = o.root AS verified
FROM own o JOIN last l ON l.row = o.row LEFT JOIN proofs p ON p.row = o.row
"""
