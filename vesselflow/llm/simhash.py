"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most four are cut into three segments. If every
segment differed in two bits or more, the fingerprints would differ in six, so one segment
differs in at most one bit. Each segment is therefore indexed once for each of its bits
with that bit left out: two segments that differ in at most one bit have a variant in
common, and equality of variants finds every link. Each candidate is verified on all 64
bits.

Copies share a fingerprint and are one row from then on. Variants that very many
fingerprints share are split into blocks, and all pairs of blocks are searched, each in a
task of bounded size. A search starts at a fingerprint and walks to those not reached yet,
so a dense group of near copies costs about its size and gives a spanning tree, not all
its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import stored, table
from vesselflow.llm.components import connected_components

SHINGLE, MAX_DISTANCE, SEED = 4, 4, 42
#: Fingerprints of one variant that one task compares.
BLOCK = 4096
#: Groups up to this size are compared in one sweep over all groups.
SWEEP = 24


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    # Without an argument bytes are split at ASCII white space, which is what separates words here.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed 64-bit number; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp``. A null text is empty: its fingerprint is 0."""
    docs = docs.drop("fp")
    columns = docs.columns
    at = columns.index(text)
    rest = [i for i in range(len(columns)) if i != at]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(made, pa.int64())], [*(columns[i] for i in rest), "fp"]
            )

    schema = T.StructType([*(docs.schema.fields[i] for i in rest), T.StructField("fp", T.LongType())])
    return docs.mapInArrow(run, schema)


def segments(distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """(lowest bit, bits) of so many segments that one differs in at most one bit."""
    n = distance // 2 + 1
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(nodes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, bit, rest) for each bit: the rest of the bit's segment without the bit."""
    made = []
    for low, size in segments(distance):
        mask = ((1 << size) - 1) << low
        for bit in range(low, low + size):
            kept = mask & ~(1 << bit)
            signed = kept - (1 << 64) if kept >= 1 << 63 else kept
            made.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(signed)).alias("rest")))
    return nodes.select("fp", F.explode(F.array(*made)).alias("v")).select("fp", "v.bit", "v.rest")


class _Forest:
    """Links that join two trees of this task's forest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def walk(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, from one node to the next."""
    out, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= distance
            if near.any():
                found = left[near]
                out += [(int(node), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def links_of_groups(groups: np.ndarray, values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links inside the groups; ``groups`` has the group of each value, equal ones side by side."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    out = []
    for start, size in zip(starts[sizes > SWEEP].tolist(), sizes[sizes > SWEEP].tolist(), strict=True):
        out += walk(np.unique(values[start : start + size]), distance)
    small = np.repeat(sizes <= SWEEP, sizes)
    for step in range(1, min(SWEEP, int(sizes.max(initial=1)))):
        same = (groups[step:] == groups[:-step]) & small[step:]
        a, b = values[:-step][same], values[step:][same]
        near = np.bitwise_count(a ^ b) <= distance
        out += list(zip(a[near].tolist(), b[near].tolist(), strict=True))
    return out


def find_links(nodes: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b) links of the distinct fingerprints in ``nodes``: spanning forests, with repeats.

    The components of these links are those of all links."""
    keyed = variants(nodes, distance)
    crowded = keyed.groupBy("bit", "rest").count().where(F.col("count") > block)
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        keyed.join(crowded, ["bit", "rest"], "left")
        .select("fp", "bit", "rest", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("fp", "bit", "rest", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def run(batches):
        import pyarrow as pa

        forest = _Forest()
        kept = None
        for batch in (*batches, None):
            if batch is not None:
                columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                if kept is not None:
                    columns = [np.concatenate(pair) for pair in zip(kept, columns, strict=True)]
                if not len(columns[0]):
                    continue
                differs = np.zeros(len(columns[0]), dtype=bool)
                for values in columns[1:]:
                    differs[1:] |= values[1:] != values[:-1]
                cut = int(np.flatnonzero(differs)[-1]) if differs.any() else 0
                kept = [c[cut:] for c in columns]
                done, group = columns[0][:cut], np.cumsum(differs)[:cut]
            elif kept is None:
                break
            else:
                done, group = kept[0], np.zeros(len(kept[0]), dtype=np.int64)
            found = [p for p in links_of_groups(group, done.view(np.uint64), distance) if forest.joins(*p)]
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    together = dealt.repartition("bit", "rest", "i", "j").sortWithinPartitions("bit", "rest", "i", "j")
    return together.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", size: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """All columns of ``docs`` but the text, with ``fp``, ``component_id`` and ``root``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the own one included.
    Null ids are left out of that minimum; a component of null ids only has a null one.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows give
    repeated rows. An empty table gives none. ``root`` is the least fingerprint of the
    component.
    """
    rows = stored(fingerprints(docs, text, size), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    trees = connected_components(find_links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(trees, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fingerprint = rooted.join(least, "root").select("fp", "component_id", "root")
    return rows.drop("component_id", "root").join(of_fingerprint, "fp", "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` for one document of each component: the one with the smallest id.

    A document with an id goes before one without. Of rows that repeat id and text one stays."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select("doc_id", "text", "_key"))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key")
    winners = found.groupBy("root").agg(F.min(order).alias("best")).select("best._key")
    repeats = Window.partitionBy("_key").orderBy("doc_id")
    kept = keyed.join(winners, "_key", "left_semi").withColumn("_repeat", F.row_number().over(repeats))
    return kept.where("_repeat = 1").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint in hexadecimal digits and its component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
