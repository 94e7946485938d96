"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits, cut into
``max_bits // 2 + 1`` segments, have a segment that differs in at most one
bit.  Each distinct fingerprint is indexed under 64 keys: for every bit, the
segment holding it with that bit masked out (the one-wildcard variant).  Equal
keys are joined and verified with the bit distance of the whole fingerprints.

Copies never meet in pairs: equal fingerprints are one node.  A key shared by
up to ``SMALL`` fingerprints is verified pair by pair inside that bounded
list.  Fingerprints under a fuller key (a crowd of near copies) are linked by
an exact route with linear output: two points are within 2 bits just if their
one-bit neighbourhoods meet, so each point is listed under its 65 neighbours
and linked to the smallest point of every list it is in.

Spark sizes a table after an explode like the one before it.  The joins that
read exploded keys ask for a merge join, else 64 keys for each of some 200,000
fingerprints would be broadcast through the driver.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logsleuth.llm import common
from logsleuth.operators.components import connected_components

SMALL = 32
SEED = 42
_CHUNK = 1 << 16
_digest = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        part = words[lo:min(n, lo + _CHUNK) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        h = np.fromiter(map(_digest, map(b" ".join, grams)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint's bits as a long)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in common.texts(batch.column(len(keep)))],
                       np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fps)],
                                          names=[*keep, "fp"])
    rows = df.select(*keep, text)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp bigint"
    return common.map_batches(rows, work, schema)


def _masks(max_bits: int) -> list[tuple[int, int]]:
    """(bit, mask): the segment that holds the bit, without the bit, as a signed long."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        segment = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        out += [(bit, _signed(segment & ~(1 << bit))) for bit in range(lo, hi)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _crowd_links(points: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all ``fp`` within ``max_bits``, without pairs.

    Every point is listed under meeting places such that two points share one
    just if they are within the distance: itself and its one-bit neighbours
    for 2, each bit masked for 1, each bit masked in every one-bit neighbour
    for 3.  Each list holds a bounded number of distinct points."""
    near = points.select("fp", F.col("fp").alias("place"), F.lit(-1).alias("bit"))
    if max_bits >= 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
        near = near.select("fp", F.explode(flips).alias("x"), "bit").select(
            "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("place"), "bit")
    if max_bits % 2:
        holes = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(_signed(~(1 << i) & (1 << 64) - 1)).alias("m"))
                          for i in range(64)])
        near = near.select("fp", "place", F.explode(holes).alias("h")).select(
            "fp", F.col("place").bitwiseAND(F.col("h.m")).alias("place"), F.col("h.bit").alias("bit"))
    low = near.groupBy("place", "bit").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (near.join(low.hint("merge"), ["place", "bit"]).where("fp <> low")
            .select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct())


def links(points: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``points`` (column ``fp``)
    whose transitive closure is that of all pairs within ``max_bits`` bits."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    variants = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(m).alias("mask")) for b, m in _masks(max_bits)])
    keys = points.select("fp", F.explode(variants).alias("v")).select(
        "fp", F.col("v.bit").alias("bit"), F.col("fp").bitwiseAND(F.col("v.mask")).alias("part"))
    sizes = keys.groupBy("bit", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(sizes.hint("merge"), ["bit", "part"]).select("fp", "bit", "part", "n").checkpoint()
    lists = shared.where(F.col("n") <= SMALL).groupBy("bit", "part").agg(
        F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = (lists.select(F.explode("m").alias("a"), "m")
             .select("a", F.explode(F.filter("m", lambda x: (x > F.col("a"))
                                             & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= max_bits))).alias("b"))
             .distinct())
    crowd = shared.where(F.col("n") > SMALL).select("fp").distinct()
    return pairs.union(_crowd_links(crowd, max_bits)).distinct()


def classes(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of ``rows``; fingerprints
    with one ``root`` are connected.  ``rows`` must be stored or checkpointed."""
    # small rows, but each is about to make 64 keys: keep them in many tasks
    points = rows.select("fp").distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    comps = connected_components(links(points, max_bits))
    return (points.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    Null and blank texts have fingerprint 0 and are linked like any other.
    Rows that share a doc_id keep their own fingerprints.  A null doc_id is
    passed over when the smallest of a component is taken; a component without
    any doc_id has a null component_id.  An empty table gives an empty one;
    other columns are not read."""
    common.prepare(docs.sparkSession)
    rows = fingerprints(docs, shingle=shingle).checkpoint()
    roots = classes(rows, max_bits)
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp")
    comp = low.groupBy("root").agg(F.min("low").alias("component_id"))
    place = low.select("fp", "root").join(comp, "root").select("fp", "component_id")
    return rows.join(place, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component, all its columns unchanged.

    The row with the smallest doc_id stays (null last); among rows of one
    doc_id the one with the smallest content hash, so reruns agree; rows that
    are equal in every column count as one."""
    common.prepare(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.xxhash64(*cols).alias("__llm_r1"),
                         F.xxhash64(F.lit("second"), *cols[::-1]).alias("__llm_r2"), *cols)
    rows = fingerprints(marked, keep=("doc_id", "__llm_r1", "__llm_r2"), shingle=shingle).checkpoint()
    roots = classes(rows, max_bits)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__llm_r1", "__llm_r2")
    best = rows.groupBy("fp").agg(F.min(order).alias("w")).join(roots, "fp")
    stay = best.groupBy("root").agg(F.min("w").alias("w")).select("w.__llm_r1", "w.__llm_r2").checkpoint()
    kept = marked.join(stay, ["__llm_r1", "__llm_r2"], "left_semi").dropDuplicates(["__llm_r1", "__llm_r2"])
    return kept.select(*cols)
