"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources share all words by weight; a target stops at ``MAX_EPOCHS``
times its source's size and the excess is shared again by weight (water
filling, solved over the sorted ratios of cap and weight).

Draws: the documents of a source stand in a pseudo-random order that depends
on the seed only and are cut into blocks of about ``BLOCK_WORDS`` words.  A
source's exact quota is all its blocks for each full epoch and, for the rest
of its target, the leading blocks; the rest is met within a document by taking
the documents that fit and then, ``TOP_UPS`` times, the largest one that still
fits.

Shards: a binary tree halves the shards; at each node the block quotas of all
sources are split between the halves by one multivariate hypergeometric draw
(conditional draws source by source, each by inversion of its distribution).
The leaves hold how many blocks of a source each shard gets; shards take
disjoint runs of the source's permuted blocks and order their rows by a hash.

A source's running sums are taken in 4,096 buckets of the order key and joined
by the sums of the buckets, so a hot source is spread over many tasks.  What
is kept for each source (a few numbers, and one for each shard) is small and
bounded by the number of sources, which is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsleuth.llm import common

MAX_EPOCHS = 3
BLOCK_WORDS = 16_384
SHARD_WORDS = 2_000_000
TOP_UPS = 6
SEED = 7
MAX_BROADCAST_SOURCES = 100_000


def _order_key(doc_id: Column, size: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def placed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, source, size, pos and start: the number and the first
    word of the row in its source's order.  Rows of equal order key (equal
    doc_id and size) are interchangeable for the mix."""
    size = common.word_count("text")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col("source").alias("_source"),
                       size.alias("_size"), _order_key(F.col("doc_id"), size).alias("_key"))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, 3)).checkpoint()
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_source").alias("b_source"), F.col("_bucket").alias("b_bucket"),
                          F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    own = Window.partitionBy("_source", "_bucket").orderBy("_key")
    rows = rows.select("*", F.row_number().over(own).alias("rn"),
                       F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    joined = rows.join(offsets, F.col("_source").eqNullSafe(F.col("b_source")) & (F.col("_bucket") == F.col("b_bucket")))
    return joined.select(*[f"_k{i}" for i in range(len(keep))], F.col("_source").alias("source"),
                         F.col("_size").alias("size"), (F.col("n0") + F.col("rn") - 1).alias("pos"),
                         (F.col("s0") + F.col("upto") - F.col("_size")).alias("start")).checkpoint()


def targets(rows: DataFrame) -> DataFrame:
    """(sid, source, source_size, target): sources numbered by code point, null
    last, with weights 1, 2, 3, repeating.  All sources stand in one row, an
    array with one entry for each."""
    by = rows.groupBy("source").agg(F.sum("size").alias("size"))
    one = by.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "size"))).alias("a"))
    one = one.select(F.transform("a", lambda x, i: F.struct(
        i.alias("sid"), x["source"].alias("source"), x["size"].alias("source_size"),
        (F.pmod(i, F.lit(3)) + 1).cast("double").alias("weight"),
        (x["size"] * MAX_EPOCHS).cast("double").alias("cap"))).alias("a"))
    one = one.withColumn("r", F.sort_array(F.transform("a", lambda x: F.struct(
        (x["cap"] / x["weight"]).alias("ratio"), x["weight"].alias("weight"), x["cap"].alias("cap")))))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["source_size"])
    weights = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["weight"])
    left = F.aggregate("r", F.struct(total.alias("t"), weights.alias("w")), lambda s, x: F.when(
        x["ratio"] * s["w"] < s["t"], F.struct((s["t"] - x["cap"]).alias("t"), (s["w"] - x["weight"]).alias("w")))
        .otherwise(s))
    one = one.withColumn("left", left).withColumn("level", F.when(F.col("left.w") > 0, F.col("left.t") / F.col("left.w")))
    return one.select(F.explode("a").alias("x"), "level").select(
        "x.sid", "x.source", "x.source_size",
        F.least(F.col("x.cap"), F.col("level") * F.col("x.weight")).alias("target"))


def _sid_join(rows: DataFrame, sources: DataFrame, small: bool, *cols: str) -> DataFrame:
    side = sources.select(F.col("source").alias("_s"), "sid", *cols)
    return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def quotas(rows: DataFrame, sources: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with sid and copies, sources with epochs and rest).  Leading rows
    that fit into the rest of a target are taken once more, then the largest
    row that still fits, ``TOP_UPS`` times."""
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = _sid_join(rows, sources, small, "epochs", "rest")
    rows = rows.withColumn("extra", (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.col("rest"))).checkpoint()
    got = rows.where("extra").groupBy("sid").agg(F.sum("size").alias("got"))
    open_ = rows.where("NOT extra AND size > 0").select("sid", "pos", "size")
    need = sources.select("sid", "rest").join(got, "sid", "left").select(
        "sid", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("need"), F.array().cast("array<long>").alias("picked"))
    for _ in range(TOP_UPS):  # one row for each source; picked holds at most TOP_UPS positions
        fit = open_.join(F.broadcast(need) if small else need, "sid").where(
            (F.col("size") <= F.col("need")) & ~F.array_contains("picked", F.col("pos")))
        best = fit.groupBy("sid").agg(F.max(F.struct("size", "pos")).alias("b"))
        need = need.join(best, "sid", "left").select(
            "sid", (F.col("need") - F.coalesce("b.size", F.lit(0))).alias("need"),
            F.when(F.col("b").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("b.pos"))).alias("picked"))
    need = need.checkpoint()
    rows = rows.join(F.broadcast(need.select("sid", "picked")) if small else need.select("sid", "picked"), "sid")
    extra = F.col("extra") | F.array_contains("picked", F.col("pos"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra.cast("int")).otherwise(0)
    return rows.withColumn("copies", copies).drop("extra", "picked", "rest"), sources


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) * F.lit(2.0 ** -53)


def hypergeometric(pool: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of good ones among ``drawn`` from ``pool``, by inversion at ``u``.
    Weights follow from the ratio of neighbouring probabilities, in logs.

    Only values near the mean are walked: by Hoeffding's bound those further
    from it than sqrt(20 n), n the least of what is drawn, left, good and bad,
    hold less than 2 exp(-40), below the step of ``u``.  So 10^9 blocks take
    some 300,000 steps."""
    least = F.greatest(F.lit(0).cast("long"), drawn - (pool - good))
    most = F.least(drawn, good)
    mean = drawn.cast("double") * good / F.greatest(pool, F.lit(1))
    reach = F.sqrt(20.0 * F.least(drawn, pool - drawn, good, pool - good)) + 2
    low = F.greatest(least, F.floor(mean - reach)).cast("long")
    high = F.least(most, F.ceil(mean + reach)).cast("long")
    ks = F.sequence(low, high)

    def step(k: Column) -> Column:  # log p(k + 1) - log p(k); null past the end
        return F.log((good - k) * (drawn - k)) - F.log((k + 1) * (pool - good - drawn + k + 1))

    def grow(s: Column, k: Column) -> Column:
        return s["lw"] + F.when(k < high, step(k)).otherwise(0.0)

    top = F.aggregate(ks, F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("top")), lambda s, k: F.struct(
        grow(s, k).alias("lw"), F.greatest(s["top"], s["lw"]).alias("top")), lambda s: s["top"])

    def search(top: Column) -> Column:
        total = F.aggregate(ks, F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum")), lambda s, k: F.struct(
            grow(s, k).alias("lw"), (s["sum"] + F.exp(s["lw"] - top)).alias("sum")), lambda s: s["sum"])
        return F.transform(F.array(total), lambda total: F.aggregate(
            ks, F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at")),
            lambda s, k: F.struct(
                grow(s, k).alias("lw"), (s["sum"] + F.exp(s["lw"] - top)).alias("sum"),
                F.when(s["at"].isNull() & (s["sum"] + F.exp(s["lw"] - top) >= u * total), k)
                .otherwise(s["at"]).alias("at")),
            lambda s: F.coalesce(s["at"], high)))[0]
    return F.when(low >= high, low).otherwise(F.transform(F.array(top), search)[0])


def split_tree(blocks: DataFrame, depth: int) -> DataFrame:
    """(shard, sid, n): blocks of each source for each of ``2 ** depth`` shards.

    ``blocks`` has (sid, quota).  A node is a row with its number of blocks and
    an array of quotas; each level splits every node in two."""
    nodes = blocks.agg(F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("a")).select(
        F.lit(0).cast("long").alias("node"), F.transform("a", lambda x: x["sid"]).alias("sids"),
        F.transform("a", lambda x: x["quota"]).alias("counts"))
    for level in range(depth):
        size = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        nodes = nodes.withColumn("size", size)
        start = F.struct(F.col("size").alias("pool"), F.floor(F.col("size") / 2).cast("long").alias("drawn"),
                         F.array().cast("array<long>").alias("out"))

        def draw(s: Column, i: Column) -> Column:
            have = F.element_at("counts", i)
            got = hypergeometric(s["pool"], have, s["drawn"], _uniform(F.lit(level), F.col("node"), i))
            return F.transform(F.array(got), lambda g: F.struct(
                (s["pool"] - have).alias("pool"), (s["drawn"] - g).alias("drawn"),
                F.concat(s["out"], F.array(g)).alias("out")))[0]
        nodes = nodes.withColumn("left", F.when(F.size("counts") > 0, F.aggregate(
            F.sequence(F.lit(1), F.size("counts")), start, draw, lambda s: s["out"])).otherwise(F.col("counts")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
                         F.struct((F.col("node") * 2 + 1).alias("node"),
                                  F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")))
        nodes = nodes.select("sids", F.explode(halves).alias("h")).select("h.node", "sids", "h.counts").checkpoint()
    return nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("sids", "counts")).alias("x")).select(
        "shard", F.col("x.sids").alias("sid"), F.col("x.counts").alias("n"))


def draws(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, drawn).

    rows: one for each row of ``docs``: ``_k0``.. (the columns ``keep``), size,
    sid, pos, copies.  drawn: one for each copy that the mix takes: sid, pos,
    copy, shard, and its place among the shard's rows."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = placed(docs, keep)
    sources = targets(rows).checkpoint()
    count, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    small = count <= MAX_BROADCAST_SOURCES
    rows, sources = quotas(rows, sources, small)
    rows = rows.checkpoint()
    depth = max(0, (-(-total // SHARD_WORDS) - 1).bit_length())

    copy = rows.where("copies > 0").select("sid", "pos", "size", "epochs", F.col("start"), F.explode(
        F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    copy = copy.withColumn("block", F.floor(F.col("start") / BLOCK_WORDS))
    # number the blocks that an epoch really draws, then run through the epochs
    used = copy.select("sid", "copy", "block").distinct()
    order = Window.partitionBy("sid").orderBy("copy", F.xxhash64(F.lit(SEED), "sid", "copy", "block"), "block")
    used = used.select("sid", "copy", "block", (F.row_number().over(order) - 1).cast("long").alias("draw")).checkpoint()
    quota = used.groupBy("sid").agg(F.count(F.lit(1)).alias("quota"))
    leaves = split_tree(quota, depth)
    run = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = leaves.withColumn("first", F.coalesce(F.sum("n").over(run), F.lit(0))).where("n > 0").select(
        "sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    placed_blocks = used.join(dealt, ["sid", "draw"]).select("sid", "copy", "block", "shard")
    drawn = copy.join(placed_blocks, ["sid", "copy", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "shard", "sid", "pos", "copy"),
                                                "sid", "pos", "copy")
    drawn = drawn.select("sid", "pos", "copy", "shard", F.row_number().over(local).alias("place"))
    return rows, sources, drawn


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target,
    taken (words drawn, repeats counted).

    Null texts have size 0 and are never drawn; null sources are one source,
    the last.  Rows that share doc_id and size are ordered at random among
    themselves; repeated rows are rows of their own.  If all sizes are 0, so
    are the targets.  An empty table gives an empty one; other columns are not
    read."""
    rows, sources, drawn = draws(docs)
    taken = drawn.groupBy("sid", "pos").agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(taken, ["sid", "pos"], "left").drop("source")
    side = sources.select("sid", "source_size", "target")
    return out.join(side, "sid").select(
        F.col("_k0").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` for every drawn copy, with
    copy, shard and place (the row's place within its shard).  Columns of those
    names in ``docs`` are replaced.

    Rows are recognised by a hash of all their columns; rows equal in every
    column are drawn one by one and share one text.  Texts are shuffled once,
    to meet their draws.  See ``mixed_sizes`` for nulls and ties."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*cols, F.xxhash64(*cols).alias("__llm_r1"),
                         F.xxhash64(F.lit("second"), *cols[::-1]).alias("__llm_r2"))
    rows, _, drawn = draws(marked, keep=("__llm_r1", "__llm_r2"))
    spots = drawn.join(rows.select("sid", "pos", F.col("_k0").alias("m1"), F.col("_k1").alias("m2")), ["sid", "pos"])
    spots = spots.select("m1", "m2", F.col("copy").alias("__llm_copy"), F.col("shard").alias("__llm_shard"),
                         F.col("place").alias("__llm_place"))
    one = Window.partitionBy("__llm_r1", "__llm_r2").orderBy(F.lit(0))
    text = marked.withColumn("__llm_n", F.row_number().over(one)).where("__llm_n = 1")
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "shard", "place")]
    return text.join(spots, (F.col("__llm_r1") == F.col("m1")) & (F.col("__llm_r2") == F.col("m2"))).select(
        *names, F.col("__llm_copy").alias("copy"), F.col("__llm_shard").alias("shard"),
        F.col("__llm_place").alias("place"))


def _sql() -> str:
    steps = ""
    for i in range(TOP_UPS):
        steps += f""",
b{i} AS (SELECT n.sid, n.need, n.picked, max(struct_pack(size := o.size, pos := o.pos)) AS b
        FROM n{i} n LEFT JOIN o ON o.sid = n.sid AND o.size <= n.need AND NOT list_contains(n.picked, o.pos)
        GROUP BY n.sid, n.need, n.picked),
n{i + 1} AS (SELECT sid, need - coalesce(b.size, 0) AS need,
        CASE WHEN b IS NULL THEN picked ELSE list_append(picked, b.pos) END AS picked FROM b{i})"""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS key FROM d),
p AS (SELECT *, row_number() OVER w - 1 AS pos, sum(size) OVER w - size AS start FROM k
      WINDOW w AS (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
c AS (SELECT *, (sid % 3 + 1)::DOUBLE AS weight, {MAX_EPOCHS}.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio,
             (SELECT sum(source_size) FROM c)::DOUBLE - coalesce(sum(cap) OVER w, 0) AS t,
             (SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER w, 0) AS v
      FROM c WINDOW w AS (ORDER BY cap / weight, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(t / v) AS level FROM (SELECT t, v FROM r WHERE NOT ratio * v < t ORDER BY ratio, weight, cap LIMIT 1)),
g AS (SELECT sid, source, source_size, least(cap, (SELECT level FROM l) * weight) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
q AS (SELECT *, target - epochs * source_size AS rest FROM e),
x AS (SELECT p.doc_id, p.size, p.pos, q.*, p.size > 0 AND p.start + p.size <= q.rest AS extra
      FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source),
o AS (SELECT sid, pos, size FROM x WHERE NOT extra AND size > 0),
n0 AS (SELECT q.sid, q.rest - coalesce(any_value(y.got), 0) AS need, CAST([] AS BIGINT[]) AS picked
       FROM q LEFT JOIN (SELECT sid, sum(size) AS got FROM x WHERE extra GROUP BY sid) y ON q.sid = y.sid
       GROUP BY q.sid, q.rest){steps}
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN extra OR list_contains(n{TOP_UPS}.picked, pos) THEN 1 ELSE 0 END) AS taken
FROM x JOIN n{TOP_UPS} ON x.sid = n{TOP_UPS}.sid
"""


SQL = _sql()
