"""Per-key look-back windows.

Semantics: for each row at time ``t`` (whole ms), aggregate the rows with the
same key whose time lies in ``[t - window_ms, t]`` (both ends inclusive, peers
at the same ms included).

Two physical forms are offered:

``method="prefix"`` (default, skew-proof)
    A windowed sum equals a prefix sum over +v at ``s`` and -v at
    ``s + window_ms + 1``, and it is the same for all rows of a key at one ms.
    So the deltas are summed by (key, ms) first, on the map side and then over
    all tasks; what follows are points (key, ms, sums) without any other column:

    * points are partitioned by (key, time bucket of ``bucket_ms``), with a
      running sum inside; a bucket holds ``bucket_ms`` points at most, however
      many rows a burst has;
    * the totals of the buckets (one row per key and bucket) are prefix-summed
      over the bucket index and added as an offset;
    * rows get their point by a join on (key, ms).  Columns that are not asked
      for later are pruned from it, and so from its shuffle.

    A key that holds a third of all rows is spread by ms before the join and
    by buckets after it, also if all of them fall into one minute.

    Distinct counts (W3) turn each (key, value) into merged activity
    intervals: +1 where a gap larger than the window opens, -1 one window
    after the last occurrence.  Two times in one window-wide bucket are never
    farther apart than the window, so a gap lies between buckets only: the
    first and last time of each (key, value, bucket), one aggregate, are all
    that is compared.  The marks then go through the same prefix sum.

``method="range"``
    ``sum/count(...).over(partitionBy(key).orderBy(ms).rangeBetween(-w, 0))``
    and ``size(collect_set(v))`` over the same frame.  One shuffle, but one
    task per key: for small or evenly keyed inputs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_BUCKET_MS = 60_000


def _prefix_sums(deltas: DataFrame, value_cols: list[str], bucket_ms: int) -> DataFrame:
    """Running sums of ``value_cols`` per ``_k`` over ``_t`` (all deltas of one
    ms included) at the points that have a row: (_k, _t, value_cols).

    ``deltas``: (_k, _t, value_cols..., _at: whether a row stands there)."""
    points = deltas.withColumn("_b", F.floor(F.col("_t") / bucket_ms)).groupBy("_k", "_b", "_t").agg(
        F.max("_at").alias("_at"), *[F.sum(c).alias(c) for c in value_cols])
    # offsets are asked for where a row stands; both branches so read the same
    # columns of the points, in one order, and their shuffle is used twice
    totals = points.groupBy("_k", "_b").agg(F.max("_at").alias("_at"), *[F.sum(c).alias(c) for c in value_cols])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_at").alias("_oat"), F.col("_k").alias("_ok"), F.col("_b").alias("_ob"),
                            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{c}") for c in value_cols])
    offsets = offsets.where("_oat").drop("_oat")
    inside = Window.partitionBy("_k", "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    running = points.select("_k", "_b", "_t", "_at", *[F.sum(c).over(inside).alias(f"_r_{c}") for c in value_cols])
    out = running.where("_at").join(
        offsets, F.col("_k").eqNullSafe(F.col("_ok")) & (F.col("_b") == F.col("_ob")), "left")
    return out.select("_k", "_t", *[(F.col(f"_r_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0))).alias(c)
                                    for c in value_cols])


def _at_rows(df: DataFrame, key: str, ms: str, sums: DataFrame, out: dict[str, Column]) -> DataFrame:
    """``df`` with the values of its points."""
    met = df.join(sums, F.col(key).eqNullSafe(F.col("_k")) & F.col(ms).eqNullSafe(F.col("_t")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[v.alias(c) for c, v in out.items()])


def window_counts(df: DataFrame, key: str, ms: str, window_ms: int,
                  sums: dict[str, str] | None = None, count_out: str = "window_count",
                  method: str = "prefix", bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Add ``count_out`` (rows in window) and one sum column per
    ``sums`` entry (``{output: input column}``; null inputs add 0)."""
    sums = sums or {}
    if method == "range":
        w = Window.partitionBy(key).orderBy(ms).rangeBetween(-window_ms, 0)
        cols = {count_out: F.count(F.lit(1)).over(w)}
        cols.update({o: F.coalesce(F.sum(i).over(w), F.lit(0)) for o, i in sums.items()})
        return df.withColumns(cols)
    names = ["_n"] + [f"_s{i}" for i in range(len(sums))]
    vals = [F.lit(1).cast("bigint")] + [F.coalesce(F.col(c), F.lit(0)).cast("bigint")
                                        for c in sums.values()]
    # each row opens its contribution at ms and closes it one window later
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign")
    base = df.select(F.col(key).alias("_k"), F.col(ms).alias("_ms"), *[v.alias(n) for v, n in zip(vals, names)], side)
    deltas = base.select(
        "_k", F.when(F.col("_sign") == 1, F.col("_ms")).otherwise(F.col("_ms") + window_ms + 1).alias("_t"),
        *[(F.col(n) * F.col("_sign")).alias(n) for n in names], (F.col("_sign") == 1).alias("_at"))
    out = {count_out: F.col("_n"), **{o: F.col(n) for n, o in zip(names[1:], sums)}}
    return _at_rows(df, key, ms, _prefix_sums(deltas, names, bucket_ms), out)


def window_distinct(df: DataFrame, key: str, ms: str, value: str, window_ms: int,
                    out: str = "window_distinct", method: str = "prefix",
                    bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Number of distinct non-null ``value`` in the window."""
    if method == "range":
        w = Window.partitionBy(key).orderBy(ms).rangeBetween(-window_ms, 0)
        return df.withColumn(out, F.size(F.collect_set(value).over(w)))
    wb = F.floor(F.col(ms) / window_ms)
    # partial on the map side, so a task hands a port over once for each bucket
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v"), wb.alias("_wb")).agg(
        F.min(ms).alias("_first"), F.max(ms).alias("_last"))
    ob = Window.partitionBy("_k", "_v").orderBy("_wb")
    seen = seen.select("_k", "_first", "_last", F.lag("_last").over(ob).alias("_prev"), F.lead("_first").over(ob).alias("_next"))
    opens = F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") > window_ms)
    closes = F.col("_next").isNull() | (F.col("_next") - F.col("_last") > window_ms)
    marks = seen.select(
        "_k",
        F.explode(F.array(
            F.when(opens, F.struct(F.col("_first").alias("t"), F.lit(1).cast("bigint").alias("d"))),
            F.when(closes, F.struct((F.col("_last") + window_ms + 1).alias("t"),
                                    F.lit(-1).cast("bigint").alias("d"))))).alias("_m"))
    marks = marks.where(F.col("_m").isNotNull()).select(
        "_k", F.col("_m.t").alias("_t"), F.col("_m.d").alias("_d"), F.lit(False).alias("_at"))
    rows = df.select(F.col(key).alias("_k"), F.col(ms).alias("_t"), F.lit(0).cast("bigint").alias("_d"),
                     F.lit(True).alias("_at"))
    return _at_rows(df, key, ms, _prefix_sums(marks.union(rows), ["_d"], bucket_ms), {out: F.col("_d").cast("int")})
