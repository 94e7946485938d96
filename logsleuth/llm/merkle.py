"""Merkle manifest of a dataset as a content-addressed graph.

Documents are leaves; within a source they ascend by doc_id, and every three
consecutive nodes become one until a source has one node left, its subroot.
The subroots, ordered by source, become the root by the same rule.  Each
level is one aggregate over (tree, place div 3) and is stored as records
(height, digest, children).

Proofs come from the stored records alone: requests start at the root and
descend by the digits of their ranks to base three.  At each height one join
with the records finds the children of a request's node; the digit picks one,
the others are collected.  Requests that share the digits so far move as one
row, so a level has as many rows as it has nodes, and all rows of a join have
their own key.  Segments were collected from the root down, so they are
reversed at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsleuth.llm import common
from logsleuth.operators.ordering import global_position

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:binary,after:binary>>"


def _part(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a document; ``text`` stands for its text column."""
    parts = [_part(text if text is not None and c == "text" else F.col(c)) for c in COLUMNS]
    return F.sha2(F.concat(*parts), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _depth(n: Column) -> Column:
    """Number of levels above the leaves of a tree of ``n`` leaves."""
    return sum((F.when(n > ARITY ** k, 1).otherwise(0) for k in range(40)), F.lit(0))  # 3 ** 40 passes a long


class Manifest:
    """The stored graph: ``leaves`` (tree, place and the columns given),
    ``sources`` (tree, part, n, depth), ``records`` by kind of tree and height,
    and the root digest (None without documents)."""

    def __init__(self, rows: DataFrame, source: str, order: list[str], leaf: str):
        """``rows`` has one row for each leaf; ``source`` is its source as text
        that is never null, ``order`` sorts leaves inside and across sources,
        ``leaf`` is the hex digest."""
        self.spark: SparkSession = rows.sparkSession
        placed = common.stored(global_position(rows, order, "pos"), "merkle-leaves")
        sources = placed.groupBy(source).agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
        sources = sources.withColumn("depth", _depth(F.col("n")))
        self.sources = common.stored(global_position(sources, ["start"], "tree"), "merkle-sources")
        self.leaves = common.look_up(placed, source, "pos", self.sources, "s").select(
            *rows.columns, F.col("s.tree").alias("tree"), (F.col("pos") - F.col("s.start")).alias("place"),
            F.col("s.depth").alias("depth"))
        self.leaves = common.stored(self.leaves, "merkle-ranks")
        self.top, self.n_sources = self.sources.agg(F.max("depth"), F.count(F.lit(1))).first()
        self.root = None
        if self.n_sources:
            self.inner, roots = self._raise(self.leaves.select("tree", "place", "depth", F.unhex(leaf).alias("digest")), self.top)
            self.subroots = common.stored(roots, "merkle-subroots")
            self.outer_top = self.sources.agg(F.lit(1)).select(_depth(F.lit(self.n_sources).cast("long"))).first()[0]
            self.outer, last = self._raise(self.subroots.select(
                F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(self.outer_top).alias("depth"),
                "digest"), self.outer_top)
            self.root = bytes(last.first()["digest"])

    def _raise(self, level: DataFrame, top: int) -> tuple[list[DataFrame], DataFrame]:
        """(records of each height, the last node of each tree)."""
        records, ends = [], level.where("depth = 0").select("tree", "digest")
        for height in range(top):
            runs = level.where(F.col("depth") > height).groupBy(
                "tree", F.expr(f"place div {ARITY}").alias("place"), "depth").agg(
                F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("c"))
            kids = F.transform("c", lambda x: x["digest"])
            digest = F.unhex(F.sha2(F.array_join(F.transform(kids, _hex), ""), 256))
            level = common.stored(runs.select("tree", "place", "depth", digest.alias("digest"), kids.alias("children")),
                                  "merkle-level")
            records.append(level.select("digest", "children"))
            ends = ends.union(level.where(F.col("depth") == height + 1).select("tree", "digest"))
        return records, ends

    def _descend(self, requests: DataFrame, records: DataFrame) -> DataFrame:
        """Requests (tree, place, digest, path, ...) one height further down."""
        # equal nodes have equal children: one record serves them all
        records = records.groupBy("digest").agg(F.first("children").alias("children"))
        found = requests.join(records.hint("merge"), "digest")
        rest = [c for c in requests.columns if c not in ("digest", "place", "path")]
        digit, kids = F.col("digit"), F.col("children")
        none = F.lit(b"")
        joined = lambda part: F.aggregate(part, none, lambda a, x: F.concat(a, x))
        return found.select(*rest, "place", "path", "children", F.posexplode("children").alias("digit", "child")).select(
            *rest, F.col("child").alias("digest"), (F.col("place") * ARITY + digit).alias("place"),
            F.concat("path", F.array(F.struct(joined(F.slice(kids, 1, digit)).alias("before"),
                                              joined(F.slice(kids, digit + 2, ARITY)).alias("after")))).alias("path"))

    def proofs(self) -> DataFrame:
        """(tree, place, digest, path) for every leaf: ``path`` has the
        siblings at each level from the leaf up, as bytes before and after."""
        start = self.spark.range(1).select(F.lit(self.root).alias("digest"), F.lit(0).cast("long").alias("place"),
                                           F.array().cast(_PATH).alias("path"))
        for records in reversed(self.outer):
            start = self._descend(start, records)
        tops = start.select(F.col("place").alias("tree"), "digest", "path").join(
            self.sources.select("tree", "depth"), "tree").select("tree", "depth", "digest", F.lit(0).cast("long").alias("place"), "path")
        if self.top:
            tops = tops.checkpoint()  # each depth of source enters at its own height
        now = None
        for height in reversed(range(self.top)):
            enter = tops.where(F.col("depth") == height + 1)
            now = self._descend(enter if now is None else now.unionByName(enter), self.inner[height])
        flat = tops.where("depth = 0")
        now = flat if now is None else now.unionByName(flat)
        return now.select("tree", "place", "digest", F.reverse("path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest (hex) gives with its siblings."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(_hex(s["before"]), acc, _hex(s["after"])), 256))


def verify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Where crc32 of the decimal doc_id is even, the row is checked as if its
    text had lost its line feeds: ``folded_root`` is what that text and the
    original siblings give, ``verified`` whether it is the root.  A null doc_id
    comes first in its source and is not tampered with; a null source is the
    first source; repeated rows are leaves of their own.  An empty table gives
    an empty one; other columns are not read."""
    spark = docs.sparkSession
    common.prepare(spark)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", _part(F.col("source")).alias("part"), leaf_digest().alias("leaf"),
                       leaf_digest(cut).alias("seen"))
    rows = common.stored(rows, "merkle-digests")
    graph = Manifest(rows, "part", ["source", "doc_id", "leaf"], "leaf")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if graph.root is None:
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, verified boolean")
    proofs = graph.proofs().select("tree", "place", "digest", "path")
    leaves = graph.leaves.select("doc_id", "leaf", "seen", "tree", "place")
    trees = graph.subroots.select(F.col("tree").cast("string").alias("key"), F.hex("digest").alias("subroot")).join(
        graph.sources.select(F.col("tree").cast("string").alias("key"), "n"), "key")
    out = leaves.join(proofs, ["tree", "place"]).where(F.lower(F.hex("digest")) == F.col("leaf"))
    out = out.withColumns({"key": F.col("tree").cast("string"), "root": F.lit(graph.root.hex())})
    out = common.look_up(out, "key", "place", common.stored(trees, "merkle-trees"), "t")
    whole = F.aggregate("path", F.lit(""), lambda a, s: F.concat(a, _hex(s["before"]), _hex(s["after"])))
    folded = fold(F.col("seen"), F.col("path"))
    return out.select("doc_id", "leaf", F.lower("t.subroot").alias("subroot"), "root", F.sha2(whole, 256).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same rows in SQL: levels written out, with the siblings and the
    folded digest carried upwards by every document."""
    def part(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    byte = "[{}]".format(", ".join(["0"] * 8))
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
           f"lambda c, b: list_reduce(list_prepend(xor(c, b), {byte}::BIGINT[]), "
           "lambda x, z: xor(x // 2, 3988292384 * (x % 2)))), 4294967295::BIGINT)")

    def leaf(text):
        return "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    ctes = [f"d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t2 FROM documents)",
            f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('t2')} AS seen FROM d)",
            "s0 AS (SELECT doc_id, leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER "
            "(PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, seen AS fold, '' AS proof FROM l)"]

    def levels(name, key, count):
        # a node is a group of rows with one (tree, p); a tree of one node stays as it is
        for k in range(count):
            a, b = f"{name}{k}", f"{name}{k + 1}"
            ctes.append(f"{a}n AS (SELECT {key} AS tree, p, any_value(h) AS h FROM {a} GROUP BY ALL)")
            ctes.append(f"{a}g AS (SELECT tree, p // 3 AS q, list(h ORDER BY p) AS hs, (SELECT count(*) FROM {a}n x WHERE x.tree = y.tree) AS n "
                        f"FROM {a}n y GROUP BY ALL)")
            before, after = "array_to_string(hs[1:(p % 3)::INT], '')", "array_to_string(hs[(p % 3)::INT + 2:3], '')"
            keep = ", ".join(c for c in (("tree",) if key == "tree" else ("tree", "subroot")))
            ctes.append(f"{b} AS (SELECT doc_id, leaf, {', '.join('r.' + c for c in keep.split(', '))}, CASE WHEN n = 1 THEN p ELSE q END AS p, "
                        "CASE WHEN n = 1 THEN h ELSE sha256(array_to_string(hs, '')) END AS h, "
                        f"CASE WHEN n = 1 THEN fold ELSE sha256({before} || fold || {after}) END AS fold, "
                        f"CASE WHEN n = 1 THEN proof ELSE proof || {before} || {after} END AS proof "
                        f"FROM {a} r JOIN {a}g g ON g.tree = {'r.' + key if key == 'tree' else key} AND g.q = r.p // 3)")
        return f"{name}{count}"
    last = levels("s", "tree", 14)
    ctes.append(f"t0 AS (SELECT doc_id, leaf, tree, h AS subroot, tree - 1 AS p, h, fold, proof FROM {last})")
    last = levels("t", "0", 8)
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, "
            f"fold AS folded_root, fold = h AS verified FROM {last}")


SQL = _sql()
