"""Phrase collocations from a weighted de Bruijn graph.

Edges of the graph are word sequences of the longest length, nodes the two
shorter sequences they overlap in; the weight of an edge is its number of
occurrences.  Only edges are counted in the text.  The count of any shorter
sequence is the flow out of it, the sum of what continues it, plus the pieces
that end with it.  Chains of nodes with one edge in and one out of equal weight
are compacted to a path, whose inner nodes have the path's weight as count.

A phrase is frequent only if the pairs and triples of neighbouring words in it
are, so a sequence is cut before the word with which a rare one ends.  Cuts are
piece ends like any other: no count of a frequent phrase changes, and the graph
holds little more than frequent phrases.  What is frequent is sent to the tasks
as bit maps of a fixed size; bits shared by chance keep a rare pair and lose
nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logsleuth.llm import common, hashing

LONGEST = 5
MIN_COUNT = 100
KEEP = 2000            # phrases returned for a language
SLICE_BYTES = 4 << 20  # text that a task counts at a time
MAP_BITS = 27          # size of a bit map: 16 MB
_CHUNK_BITS = 16
_ROWS = 1 << 16        # rows that a task hands over at a time

# space and tab part words, the other delimiters end pieces; A-Z are lower-cased
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[9] = 32
_TABLE[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10


class _Pieces:
    """Word hashes of some texts, with the piece and the language of each."""

    def __init__(self, langs: pa.Array, text: pa.Array):
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        text = pa.concat_arrays([text])  # offsets from the start of the data
        _, offsets, data = text.buffers()
        plain = _TABLE[np.frombuffer(data, np.uint8)] if data is not None else np.empty(0, np.uint8)
        text = pa.Array.from_buffers(pa.large_binary(), len(text), [None, offsets, pa.py_buffer(plain)], 0, text.offset)
        self.words = w = hashing.Words(text, fold=False)
        names = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        row = np.repeat(np.arange(len(w)), np.diff(w.first))
        self.lang = names.indices.to_numpy(zero_copy_only=False)[row]
        self.piece = np.searchsorted(np.flatnonzero(w.data == 10), w.start) + row
        salt = np.array([xxhash.xxh64(x.encode()).intdigest() for x in self.langs], np.uint64)
        self.salt = salt[self.lang] if len(row) else np.empty(0, np.uint64)

    def word_keys(self) -> np.ndarray:
        return hashing.mix(self.words.hash ^ self.salt)

    def within(self, n: int) -> np.ndarray:
        """Words from which ``n`` words stand in one piece."""
        last = self.piece[n - 1:]
        return np.flatnonzero(self.piece[:len(last)] == last)


def _slices(batches, limit: int = SLICE_BYTES):
    """The batches (lang, text) of a task as arrays of about ``limit`` bytes each."""
    held, size = [], 0
    for batch in batches:
        for at, part in hashing.slices(batch.column(1).cast(pa.large_binary()), limit):
            held.append((batch.column(0)[at:at + len(part)].cast(pa.string()), part))
            size += pc.sum(pc.binary_length(part)).as_py() or 0
            if size >= limit:
                yield _Pieces(pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]))
                held, size = [], 0
    if held:
        yield _Pieces(pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]))


def _tally(*keys: np.ndarray) -> pa.RecordBatch:
    distinct, count = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])


def _bit_map(keys: DataFrame, bits: int) -> bytes:
    """Bit map of 2 ** ``bits`` places with the places of ``key`` set: of a
    fixed size, whatever the number of keys."""
    place = F.shiftrightunsigned("key", 64 - bits)
    small = min(_CHUNK_BITS, bits)
    chunks = keys.select(place.alias("p")).distinct().select(
        F.shiftright("p", small).alias("chunk"), F.col("p").bitwiseAND((1 << small) - 1).cast("int").alias("low"))

    def pack(table: pa.Table) -> pa.Table:
        full = np.zeros(1 << small, bool)
        full[table.column("low").to_numpy()] = True
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()),
                         "data": pa.array([np.packbits(full).tobytes()], pa.binary())})
    out = bytearray(1 << max(bits - 3, 0))
    width = 1 << max(small - 3, 0)
    for row in chunks.groupBy("chunk").applyInArrow(pack, "chunk long, data binary").toLocalIterator():
        out[row["chunk"] * width:(row["chunk"] + 1) * width] = row["data"]
    return bytes(out)


def _in_map(keys: np.ndarray, bit_map: np.ndarray, bits: int) -> np.ndarray:
    place = keys >> np.uint64(64 - bits)
    return (bit_map[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _counted(rows: DataFrame, work) -> DataFrame:
    """Sum of the tallies (key, n) that ``work`` gives for each slice."""
    def run(batches):
        for pieces in _slices(batches):
            if len(pieces.words.hash):
                tally = work(pieces)
                for at in range(0, tally.num_rows, _ROWS):
                    yield tally.slice(at, _ROWS)
    # dealt out before they are summed: no hash table stands beside the Python worker of a task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(run, "key long, n long").repartition(parts, "key").groupBy("key").agg(F.sum("n").alias("n"))


def _spread(spark, data: bytes):
    """A broadcast array; of a fixed size, see ``_bit_map``."""
    return spark.sparkContext.broadcast(np.frombuffer(data, np.uint8))


def sequences(rows: DataFrame, longest: int, min_count: int, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(edges and piece ends (lang, k, gram, n), words of each language (lang, total)).

    ``rows`` (lang, text).  For every frequent word the sequence from it to the
    end of its piece or to a cut, of at most ``longest`` words, joined by
    spaces; k is its length."""
    spark = rows.sparkSession

    def often(tally: DataFrame):
        return _spread(spark, _bit_map(tally.where(F.col("n") >= min_count).select("key"), bits))

    def short(p: _Pieces) -> pa.RecordBatch:
        h = p.word_keys()
        return _tally(h, hashing.windows(h, 2)[p.within(2)] if len(h) > 1 else h[:0])
    frequent = often(_counted(rows, short))

    def linked(p: _Pieces, h: np.ndarray) -> np.ndarray:
        """Words from which a frequent pair of a piece goes on."""
        at = p.within(2)
        return at[_in_map(hashing.windows(h, 2)[at], frequent.value, bits)] if len(at) else at

    def at_triples(h: np.ndarray, link: np.ndarray) -> np.ndarray:
        pair = np.zeros(len(h) + 1, bool)
        pair[link] = True
        return np.flatnonzero(pair[:-1] & pair[1:])

    def triples(p: _Pieces) -> pa.RecordBatch:
        h = p.word_keys()
        at = at_triples(h, linked(p, h))
        return _tally(hashing.windows(h, 3)[at] if len(at) else h[:0])
    going_on = often(_counted(rows, triples))

    def grams(p: _Pieces) -> pa.RecordBatch:
        h, n = p.word_keys(), len(p.words.hash)
        known = _in_map(h, frequent.value, bits)
        pair, triple = np.zeros(n + longest, bool), np.zeros(n + longest, bool)
        link = linked(p, h)
        pair[link] = True
        at = at_triples(h, link)
        if len(at):
            triple[at[_in_map(hashing.windows(h, 3)[at], going_on.value, bits)]] = True
        length = 1 + pair[:n].astype(np.int64)
        more = pair[:n].copy()
        for k in range(2, longest):  # a triple two words back goes on to word k
            more &= triple[k - 2:n + k - 2]
            length += more
        words = np.bincount(p.lang, minlength=len(p.langs))
        found = []  # (first word, length, occurrences) of the distinct sequences
        for k in range(1, longest + 1):
            at = np.flatnonzero((length == k) & known)
            if len(at):
                _, first, count = np.unique(hashing.windows(h, k)[at], return_index=True, return_counts=True)
                found.append((at[first], np.full(len(first), k), count))
        at, k, count = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
        data, start, end = p.words.data, p.words.start, p.words.end
        raw = data.tobytes()
        text = [b" ".join(raw[a:b].split()) for a, b in zip(start[at].tolist(), end[at + k - 1].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([p.langs[i] for i in p.lang[at]] + p.langs, pa.string()),
             pa.array(np.concatenate([k, np.zeros(len(words), np.int64)]), pa.int32()),
             pa.array(text + [b""] * len(words), pa.binary()), pa.array(np.concatenate([count, words]), pa.int64())],
            names=["lang", "k", "gram", "n"])

    def run(batches):
        for pieces in _slices(batches):
            if len(pieces.words.hash):
                yield grams(pieces)
    out = rows.mapInArrow(run, "lang string, k int, gram binary, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    out = common.stored(out.withColumn("gram", F.col("gram").cast("string")), "phrase-edges")
    for spent in (frequent, going_on):  # all that used them is stored: executors need not keep them
        spent.destroy()
    # rows of no words have the number of words of a language
    return out.where("k > 0"), out.where("k = 0").select("lang", F.col("n").alias("total"))


def _head(gram: str, k: int):
    return F.substring_index(gram, " ", k)


def _tail(gram: str, k: int):
    return F.substring_index(gram, " ", -k)


def paths(edges: DataFrame, ends: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges (lang, gram, n) compacted: (lang, words, n), one row for each
    unary path.  Two edges follow each other on a path if the node between them
    has no other edge, both have one weight and no piece ends (``ends``: lang,
    gram) with the node; so none starts with it either.  Positions come from pointer doubling, with a number of rounds logarithmic in
    the longest path; edges of a closed ring stay paths of one edge."""
    k = longest - 1
    edges = edges.select("lang", "gram", "n", _head("gram", k).alias("src"), _tail("gram", k).alias("dst"))
    into = edges.groupBy("lang", F.col("dst").alias("node")).agg(
        F.count(F.lit(1)).alias("i"), F.min("gram").alias("before"), F.min("n").alias("w"))
    out = edges.groupBy("lang", F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("o"), F.min("gram").alias("gram"), F.min("n").alias("n"))
    links = into.where("i = 1").join(out.where("o = 1"), ["lang", "node"]).where("w = n AND before <> gram")
    links = links.join(ends.select("lang", F.col("gram").alias("node")), ["lang", "node"], "left_anti")
    state = edges.select("lang", "gram", "n").join(links.select("lang", "gram", "before"), ["lang", "gram"], "left")
    state = common.stored(state.select("lang", "gram", "n", F.coalesce("before", "gram").alias("head"),
                                       F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("at"),
                                       F.col("before").isNull().alias("done")), "phrase-chain")
    left = state.where("NOT done").count()
    while left:
        # only edges whose pointer has not reached the head of a path move on
        open_ = state.where("NOT done")
        step = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("h2"), F.col("at").alias("a2"),
                            F.col("done").alias("d2"))
        moved = open_.join(step, ["lang", "head"]).select(
            "lang", "gram", "n", F.col("h2").alias("head"), (F.col("at") + F.col("a2")).alias("at"), F.col("d2").alias("done"))
        state = common.stored(state.where("done").unionByName(moved), "phrase-chain")
        now = state.where("NOT done").count()
        if now == left:  # the rest are rings
            break
        left = now
    whole = state.where("done").groupBy("lang", "head").agg(
        F.sort_array(F.collect_list(F.struct("at", _tail("gram", 1).alias("word")))).alias("c"), F.min("n").alias("n"))
    more = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda x: x["word"])
    whole = whole.select("lang", F.concat(F.split("head", " "), more).alias("words"), "n")
    return whole.union(state.where("NOT done").select("lang", F.split("gram", " ").alias("words"), "n"))


def counts(sequences: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """Occurrences (lang, gram, n) of the sequences of each length 1..longest,
    derived from the edges and piece ends (lang, k, gram, n)."""
    edges = sequences.where(F.col("k") == longest).select("lang", "gram", "n")
    last = sequences.where(F.col("k") == longest - 1).select("lang", "gram")
    joined = common.stored(paths(edges, last, longest), "phrase-paths")

    def windows(size: int, first: int, last: int):
        """Word sequences of a path that start at ``first`` .. size of path - ``last`` (from 1)."""
        return F.transform(F.sequence(F.lit(first), F.size("words") - F.lit(last)),
                           lambda i: F.array_join(F.slice("words", i, size), " "))
    known = [joined.select("lang", F.explode(windows(longest, 1, longest - 1)).alias("gram"), "n")]
    # the inner nodes of a path have its weight; its first node has the flow of all edges out of it
    k = longest - 1
    inner = joined.where(F.size("words") > longest).select("lang", F.explode(windows(k, 2, longest - 1)).alias("gram"), "n")
    outer = joined.select("lang", F.array_join(F.slice("words", 1, k), " ").alias("gram"), "n")
    for size in range(k, 0, -1):
        ends = sequences.where(F.col("k") == size).select("lang", "gram", "n")
        flow = outer if size == k else known[0].select("lang", _head("gram", size).alias("gram"), "n")
        total = flow.union(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        known.insert(0, common.stored(total.union(inner) if size == k else total, "phrase-counts"))
    return known


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, keep: int = KEEP) -> DataFrame:
    """The first ``keep`` phrases of each language: lang, rank, phrase, a, l, r,
    n, score, n_words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends
    and these into words at spaces and tabs.  A candidate is a phrase of 2 to
    ``longest`` words with a >= ``min_count`` occurrences in pieces of a
    language; each cut after its first words gives l and r, the occurrences of
    the two parts, and floor(1000 a n / (l r)), n being all words of the
    language; the lowest counts (ties: the first cut).  Candidates inside a
    longer one that is as frequent are left out.  Order: score and a
    descending, phrase ascending by bytes.

    A null text is empty, a null lang is ``und``; repeated rows count each; an
    empty table gives an empty one; other columns are not read.  ``docs`` is
    read three times and must give the same rows each time."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    edges, total = sequences(rows, longest, min_count)
    often = None
    for k, table in enumerate(counts(edges, longest), 1):
        part = table.where(F.col("n") >= min_count).select("lang", F.lit(k).alias("k"), "gram", "n")
        often = part if often is None else often.union(part)
    often = common.stored(often, "phrase-often")

    long = often.where("k > 2").select("lang", "k", "n", F.split("gram", " ").alias("w"))
    inside = None
    for size in range(2, longest):
        part = long.where(F.col("k") > size).select("lang", "n", F.explode(F.transform(
            F.sequence(F.lit(1), F.col("k") - (size - 1)),
            lambda i: F.array_join(F.slice("w", i, size), " "))).alias("gram"))
        inside = part if inside is None else inside.union(part)
    # a phrase in a longer one is at least as frequent, so "as frequent" is "equally"
    own = often.where("k > 1").join(inside.distinct(), ["lang", "gram", "n"], "left_anti") if inside is not None \
        else often.where("k > 1")
    cuts = own.select("lang", "gram", F.col("k").alias("n_words"), F.col("n").alias("a"),
                      F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first = often.select("lang", F.col("gram").alias("g1"), F.col("n").alias("l"))
    rest = often.select("lang", F.col("gram").alias("g2"), F.col("n").alias("r"))
    cuts = cuts.withColumns({"g1": F.expr("substring_index(gram, ' ', cut)"),
                             "g2": F.expr("substring_index(gram, ' ', cut - n_words)")})
    cuts = cuts.join(first, ["lang", "g1"]).join(rest, ["lang", "g2"]).join(total, "lang")
    cuts = cuts.withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(total as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "gram", "n_words", "a").agg(F.min(F.struct("score", "cut", "l", "r", "total")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "gram"))
    return best.withColumn("rank", rank).where(F.col("rank") <= keep).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "c.l", "c.r",
        F.col("c.total").alias("n"), "c.score", F.col("n_words").cast("long").alias("n_words"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS a FROM p),
tot AS (SELECT lang, sum(len(a))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, a, unnest(range(1, len(a) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(a[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g, range(1, {LONGEST + 1}) AS x(k)
      WHERE i + k - 1 <= len(a) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1),
own AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.k > c.k AND b.a >= c.a
        AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT *, unnest(range(1, k)) AS head FROM own),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, head, x.a AS l, y.a AS r, tot.n,
             ((1000::HUGEINT * cut.a * tot.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:head], ' ')
      JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[head + 1:], ' ') JOIN tot ON tot.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) AS o FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score, k::BIGINT AS n_words FROM r WHERE rank <= {KEEP}
"""
