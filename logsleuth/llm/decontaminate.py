"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of
an item and a whole document says little.  Items are partitioned by their
number of shingles into classes (u/2, u], and each class is searched over
document windows of comparable size: blocks of u/2 shingles, joined three by
three.  An item that occurs in a document lies inside one such window, where a
containment of 0.8 gives a Jaccard similarity of at least

    s = 0.8 (u/2) / (1.5 u + 0.2 (u/2)) = 0.25,

whatever the length of the document.  The smallest class has the items of one
and two shingles and blocks of one shingle: here s is at least 1/3.  The signature has ``PERMS`` minima, each
a band of its own; an item is a candidate where any band is equal, which is
missed with probability (1 - s) ** PERMS (below 1e-4).  Block minima are
computed once for the smallest class and merged upwards.  Candidates are
verified by exact shingle containment of the item in the whole document.

An item of fewer than five words has one shingle, the whole item.  These are
looked up by the hash of their words at every place of a text and verified
likewise.

The item index is broadcast behind a check of its size; a larger benchmark is
searched in blocks of items, one pass over the documents for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsleuth.llm import common, hashing

SHINGLE = 5
CONTAINMENT = 0.8
PERMS = 34
FINEST = 1  # shingles in a block of the smallest class that may be
MAX_INDEX_ITEMS = 100_000
MAX_INDEX_BYTES = 64 << 20
_CHUNK = 1 << 16  # shingles hashed at a time
_LOW = np.uint64(0xFFFF)
_RUN = 1 << 20  # bytes of text searched together


def _keys() -> np.ndarray:
    return hashing.mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _minima(shingles: np.ndarray, block: int) -> np.ndarray:
    """Array (PERMS, blocks): the minimum of each permutation in each block."""
    at = np.arange(0, len(shingles), block)
    out = np.empty((PERMS, len(at)), np.uint64)
    for i, key in enumerate(_keys()):
        x = (shingles ^ key) * np.uint64(0x9E3779B97F4A7C15)
        out[i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
    return out


def _pairs_up(m: np.ndarray) -> np.ndarray:
    """Blocks of twice the size."""
    if m.shape[1] % 2:
        m = np.concatenate([m, m[:, -1:]], axis=1)
    return np.minimum(m[:, ::2], m[:, 1::2])


def _grams(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(size))))


def _flags(values: np.ndarray) -> np.ndarray:
    """Which low 16 bits occur among the values: a look-up that few windows pass."""
    out = np.zeros(1 << 16, bool)
    out[values & _LOW] = True
    return out


class Index:
    """Signatures of items by size class: class -> (sorted minima, their items,
    flags of the minima) for each permutation.  Items without a five-word
    shingle: number of words -> (sorted hashes, their items).  The texts are
    kept as they are; an item's shingles are made when it is a candidate."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        classes, short = {}, {}
        for n, text in enumerate(self.texts):
            words = hashing.Words(pa.array([text])).hash
            h = hashing.windows(words, SHINGLE)
            if len(h):
                size = FINEST
                while 2 * size < len(h):
                    size *= 2
                classes.setdefault(size, []).append((n, _minima(h, len(h))[:, 0]))
            elif len(words):
                short.setdefault(len(words), []).append((n, hashing.windows(words, len(words))[0]))
        self.classes, self.short = {}, {}
        for size, rows in sorted(classes.items()):
            owner = np.array([n for n, _ in rows], np.int32)
            sig = np.stack([s for _, s in rows])
            order = np.argsort(sig, axis=0, kind="stable")
            self.classes[size] = [(sig[order[:, p], p], owner[order[:, p]], _flags(sig[:, p])) for p in range(PERMS)]
        for size, rows in short.items():
            rows.sort(key=lambda x: x[1])
            self.short[size] = np.array([h for _, h in rows], np.uint64), np.array([n for n, _ in rows], np.int32)

    def _short_candidates(self, words: hashing.Words):
        """(text number, item) where the words of a short item occur."""
        for size, (values, owner) in self.short.items():
            at = hashing.inside(words, size)
            if not len(at):
                continue
            run = hashing.windows(words.hash, size)[at]
            place = np.searchsorted(values, run)
            hit = np.flatnonzero(values[np.minimum(place, len(values) - 1)] == run)
            text = np.searchsorted(words.first, at[hit], "right") - 1
            for pair in np.unique(text * len(values) + place[hit]).tolist():
                d, v = divmod(pair, len(values))
                for n in owner[v:np.searchsorted(values, values[v], "right")].tolist():
                    yield d, n

    def windows(self, shingles: np.ndarray):
        """(first shingle, end, item) of the windows of a run of shingles that
        share a band with an item."""
        minima, size = None, 0
        for want, bands in self.classes.items():
            if minima is None:
                minima, size = _minima(shingles, want), want
            while size < want:
                minima, size = _pairs_up(minima), size * 2
            w = minima.copy()  # three blocks make a window; at the ends, what there is
            np.minimum(w[:, 1:], minima[:, :-1], out=w[:, 1:])
            np.minimum(w[:, :-1], minima[:, 1:], out=w[:, :-1])
            for p, (values, owner, low) in enumerate(bands):
                for at in np.flatnonzero(low[w[p] & _LOW]):
                    x = w[p][at]
                    for n in owner[np.searchsorted(values, x):np.searchsorted(values, x, "right")].tolist():
                        yield (at - 1) * size, (at + 2) * size, n

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text number, item_id, shared shingles, item shingles) for the items
        that the texts of a column contain.  The shingles of all texts stand in
        one run, so the cost of an array operation is spread over many short
        texts; a window over a border is a candidate for every text it touches."""
        words = hashing.Words(column)
        near = set(self._short_candidates(words))
        if self.classes:
            near |= self._long_candidates(words)
        out, have, of, grams = [], {}, -1, {}
        for d, n in sorted(near):
            if d != of:
                text, have, of = (column[d].as_py() or b"").lower().split(), {}, d
            if n not in grams:
                item = self.texts[n].lower().split()
                grams[n] = _grams(item, min(len(item), SHINGLE)), min(len(item), SHINGLE)
            want, size = grams[n]
            if size not in have:
                have[size] = _grams(text, size)
            shared = len(want & have[size])
            if shared >= CONTAINMENT * len(want) - 1e-9:
                out.append((d, self.ids[n], shared, len(want)))
        return out

    def _long_candidates(self, words: hashing.Words) -> set[tuple[int, int]]:
        """(text number, item) of the windows that share a band with an item."""
        at = hashing.inside(words, SHINGLE)
        run = hashing.windows(words.hash, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)
        ends = np.searchsorted(at, words.first[1:])
        full = np.diff(ends, prepend=0) > 0
        over = 4 * max(self.classes)
        near: set[tuple[int, int]] = set()
        for lo in range(0, len(run), _CHUNK):  # chunks overlap by more than a window of the largest class
            a = max(0, lo - over)
            for s, e, n in self.windows(run[a:lo + _CHUNK]):
                first = np.searchsorted(ends, max(0, a + s), "right")
                last = np.searchsorted(ends, min(len(run), a + e) - 1, "right")
                near.update((d, n) for d in range(first, last + 1) if full[d])
        return near


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[int, bytes]]]:
    """The items in blocks that may be broadcast.  The size is read first; a
    benchmark within the bounds is one block, otherwise items are dealt to
    enough blocks by their hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // MAX_INDEX_ITEMS), -(-size // MAX_INDEX_BYTES))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted({(r[0], r[1].encode()) for r in part.collect()})


def contained_items(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document row and test item of which the document holds
    at least 80 % of the distinct five-word shingles: the columns ``keep``,
    item_id, n_shared, n_shingles, containment.

    Words are lower-cased A-Z and cut at blanks.  An item of one to four words
    is one shingle; blank items, null texts and null item_ids are passed over.  Equal items are searched once; an item_id with several
    texts is searched with each.  Repeated document rows give repeated rows;
    documents without a match give none; other columns are not read."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(*keep, "text")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + \
        ", item_id bigint, n_shared bigint, n_shingles bigint, containment double"

    def search(index):
        def run(batches):
            for batch in batches:
                at, found = [], []
                for start, part in hashing.slices(batch.column(len(keep)).cast(pa.large_binary()), _RUN):
                    for d, *hit in index.value.search(part):
                        at.append(start + d)
                        found.append(hit)
                if at:
                    ids, shared, total = (np.array(x, np.int64) for x in zip(*found))
                    kept = batch.select(list(range(len(keep)))).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(ids), pa.array(shared), pa.array(total), pa.array(shared / total)],
                        names=[*keep, "item_id", "n_shared", "n_shingles", "containment"])
        return rows.mapInArrow(run, schema)

    out = None
    for items in _item_blocks(benchmark):
        part = search(spark.sparkContext.broadcast(Index(items)))
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a test item.  Rows are tested and
    dropped where they stand, so nothing is shuffled."""
    spark = docs.sparkSession
    common.prepare(spark)
    out = docs
    at = docs.columns.index("text")

    def keep_clean(df, index):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, part in hashing.slices(batch.column(at).cast(pa.large_binary()), _RUN):
                    clean[[start + hit[0] for hit in index.value.search(part)]] = False
                yield batch.filter(pa.array(clean))
        return df.mapInArrow(run, df.schema)

    for items in _item_blocks(benchmark):
        out = keep_clean(out, spark.sparkContext.broadcast(Index(items)))
    return out


def _sql_words(key: str, table: str) -> str:
    return f"""(SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM {table})"""


SQL = f"""
WITH i AS (SELECT item_id, a FROM {_sql_words('item_id', 'benchmark')}),
t AS (SELECT doc_id, a FROM {_sql_words('doc_id', 'documents')}),
b AS (SELECT DISTINCT item_id, array_to_string(a[p:p + {SHINGLE - 1}], ' ') AS g FROM (
  SELECT item_id, a, unnest(range(1, len(a) - {SHINGLE} + 2)) AS p FROM i)),
d AS (SELECT DISTINCT doc_id, array_to_string(a[p:p + {SHINGLE - 1}], ' ') AS g FROM (
  SELECT doc_id, a, unnest(range(1, len(a) - {SHINGLE} + 2)) AS p FROM t)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
short AS (SELECT DISTINCT item_id, ' ' || array_to_string(a, ' ') || ' ' AS g FROM i WHERE len(a) BETWEEN 1 AND {SHINGLE - 1})
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= {CONTAINMENT} * n_shingles - 1e-9
UNION ALL
SELECT DISTINCT doc_id, item_id, 1::BIGINT, 1::BIGINT, 1::DOUBLE
FROM (SELECT doc_id, ' ' || array_to_string(a, ' ') || ' ' AS x FROM t) JOIN short ON contains(x, g)
"""
