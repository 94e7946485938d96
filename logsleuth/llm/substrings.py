"""Exact substring dedup by fixed-block anchors.

A run of ``LENGTH`` words that occurs twice holds, where it occurs first, a
whole reference block: the non-overlapping runs of ``LENGTH // 2`` words that
start at multiples of that number in each document.  So

1. every rolling window of block length probes the index of reference blocks;
   a window is a hit if its key is a reference block and occurs elsewhere;
2. hits are extended to the ``LENGTH``-word windows around them, and for these
   alone the earliest occurrence (smallest doc_id, then start) is found;
3. words under a window that also starts earlier are removed.  Neighbouring
   windows run together to maximal exact repeats.

Both key tables are spread by key and asked block-wise (``blocks``): a passage
shared by very many documents is one entry for a block of documents, and pairs
of occurrences are never formed.  Keys of windows are 64-bit hashes of word
sequences.  Keys of blocks only choose the windows to look at, so they are cut
to ``SPARE_BITS`` more bits than the text has bytes: chance hits stay rare at
every size and cost a look, never a word.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsleuth.llm import blocks, common, hashing

LENGTH = 20
SPARE_BITS = 12
_SIGN = np.uint64(1 << 63)


def _order(ids: pa.Array) -> np.ndarray:
    """Document ids as unsigned numbers in the same order; null comes first."""
    values = ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    return values.view(np.uint64) ^ _SIGN


def _windows(words: hashing.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = hashing.inside(words, n)
    return at, hashing.windows(words.hash, n)[at] if len(at) else np.empty(0, np.uint64)


def _owner(words: hashing.Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, "right") - 1


def _least(index: np.ndarray, size: int, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest (doc, start) for each index."""
    order = np.lexsort((start, doc, index))
    first = order[np.flatnonzero(np.diff(index[order], prepend=-1))]
    return doc[first], start[first]


def _short(total: int) -> np.uint64:
    """Mask that keeps the leading bits of a block key."""
    bits = min(64, int(total).bit_length() + SPARE_BITS)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def _anchors(block: blocks.Block, length: int, short: np.uint64):
    words = hashing.Words(block.text, fold=False)
    half = length // 2
    at, h = _windows(words, half)
    keys, inverse = np.unique(h & short, return_inverse=True)
    return words, at, keys, inverse


def _probe(block: blocks.Block, length: int, short: np.uint64) -> list[np.ndarray]:
    """Keys of all rolling windows of block length; note: occurrences, 2 at
    most, plus 4 if one is a reference block."""
    words, at, keys, inverse = _anchors(block, length, short)
    aligned = (at - words.first[_owner(words, at)]) % (length // 2) == 0
    note = np.minimum(np.bincount(inverse, minlength=len(keys)), 2)
    note += 4 * (np.bincount(inverse[aligned], minlength=len(keys)) > 0)
    return [keys, note.astype(np.uint64)]


def _hits(index: np.ndarray, size: int, note: np.ndarray):
    seen = np.bincount(index, (note & np.uint64(3)).astype(np.int64), size)
    anchored = np.bincount(index, note >> np.uint64(2), size) > 0
    return None, [((seen >= 2) & anchored)[index].astype(np.uint64)], []


def _extend(block: blocks.Block, hit: np.ndarray, length: int, short: np.uint64):
    """Sorted distinct keys of the windows around hits, with their smallest (doc, start)."""
    words, at, _, inverse = _anchors(block, length, short)
    marks = np.zeros(len(words.hash) + 1, np.int64)
    if len(at):
        marks[at[hit[inverse] > 0] + 1] = 1
    upto = np.cumsum(marks)
    start, h = _windows(words, length)
    near = upto[start + length - length // 2 + 1] > upto[start] if len(start) else np.empty(0, bool)
    start, h = start[near], h[near]
    owner = _owner(words, start)
    keys, inverse = np.unique(h, return_inverse=True)
    doc, first = _least(inverse, len(keys), _order(block.ids)[owner], (start - words.first[owner]).astype(np.uint64))
    many = np.bincount(inverse, minlength=len(keys)) > 1
    return [keys, doc, first, many.astype(np.uint64)]


def _earliest(index: np.ndarray, size: int, doc: np.ndarray, start: np.ndarray, many: np.ndarray):
    """Reply, for keys that occur more than once, whether the block has the earliest."""
    low_doc, low_start = _least(index, size, doc, start)
    repeated = (np.bincount(index, minlength=size) > 1) | (np.bincount(index, many, size) > 0)
    own = (doc == low_doc[index]) & (start == low_start[index])
    return repeated[index], [own.astype(np.uint64)], []


def _covered(block: blocks.Block, keys: np.ndarray, own: np.ndarray, length: int) -> tuple[hashing.Words, np.ndarray]:
    """The block's words and whether each is to be removed."""
    words = hashing.Words(block.text, fold=False)
    change = np.zeros(len(words.hash) + 1, np.int64)
    start, h = _windows(words, length)
    if len(keys) and len(h):
        flags = np.zeros(1 << 20, bool)
        low = np.uint64((1 << 20) - 1)
        flags[keys & low] = True
        maybe = np.flatnonzero(flags[h & low])
        place = np.searchsorted(keys, h[maybe])
        place[place == len(keys)] = 0
        found = keys[place] == h[maybe]
        start, index = start[maybe[found]], place[found]
        owner = _owner(words, start)
        doc, first = _order(block.ids)[owner], (start - words.first[owner]).astype(np.uint64)
        seen, index = np.unique(index, return_inverse=True)
        low_doc, low_first = _least(index, len(seen), doc, first)
        earliest = (own[seen] > 0)[index] & (doc == low_doc[index]) & (first == low_first[index])
        later = start[~earliest]
        np.add.at(change, later, 1)
        np.add.at(change, later + length, -1)
    return words, np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, n_repeats
    (maximal runs removed), kept (the words left, joined by one space).

    A word is removed if a window of ``length`` words over it also starts
    earlier: in a smaller doc_id, or earlier in the same document.  Null and
    blank texts have no words and keep an empty text.  A null doc_id counts as
    smaller than all others.  Rows of one doc_id with equal starts are not
    earlier than each other, so repeated rows keep their words.  doc_id must
    be an integer; an empty table gives an empty one; other columns are not
    read.  ``docs`` is read three times and must give the same rows each time."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    kind = dict(rows.dtypes)["id"]
    total = blocks.text_bytes(rows)
    buckets, short = blocks.buckets_for(total), _short(total)
    hits = blocks.answer(blocks.ask(rows, buckets, lambda b: _probe(b, length, short)), _hits).checkpoint()

    def extend(block, _, replies):
        keys, *notes = _extend(block, replies[0], length, short)
        yield from blocks.send(block, keys, notes, buckets)
    asked = blocks.meet(rows, hits, 1, extend, blocks.ASKED)
    known = blocks.answer(asked, _earliest).checkpoint()

    def cut(block, keys, replies):
        words, gone = _covered(block, keys, replies[0], length)
        out = [[], [], [], []]
        for i, text in enumerate(block.text.to_pylist()):
            drop = gone[words.of(i)]
            tokens = text.split()
            removed = int(drop.sum())
            out[0].append(len(tokens))
            out[1].append(removed)
            out[2].append(int(np.count_nonzero(np.diff(drop.astype(np.int8), prepend=0) == 1)))
            out[3].append(b" ".join(compress(tokens, ~drop) if removed else tokens))
        yield pa.RecordBatch.from_arrays(
            [block.ids, *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "n_repeats", "kept"])
    return blocks.meet(rows, known, 1, cut,
                       f"doc_id {kind}, n_words bigint, n_removed bigint, n_repeats bigint, kept string")


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(a) - {LENGTH} + 2)) AS s, a FROM w),
k AS (SELECT doc_id, s, array_to_string(a[s:s + {LENGTH - 1}], ' ') AS key FROM g),
e AS (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS n FROM k),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + {LENGTH})) AS i FROM e WHERE n > 1),
p AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS i FROM w),
x AS (SELECT p.doc_id, p.i, word, r.i IS NOT NULL AS gone FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i),
y AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN y ON w.doc_id = y.doc_id
"""
