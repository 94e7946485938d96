"""Language-model scoring by a weighted backoff automaton.

The model is an interpolated n-gram model over words (A-Z lower-cased) with an
end token.  As an automaton, a state is a context of up to ``order - 1``
words.  An arc leaves a state for every word seen after it, with weight

    log10 p(w | h),   p(w | h) = (c(hw) + m(h) p(w | h')) / (c(h) + m(h)),

where h' is h without its first word; a state has one failure arc, to h', with
weight log10(m(h) / (c(h) + m(h))).  At the root stands the smoothed unigram
(c + 0.5) / (N + 0.5 (V + 1)), so every word has an arc.  The mass m(h) that a
context gives to unseen words is c(h) ** b, where b is chosen for each order
such that the sum over all contexts equals the number of distinct n-grams of
the training text (Witten-Bell smoothing by moments).  Since m depends on c(h)
alone, n-gram counts are all that the model holds.

Counting and looking up are one exchange (``blocks``): a block of documents
sends its distinct n-grams with their training counts and gets back the counts
of the whole training text.  From these it builds the part of the automaton
that its own texts can reach (``Automaton``): states, arcs and failure arcs with
their weights.  Each text is traversed once from left to right; the traversal
carries its state, follows failure arcs until the state has an arc for the next
word, takes it, and adds the weights.

Words have 64-bit keys.  Keys of longer n-grams are cut to ``SPARE_BITS`` more
bits than the text has bytes, at most 64: about one n-gram in 2 ** 21 shares
its key with another at any size, and then both have the sum of their counts.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsleuth.llm import blocks, common, hashing

ORDER = 3
SPARE_BITS = 20
FOLDS, HELD_FOLD = 5, 1
_STEP = 1 << 16  # tokens of a text that are walked at a time
_END = np.uint64(0x5EEDED0FEED5EED1)
_START = np.uint64(0x57A27057A2757A27)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRID = np.round(np.arange(0.0, 1.0001, 0.05), 2)  # exponents b


def held_out(doc_id) -> bool:
    """Whether a document is kept out of training; a null id counts as an empty text."""
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % FOLDS == HELD_FOLD


def _tokens(block: blocks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, document of each, place in its document): words and one end."""
    words = hashing.Words(block.text)
    size = np.diff(words.first)
    n = len(size)
    tokens = np.full(len(words.hash) + n, _END, np.uint64)
    owner = np.repeat(np.arange(n), size)
    tokens[np.arange(len(words.hash)) + owner] = words.hash
    doc = np.repeat(np.arange(n), size + 1)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    return tokens, doc, np.arange(len(tokens)) - first[doc]


def _short(total: int) -> np.uint64:
    """Mask of the bits kept of the keys of n-grams of two and more words."""
    bits = min(64, int(total).bit_length() + SPARE_BITS)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def _grams(tokens: np.ndarray, place: np.ndarray, order: int, short: np.uint64) -> list[np.ndarray]:
    """For each length 1..order the key of the n-gram that ends at each token;
    before its first word a text has start tokens."""
    out = [hashing.mix(tokens)]
    for k in range(1, order):
        before = np.roll(tokens, k)
        before[place < k] = _START
        out.append(hashing.mix(out[-1] * _ODD + hashing.mix(before) + np.uint64(k)))
    return out[:1] + [x & short for x in out[1:]]


def _keys(block: blocks.Block, order: int, short: np.uint64):
    tokens, doc, place = _tokens(block)
    keys, inverse = np.unique(np.concatenate(_grams(tokens, place, order, short)), return_inverse=True)
    return keys, inverse.reshape(order, -1), doc, place


def _ask(block: blocks.Block, order: int, short: np.uint64) -> list[np.ndarray]:
    """Distinct n-grams of a block with their counts in its training documents
    and their length."""
    keys, inverse, doc, _ = _keys(block, order, short)
    train = ~np.array([held_out(x) for x in block.ids.to_pylist()], bool)
    train = train[doc]
    count = np.bincount(inverse[:, train].ravel(), minlength=len(keys)) if len(doc) else np.empty(0, np.int64)
    length = np.zeros(len(keys), np.uint64)
    for k in range(order):
        length[inverse[k]] = k + 1
    return [keys, count.astype(np.uint64), length]


def _count(order: int):
    def merge(index: np.ndarray, size: int, count: np.ndarray, length: np.ndarray):
        total = np.bincount(index, count.astype(np.float64), size)
        of = np.zeros(size, np.uint64)
        of[index] = length
        stats = [total[of == 1].sum()]  # tokens
        for k in range(1, order + 1):
            seen = total[(of == k) & (total > 0)]
            stats += [len(seen), *(np.sum(seen ** b) for b in _GRID)]
        return None, [total[index].astype(np.uint64)], stats
    return merge


class Weights:
    """What the whole training text says: tokens, words, smoothing exponents."""

    def __init__(self, stats: np.ndarray, order: int):
        width = 1 + len(_GRID)
        self.tokens = stats[0]
        self.words = stats[1] if len(stats) > 1 else 0
        self.exponent = []
        for k in range(1, order):  # contexts of k words, followed by distinct (k + 1)-grams
            sums, grams = stats[1 + (k - 1) * width + 1:1 + k * width], stats[1 + k * width]
            self.exponent.append(round(float(np.interp(grams, sums, _GRID)), 6) if sums[-1] > sums[0] else 0.5)
        self.norm = math.log10(self.tokens + 0.5 * (self.words + 1))

    def root(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 0.5) - self.norm

    def mass(self, k: int, context: np.ndarray) -> np.ndarray:
        return context ** self.exponent[k - 1]


class Automaton:
    """The states and arcs that the texts of a block can reach.

    The arc for the last word of an n-gram leaves the state of the words before
    it; both bear the number of the n-gram.  ``weight`` has the weight of an
    arc, ``has`` whether it exists, ``fail`` the weight of the failure arc of
    the state that an n-gram is (to the state without its first word).  The
    root has an arc for every word.  ``start`` has the weights of the failure
    arcs of the start states, contexts of start tokens alone, by length."""

    def __init__(self, weights: Weights, count: np.ndarray, grams: np.ndarray, place: np.ndarray, ends: float):
        """``count`` of each n-gram, ``grams[k]``: the (k + 1)-gram that ends at
        each token, ``ends``: the number of training texts, which is the count
        of each start state."""
        self.grams, self.order = grams, len(grams)
        weight, fail = np.zeros(len(count)), np.zeros(len(count))
        self.start = [0.0] * self.order
        lower = weights.root(count[grams[0]])  # log10 p with the context that is a word shorter
        weight[grams[0]] = lower
        first = place == 0
        for k in range(1, self.order):
            state = np.roll(grams[k - 1], 1)
            context = np.where(first, ends, count[state])
            known = context > 0
            mass = np.where(known, weights.mass(k, np.maximum(context, 1)), 1.0)
            whole = np.where(known, context, 0) + mass
            lower = np.log10((count[grams[k]] + mass * 10.0 ** lower) / whole)
            weight[grams[k]] = lower
            down = np.log10(mass / whole)
            fail[state[~first]] = down[~first]
            self.start[k] = float(down[first][0])
        self.weight, self.fail = array("d", weight.tobytes()), array("d", fail.tobytes())
        has = count > 0
        has[grams[0]] = True
        self.has = has.tobytes()

    def walk(self, first: int, last: int) -> float:
        """Weight of the traversal of the text with the tokens first..last - 1."""
        weight, fail, has, longest = self.weight, self.fail, self.has, self.order - 1
        total, size, before = 0.0, longest, None  # the state: the last ``size`` words, the n-gram before[size - 1]
        for lo in range(first, last, _STEP):
            for words in zip(*(g[lo:min(lo + _STEP, last)].tolist() for g in self.grams)):
                while not has[words[size]]:
                    total += fail[before[size - 1]] if before else self.start[size]
                    size -= 1
                total += weight[words[size]]
                if size < longest:
                    size += 1
                before = words
        return total


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (the smoothed unigram), score (the model's log10
    probability of the text).

    Learns from the documents whose crc32(doc_id as text) mod 5 is not 1.  Null
    and blank texts are one end token; a null doc_id is in training.  Repeated
    rows are counted and scored each; without training documents every word is
    unknown.  An empty table gives an empty one; other columns are not read.
    ``docs`` is read twice and must give the same rows each time."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    kind = dict(rows.dtypes)["id"]
    total = blocks.text_bytes(rows)
    buckets, short = blocks.buckets_for(total), _short(total)
    known = blocks.answer(blocks.ask(rows, buckets, lambda b: _ask(b, order, short)), _count(order)).checkpoint()
    figures = known.where("stats IS NOT NULL").select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(
        F.sum("x").alias("x")).orderBy("i").collect()  # one row for each figure
    weights = Weights(np.array([r["x"] for r in figures]), order) if figures else None

    def run(block, _, replies):
        keys, inverse, doc, place = _keys(block, order, short)
        del keys
        count = replies[0].astype(np.float64)
        first = np.flatnonzero(place == 0).tolist() + [len(place)]
        counts = count[inverse[0]]
        machine = Automaton(weights, count, inverse, place, float(counts[first[1] - 1]))  # of the end token
        n = len(block.ids)
        base = weights.root(counts)
        held = [held_out(x) for x in block.ids.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [block.ids, pa.array(held, pa.bool_()), pa.array(np.bincount(doc, minlength=n)),
             pa.array(np.bincount(doc, counts > 0, n).astype(np.int64)), pa.array(np.full(n, int(weights.tokens))),
             pa.array(np.bincount(doc, base, n)),
             pa.array([machine.walk(a, b) for a, b in zip(first, first[1:])], pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return blocks.meet(rows, known, 1, run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
                       "train_tokens bigint, base_score double, score double")
