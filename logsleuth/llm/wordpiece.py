"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with two roots, one for the pieces that begin a
word and one for those that continue it.  Every node has a failure link: the
node reached when the greedy longest pieces at its front have been cut off,
and the number of pieces cut off on the way.  A word is read once, byte by
byte; following a failure link adds its stored count, so the number of pieces
is known without building any.  A word that cannot be cut counts as one token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsleuth.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
_DEAD = -1


def ranked_vocabulary(lines: Iterable[bytes]) -> tuple[set[bytes], set[bytes]]:
    """(beginning, continuing) pieces of a vocabulary of base64 byte strings,
    one a line: strings after a blank begin a word, those without one continue
    it, and each single byte may do both."""
    begin, follow = set(), set()
    for line in lines:
        if line.strip():
            piece = base64.b64decode(line.split()[0])
            (begin.add(piece[1:]) if piece[:1] == b" " else follow.add(piece))
    begin.discard(b"")
    return begin | {p for p in follow if len(p) == 1}, follow


def load_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Read a vocabulary file on the driver; the file is checked to be small."""
    with open(path, "rb") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} exceeds {MAX_VOCABULARY_BYTES} bytes")
    return ranked_vocabulary(text.splitlines())


class Automaton:
    """Nodes are numbers; 0 begins a word, 1 continues it."""

    def __init__(self, begin: Iterable[bytes], follow: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, begin), (1, follow)):
            for p in pieces:
                at = root
                for c in p:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = to
                piece[at] = True
        self.fail = [_DEAD] * len(self.next)
        self.popped = [0] * len(self.next)
        layer = [0, 1]
        while layer:  # by depth, so that a link points to a node already done
            below = []
            for parent in layer:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if piece[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at != _DEAD and c not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at != _DEAD:
                        self.fail[node], self.popped[node] = self.next[at][c], n
            layer = below

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces; 0 if the word cannot be cut."""
        step, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            to = step[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = step[at].get(c)
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, lower: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_bytes (of words),
    n_tokens, n_unknown (words that cannot be cut, one token each).

    Null and blank texts have zero counts; rows are independent, so repeated
    rows give repeated results and an empty table an empty one.  Words of any
    length are read in one pass; columns other than doc_id and text are not
    read.  The vocabulary is read by the driver and broadcast, its size checked."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(Automaton(*load_vocabulary(vocabulary)))
    rows = docs.select("doc_id", "text")

    def run(batches):
        memo = common.Memo(shared.value.count)
        look = memo.__getitem__
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, text in enumerate(common.texts(batch.column(1))):
                words = (text.lower() if lower else text).split()
                counts = [look(w) for w in words]
                unknown = counts.count(0)
                out[:, i] = len(words), sum(map(len, words)), sum(counts) + unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)],
                                             names=["doc_id", "n_words", "n_bytes", "n_tokens", "n_unknown"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_bytes bigint, "
                                "n_tokens bigint, n_unknown bigint")
