import hashlib
import random

from logsleuth.llm import blocks, substrings
from tests.llm.helpers import prose, rows, table, words


def brute(docs, n):
    seen, gone = {}, {}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    first = {}
    for k in order:
        w = words(docs[k][1])
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            place = (docs[k][0] is not None, docs[k][0] or 0, s)
            first[key] = min(first.get(key, place), place)
    for k, (d, text, *_) in enumerate(docs):
        w = words(text)
        gone[k] = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < (d is not None, d or 0, s):
                gone[k].update(range(s, s + n))
        seen[k] = (d, len(w), len(gone[k]), b" ".join(x for i, x in enumerate(w) if i not in gone[k]).decode())
    return sorted(seen.values(), key=str)


def fixture():
    rng = random.Random(9)
    passage = prose(rng, 60).split()
    docs = []
    for i in range(120):
        w = [f"{x}{rng.randrange(500)}" for x in prose(rng, rng.choice([0, 5, 40, 200])).split()]
        for _ in range(rng.choice([0, 1, 2])):
            a = rng.randint(0, 45)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a:a + rng.randint(5, 40)]
        docs.append((rng.randrange(-50, 100), " ".join(w), "en", "s"))
    docs += [docs[3], (500, docs[4][1], "en", "s"), (501, "same " * 70, "en", "s"), (None, docs[5][1], "en", "s")]
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = fixture()
    for n in (20, 7):
        df = table(spark, docs).repartition(5, "n_chars").checkpoint()
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])
                      for r in rows(substrings.remove_repeats(df, n))), key=str)
        assert got == brute(docs, n), n


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MIN_BUCKETS", 40)
    docs = fixture()
    df = table(spark, docs).repartition(16, "text").checkpoint()
    out = substrings.remove_repeats(df)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows(out)), key=str)
    assert got == brute(docs, 20)
    assert hashlib.sha256(b"").hexdigest()  # the digest of a document without words left


def test_packing_round_trip():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 10_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert (blocks.unpack_sorted(blocks.pack_sorted(keys)) == keys).all()
        at = blocks.bounds(keys, 7)
        assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()
        for top in (200, 60_000, 1 << 40):
            x = rng.integers(0, top, n).astype(np.uint64)
            assert (blocks.unpack(blocks.pack(blocks.narrow(x)), np.uint64) == x).all()
