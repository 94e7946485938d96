"""Collocations: against brute force, compaction and counts on their own."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsleuth.llm import phrases
from tests.llm.helpers import edge_rows, rows, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest, least, keep):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        cands = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cands.items()):
                continue
            n = total[lang]
            s, k = min((1000 * a * n // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]], n))
        for i, (s, a, p, l, r, n) in enumerate(sorted(best)[:keep], 1):
            out.append((lang, i, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def fixture():
    rng = random.Random(12)
    words = ["the", "Of", "a", "über", "x1", "data", "set", "in", "new", "york", "ñ"]
    passage = " ".join(rng.choice(words) + str(i) for i in range(30))
    docs = []
    for i in range(250):
        bits = []
        for _ in range(rng.randint(0, 12)):
            bits.append(" ".join(rng.choice(words[:rng.choice([3, 11])]) for _ in range(rng.randint(1, 9))))
            if rng.random() < .4:
                bits.append(rng.choice(["New  York\tcity hall", passage, "a a a a a a a a", "rare%d word" % i, "of the set of the set of the"]))
        text = "".join(b + rng.choice([". ", ", ", "\n", " ", "\r\n", "; ", "\x0b", "\t", "!"]) for b in bits)
        docs.append((i, text, rng.choice(["en", "en", "de", None]), "s"))
    return docs + [(1, None, "fr", "s"), (2, " ", None, "s"), (3, "...", "en", "s"), docs[0], docs[0]]


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows(df))


@pytest.mark.parametrize("longest,least,keep", [(5, 20, 40), (5, 2, 2000), (3, 8, 10), (2, 5, 5)])
def test_against_brute_force(spark, longest, least, keep):
    docs = fixture()
    df = table(spark, docs).repartition(6).checkpoint()
    assert got(phrases.collocations(df, longest, least, keep)) == brute(docs, longest, least, keep)


def test_crowded_bit_maps_and_small_slices_change_nothing(spark, monkeypatch):
    docs = fixture()
    df = table(spark, docs).repartition(3).checkpoint()
    want, _ = phrases.sequences(df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), 5, 10)
    tight, _ = phrases.sequences(df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), 5, 10, bits=6)

    def often(x):
        return [sorted((r["lang"], r["gram"], r["n"]) for r in rows(t) if r["n"] >= 10) for t in phrases.counts(x)]
    assert often(want) == often(tight)


def test_paths_compact_only_unary_chains(spark):
    def grams(text, n):
        w = text.split()
        return [("en", " ".join(w[i:i + 3]), n) for i in range(len(w) - 2)]
    chain = grams(" ".join(f"c{i}" for i in range(40)), 7)
    ring = grams("p q s p q s p q", 4)[:3]
    fork = grams("f g h i j", 5) + [("en", "g h z", 2)]
    step = [("en", "k l m", 3), ("en", "l m n", 2)]      # weights differ: something ends at l m
    loop = [("en", "o o o", 9)]
    cut = grams("t u v w", 6)                            # as many pieces end as start with u v
    df = spark.createDataFrame(chain + ring + fork + step + loop + cut, "lang string, gram string, n bigint")
    ends = spark.createDataFrame([("en", "u v"), ("de", "c3 c4")], "lang string, gram string")
    found = {(" ".join(r["words"]), r["n"]) for r in rows(phrases.paths(df, ends, 3))}
    assert (" ".join(f"c{i}" for i in range(40)), 7) in found
    assert {(g, 4) for _, g, _ in ring} | {("o o o", 9), ("k l m", 3), ("l m n", 2), ("f g h", 5), ("g h z", 2), ("g h i j", 5),
                                              ("t u v", 6), ("u v w", 6)} <= found and len(found) == 1 + 3 + 1 + 2 + 3 + 2


def test_edges(spark):
    assert rows(phrases.collocations(table(spark, []))) == []
    docs = edge_rows()
    assert got(phrases.collocations(table(spark, docs), 5, 100, 50)) == brute([(a, b, c) for a, b, c, _ in docs], 5, 100, 50)
    assert rows(phrases.collocations(table(spark, [(1, None, None, None)]))) == []
