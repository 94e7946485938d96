import random

import pytest
import xxhash
from pyspark.sql import functions as F

from logsleuth.llm import simhash
from logsleuth.operators.components import connected_components
from tests.llm.helpers import prose, rows, table, words


def slow_fingerprint(text, n=3):
    w = words(text.lower() if text and text.isascii() else text)
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def test_against_brute_force(spark):
    rng = random.Random(1)
    data, i = [], 0
    for _ in range(25):
        base = prose(rng, rng.randint(1, 80)).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "zz"])
            data.append((i, " ".join(w) if rng.random() < .9 else "\n".join(w).upper(), "en", "s"))
            i += 1
    data += [(i, "", "en", "s"), (i + 1, None, "en", "s"), (i + 2, "two words", "en", "s")]
    fp = {d: slow_fingerprint(t) for d, t, _, _ in data}
    want = components(fp, lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 2)
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(table(spark, data)))}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{x:016x}" for d, x in fp.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_in_a_crowd(spark, max_bits):
    """More fingerprints under one key than the pair lists hold."""
    rng = random.Random(max_bits)
    centre = rng.getrandbits(64)
    points = {centre}
    while len(points) < 150:
        x = rng.choice(sorted(points))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        points.add(x)
    points |= {rng.getrandbits(64) for _ in range(30)}
    df = spark.createDataFrame([(simhash._signed(x),) for x in points], "fp bigint")
    got = {r["fp"]: r["root"] for r in rows(simhash.classes(df, max_bits))}
    near = components(points, lambda a, b: bin(a ^ b).count("1") <= max_bits)
    by_root, by_near = {}, {}
    for x in points:
        by_root.setdefault(got[simhash._signed(x)], set()).add(x)
        by_near.setdefault(near[x], set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_near.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges.union(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long")))
    assert {(r["node"], r["component"]) for r in rows(got)} == {(i, 0) for i in range(401)} | {(900, 900), (901, 900)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b = prose(rng, 70), prose(rng, 70)
    docs = table(spark, [(3, a, "en", "s"), (2, a, "en", "t"), (9, b, "en", "s"), (2, a, "en", "t"), (None, b, "en", "s")])
    kept = rows(simhash.drop_near_duplicates(docs))
    assert sorted((r["doc_id"], r["source"]) for r in kept) == [(2, "t"), (9, "s")]


@pytest.mark.parametrize("max_bits, n", [(1, 1000), (2, 1000), (3, 100)])
def test_exploded_keys_are_not_broadcast(spark, max_bits, n):
    """The points pass for a small table, their keys are none: a broadcast of
    more than 8 MB fails.  Pairs of points are linked, and so is a crowd."""
    rng = random.Random(n)
    alone = [rng.getrandbits(64) for _ in range(n)]
    pairs = [(x, x ^ 1 << rng.randrange(64)) for x in alone]
    centre = rng.getrandbits(64)
    crowd = {centre} | {centre ^ 1 << i for i in range(64)}
    if n >= 1000:  # further circles, so that the crowds together are large as well
        for c in (rng.getrandbits(64) for _ in range(30)):
            crowd |= {c} | {c ^ 1 << i for i in range(64)}
    points = {x for pair in pairs for x in pair} | crowd
    df = spark.createDataFrame([(simhash._signed(x),) for x in points], "fp bigint")
    held = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.maxBroadcastTableSize": "8m"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        crowded = rows(simhash._crowd_links(df.where(F.col("fp").isin([simhash._signed(x) for x in crowd])), max_bits))
        got = {r["fp"]: r["root"] for r in rows(simhash.classes(df, max_bits))}
    finally:
        for k in held:
            spark.conf.unset(k)
    assert {r["a"] for r in crowded} | {r["b"] for r in crowded} == {simhash._signed(x) for x in crowd}
    assert len(got) == len(points)
    assert all(got[simhash._signed(a)] == got[simhash._signed(b)] for a, b in pairs)
    assert got[simhash._signed(centre)] == got[simhash._signed(centre ^ 1)]
    assert len(set(got.values())) == len(alone) + len(crowd) // 65
