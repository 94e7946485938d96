"""Quality rules and mixing: against brute force and against their SQL form."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from logsleuth.llm import mixing, quality
from tests.llm.helpers import prose, rows, table, words
from tests.oracle_check import compare


def sql(df, text):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con.execute(text).df()


def quality_docs():
    rng = random.Random(1)
    docs = []
    for i in range(260):
        lines = [prose(rng, rng.randint(0, 25)) for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            lines.insert(0, f"Page {i} of  the SITE menu footer")  # one line after normalising
        if i % 50 == 2:
            lines = [f"page {i} of the site Menu footer"] * 12
        if rng.random() < .3:
            lines.append(rng.choice(lines))
        docs.append((i, "\n".join(lines), "en", f"h{i % 2}"))
    return docs + [(900, "a b " * 40, "en", "h0"), (901, "# $ % | <>", "en", None)]


def test_quality_equals_sql_and_brute_force(spark, tmp_path):
    docs = quality_docs()
    df = table(spark, docs)
    got = quality.quality(df)
    assert compare(got.toPandas(), sql(df.select("doc_id", "text", "source"), quality.SQL)) == "OK"
    by = {r["doc_id"]: r for r in rows(got)}
    for d, text, *_ in docs:
        w = [x.decode() for x in words(text)]
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert by[d]["n_repeat_words"] == len(covered) and by[d]["n_words"] == len(w)
        assert by[d]["n_dup_lines"] == len(lines) - len(set(lines))
        assert by[d]["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert by[d]["word_chars"] == sum(map(len, w))
    assert by[52]["n_removed"] == 12 * 7 and not by[52]["kept"]


def test_kept_texts_lose_the_removed_lines(spark):
    docs = quality_docs()
    docs += [docs[0], (None, docs[16][1], "en", "h0"), (902, docs[12][1] + "\n\n \n" + prose(random.Random(2), 60), "en", "h0")]
    df = table(spark, docs)
    want, size = Counter(), {}
    for d, text, *_ in docs:
        lines = [x for x in text.split("\n") if not re.fullmatch(r"page \d\d+ of the site menu footer", " ".join(x.lower().split()))]
        size[d] = len(words(text)) - len(words("\n".join(lines)))
        want[d, "\n".join(lines)] += 1
    by = {r["doc_id"]: r for r in rows(quality.quality(df))}
    assert any(r["kept"] and r["n_removed"] for r in by.values())
    assert all(r["n_removed"] == size[d] for d, r in by.items())
    got = Counter((r["doc_id"], r["text"]) for r in rows(quality.kept_texts(df)))
    assert got == {k: n for k, n in want.items() if by[k[0]]["kept"]}


def mixing_docs(seed=2):
    rng = random.Random(seed)
    sources = [None, "é", "a", "B", "b", "zz"]
    docs = [(i, prose(rng, rng.choice([0, 3, 20, 60, 200])), "en", rng.choices(sources, [1, 1, 30, 8, 4, 2])[0])
            for i in range(400)]
    return docs + [docs[0], docs[0]]


def test_targets_and_taken(spark):
    docs = mixing_docs()
    df = table(spark, docs)
    got = rows(mixing.mixed_sizes(df))
    size = Counter()
    for _, text, _, s in docs:
        size[s] += len(words(text))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:  # share, stop those above three times their size, share the excess again
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    by_size = {size[s]: target[s] for s in names}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
    assert len(by_size) == len(names)
    assert all(abs(taken[k] - t) <= 20 for k, t in by_size.items()), (taken, by_size)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mixed_sizes(df.repartition(7)))))


def test_taken_equals_sql(spark):
    docs = mixing_docs(3)[:-2]
    df = table(spark, docs)
    assert compare(mixing.mixed_sizes(df).toPandas(), sql(df.select("doc_id", "text", "source"), mixing.SQL)) == "OK"


def test_shards_share_the_exact_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2_000)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    df = table(spark, mixing_docs())
    plan, _, drawn = mixing.draws(df)
    got = drawn.join(plan.select("sid", "pos", "copies"), ["sid", "pos"])
    each = got.groupBy("sid", "pos").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.count_distinct("copy").alias("d"))
    assert each.where("n <> c OR d <> c").count() == 0
    assert drawn.groupBy("shard", "place").count().where("count > 1").count() == 0
    assert drawn.select("shard").distinct().count() >= 8
    mixed = mixing.mix(df)
    assert mixed.count() == drawn.count()
    want = Counter()
    for r in rows(mixing.mixed_sizes(df)):
        want[r["doc_id"]] += r["taken"]
    have = Counter()
    for r in rows(mixed.select("doc_id", "text")):
        have[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in want.items() if v} == dict(have)


def test_split_tree_is_hypergeometric(spark):
    quota = spark.createDataFrame([(0, 40), (1, 25), (2, 0), (3, 15)], "sid int, quota long")
    leaves = rows(mixing.split_tree(quota, 3))
    by = Counter()
    for r in leaves:
        by[r["sid"]] += r["n"]
    assert by == {0: 40, 1: 25, 2: 0, 3: 15}
    shards = Counter()
    for r in leaves:
        shards[r["shard"]] += r["n"]
    assert sorted(shards.values()) == [10] * 8
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    x = u.select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"),
                                       F.col("u")).alias("x")).groupBy("x").count().collect()
    from math import comb
    for r in x:
        p = comb(20, r["x"]) * comb(30, 10 - r["x"]) / comb(50, 10)
        assert abs(r["count"] / 4000 - p) < 1e-3
    assert np.isclose(sum(r["count"] for r in x), 4000)


def test_draws_from_many_blocks_walk_near_the_mean(spark):
    pool, good, drawn = 3 * 10**8, 10**8, 15 * 10**7
    x = spark.range(9, numPartitions=4).select(mixing.hypergeometric(
        *[F.lit(n).cast("long") for n in (pool, good, drawn)], (F.col("id") + 0.5) / 9).alias("x")).collect()
    sd = (drawn * (good / pool) * (1 - good / pool) * (pool - drawn) / (pool - 1)) ** 0.5
    from statistics import NormalDist
    assert all(abs((r["x"] - drawn * good / pool) / sd - NormalDist().inv_cdf((i + 0.5) / 9)) < 1e-3 for i, r in enumerate(x))
