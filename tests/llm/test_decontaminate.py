import pickle
import random

import duckdb
import pyarrow as pa

from logsleuth.llm import decontaminate as D
from tests.oracle_check import compare
from tests.llm.helpers import prose, rows, table, words


def grams(text, size=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def fixture():
    rng = random.Random(4)
    items = [(i, " ".join(f"{prose(rng, 1)}{rng.randrange(999)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 17, 33, 60, 130]))))
             for i in range(60)] + [(60, ""), (61, " \n"), (62, "w1 w1"), (63, "the")]
    docs = []
    for i in range(250):
        text = " ".join(f"{prose(rng, 1)}{rng.randrange(9999)}" for _ in range(rng.choice([0, 3, 60, 400, 6000])))
        if rng.random() < .6:
            _, item = rng.choice(items[:60])
            w = item.split()
            for _ in range(rng.choice([0, 0, 0, 1])):
                w[rng.randrange(len(w))] = "changed"
            cut = rng.choice([0, 0, len(w) // 9, len(w) // 3])
            text = text + " " + " ".join(w[cut:]).upper() + "\n" + prose(rng, 30)
        docs.append((i, text, "en", "s"))
    return items, docs


def brute(items, docs):
    out = set()
    for d, text, *_ in docs:
        for i, item in items:
            size = min(5, len(words(item)))
            want, have = grams(item, size) if size else set(), grams(text, size)
            if want and len(want & have) >= .8 * len(want) - 1e-9:
                out.add((d, i, len(want & have), len(want)))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in rows(df)}


def test_against_brute_force(spark, monkeypatch):
    items, docs = fixture()
    table_, bench = table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(items, docs)
    assert len(want) > 20 and found(D.contained_items(table_, bench)) == want
    left = {r["doc_id"] for r in rows(D.decontaminate(table_, bench))}
    assert left == {d[0] for d in docs} - {x[0] for x in want}
    monkeypatch.setattr(D, "MAX_INDEX_ITEMS", 7)  # an index beyond the bound is searched in blocks
    assert found(D.contained_items(table_, bench)) == want
    assert {r["doc_id"] for r in rows(D.decontaminate(table_, bench))} == left


def test_short_item_in_a_very_long_document(spark):
    rng = random.Random(8)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    long = [f"v{rng.randrange(10**6)}" for _ in range(90_000)]
    docs = table(spark, [(1, " ".join(long[:70_001]) + " " + item + " " + " ".join(long[70_001:]), "en", "s")])
    assert found(D.contained_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))) == {(1, 7, 8, 8)}


def test_short_items_equal_sql(spark):
    items, docs = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = table(spark, docs)
    con = duckdb.connect()
    for name, frame in (("documents", df.select("doc_id", "text").toPandas()), ("benchmark", bench.toPandas())):
        con.register(name, frame)
    assert compare(D.contained_items(df, bench).toPandas(), con.execute(D.SQL).df()) == "OK"


def test_index_grows_with_its_texts():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)).encode()) for i in range(4000)]
    assert len(pickle.dumps(D.Index(items))) < sum(len(t) for _, t in items) + 4000 * D.PERMS * 14 + 6 * (D.PERMS << 16)


def test_items_of_one_shingle_are_not_missed():
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(5)).encode()) for i in range(2000)]
    filler = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    texts = pa.array([f"{filler()} {t.decode()} {filler()}".encode() for _, t in items], pa.large_binary())
    assert sorted(D.Index(items).search(texts)) == [(i, i, 1, 1) for i in range(2000)]
