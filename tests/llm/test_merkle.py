"""Manifest and proofs: against brute force on sources of every small size."""

import hashlib
import random
import zlib

import duckdb

from logsleuth.llm import merkle
from tests.llm.helpers import edge_rows, rows, table
from tests.oracle_check import compare


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    out = ""
    for x in (doc[0], doc[3], doc[2], None if doc[1] is None else len(doc[1]), text):
        out += "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(out)


def tree(nodes):
    """(root, [siblings before and after at each level] for every node)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for j, p in enumerate(at):
            run = level[p - p % 3:p - p % 3 + 3]
            paths[j].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def brute(docs):
    sources = {}
    for d in docs:
        sources.setdefault(d[3], []).append(d)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subs, made = [], {}
    for s in names:
        members = sorted(sources[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        made[s] = (members, *tree([leaf(d, d[1]) for d in members]))
        subs.append(made[s][1])
    root, tops = tree(subs)
    out = []
    for s, top in zip(names, tops):
        members, sub, paths = made[s]
        for d, path in zip(members, paths):
            text = d[1]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf(d, text)
            for a, b in path + top:
                acc = h(a, acc, b)
            out.append((d[0], leaf(d, d[1]), sub, root, h(*(a + b for a, b in path + top)), acc, acc == root))
    return sorted(out, key=str)


def result(docs, spark):
    df = table(spark, docs).repartition(4).checkpoint()
    return df, sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                       for r in rows(merkle.verify(df))), key=str)


def fixture():
    rng = random.Random(8)
    docs = []
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 28, 82]):
        name = [None, "", "-", "b\n", "é", "z", "a:1", "\U0001f600"][s]
        docs += [(rng.randrange(-10 ** 12, 10 ** 12), rng.choice([None, "", "line\nline", "x\r\ny é", "plain"]), rng.choice(["en", None]), name)
                 for _ in range(n)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force_and_sql(spark):
    docs = fixture()
    df, got = result(docs, spark)
    assert got == brute(docs)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    con = duckdb.connect()
    con.register("documents", df.toArrow())  # pandas would make numbers with nulls floats
    assert compare(merkle.verify(df).toPandas(), con.execute(merkle.SQL).df()) == "OK"


def test_repeated_and_odd_rows(spark):
    docs = edge_rows() + [(3, "same", "en", "q")] * 30 + [(3, "other", "en", "q"), (None, "same", "en", "q")]
    assert result(docs, spark)[1] == brute(docs)


def test_one_leaf_one_source_and_none(spark):
    one = [(5, "a\nb", "en", "s")]
    assert result(one, spark)[1] == brute(one)
    many = [(i, "t", "en", "s") for i in range(7)]
    assert result(many, spark)[1] == brute(many)
    assert result([], spark)[1] == []
