"""The whole pipeline against a plain version on a small fixture."""

import random

import corpus_pipeline
from logsleuth.llm import pii
from tests.llm.helpers import edge_rows, prose, rows, table, words
from tests.llm.test_decontaminate import grams
from tests.llm.test_simhash import components, slow_fingerprint


def test_run(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 12) + f" marker{i} " + prose(rng, 12)) for i in range(5)]
    docs = [r for r in edge_rows() if r[0] not in (1, 2, None)]
    for i in range(100, 190):
        text = prose(rng, rng.randint(20, 90)) + f" id{i}"
        if i % 9 == 0:
            text += "\n" + rng.choice(items)[1]
        if i % 11 == 0:
            text += f" write to user{i}@mail.example.com"
        docs.append((i, text, "en", f"s{i % 4}"))
        if i % 7 == 0:
            docs.append((i + 1000, text, "en", "s9"))
    df = table(spark, docs).drop("copy", "shard")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    letters = {d: t for d, t, *_ in docs if any(c.isalpha() for c in t or "")}
    fp = {d: slow_fingerprint(t) for d, t in letters.items()}
    root = components(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 2)
    left = {d: letters[d] for d in letters if root[d] == d}
    left = {d: t for d, t in left.items()
            if not any(len(grams(x) & grams(t)) >= .8 * len(grams(x)) for _, x in items)}
    left = {d: pii.redact(t, pii.find_spans(t)) for d, t in left.items()}
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert {r["doc_id"]: r["text"] for r in got}.items() <= left.items()
    size = sum(len(words(t)) for t in left.values())
    biggest = max(len(words(t)) for t in left.values())
    assert abs(sum(len(words(r["text"])) for r in got) - size) <= biggest
    assert len({(r["shard"], r["place"]) for r in got}) == len(got)
    again = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "mixture"]
    assert corpus_pipeline.ORACLE_SQL is None
