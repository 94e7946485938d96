"""Word pieces, n-gram scores, language fusion, licence notices."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from logsleuth.llm import language, licenses, ngram, wordpiece
from tests.llm.helpers import prose, rows, table, words


def greedy(word, begin, follow):
    at = n = 0
    while at < len(word):
        pieces = follow if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        begin, follow = ({bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))} for _ in "xy")
        machine = wordpiece.Automaton(begin, follow)
        for _ in range(50):
            word = bytes(rng.choices(b"abcd", weights=[4, 4, 4, 1], k=rng.randint(1, 9)))
            assert machine.count(word) == greedy(word, begin, follow), (begin, follow, word)


def test_token_counts(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40), "en", "s") for i in range(20)] + [(20, "\x00odd €uro \U0001f600", "en", "s")]
    begin, follow = wordpiece.load_vocabulary(wordpiece.VOCABULARY)
    for r in rows(wordpiece.token_counts(table(spark, docs))):
        w = words(docs[r["doc_id"]][1])
        cut = [greedy(x, begin, follow) for x in w]
        assert (r["n_words"], r["n_bytes"], r["n_tokens"], r["n_unknown"]) == (
            len(w), sum(map(len, w)), sum(c or 1 for c in cut), cut.count(0))


def brute_scores(docs, order):
    tokens = {i: [w.lower() for w in words(t)] + [b"</s>"] for i, t, *_ in docs}
    counts = [Counter() for _ in range(order)]
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            padded = [b"<s>"] * order + t
            for k in range(order):
                counts[k].update(tuple(padded[j - k:j + 1]) for j in range(order, len(padded)))
    n, v, texts = sum(counts[0].values()), len(counts[0]), counts[0][(b"</s>",)]
    grid = np.round(np.arange(0, 1.0001, .05), 2)
    power = [0] + [round(float(np.interp(len(counts[k]), [sum(float(c) ** b for c in counts[k - 1].values()) for b in grid],
                                         grid)), 6) for k in range(1, order)]
    out = {}
    for i, t in tokens.items():
        padded, base, score = [b"<s>"] * order + t, 0.0, 0.0
        for j in range(order, len(padded)):
            p = (counts[0][(padded[j],)] + .5) / (n + .5 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                context = tuple(padded[j - k:j])
                c = counts[k - 1][context] if j > order else texts
                if c:
                    m = c ** power[k]
                    p = (counts[k][tuple(padded[j - k:j + 1])] + m * p) / (c + m)
            score += math.log10(p)
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(counts[0][(w,)] > 0 for w in t), n, base, score)
    return out


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(0, 60)), "en", "s") for i in range(120)]
    for order in (2, 3):
        want = brute_scores(docs, order)
        got = {r["doc_id"]: r for r in rows(ngram.score(table(spark, docs).repartition(3, "doc_id").checkpoint(), order))}
        for i, (held, n, known, total, base, score) in want.items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert math.isclose(r["score"], score, rel_tol=1e-9), order
    held = [x for x in want.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held) * 1.2  # near the unigram on random prose


def test_production_scores_are_of_order_three(spark, monkeypatch):
    monkeypatch.setattr(ngram, "_STEP", 3)  # the state is carried from step to step
    rng = random.Random(11)
    docs = [(i, prose(rng, 30), "en", "s") for i in range(40)]
    want = brute_scores(docs, 3)
    for r in rows(ngram.score(table(spark, docs).checkpoint())):
        assert math.isclose(r["score"], want[r["doc_id"]][5], rel_tol=1e-9)


LETTERS = {"en": "the of and ing tion th wh er", "de": "der die und sch ung keit ein ü", "fr": "le la eau oi que é ê ment"}


def speech(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_language_accuracy_and_rejection(spark):
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(300):
        lang = rng.choice(list(LETTERS))
        truth[i] = lang
        declared = lang if rng.random() < .8 else rng.choice([None, "", "en", "de-AT", "not a language"])
        docs.append((i, speech(rng, lang, rng.randint(3, 60)), declared, f"{lang}.example.org"))
    docs += [(900, "12345 --- 678", "en", "en.example.org"), (901, "", "en", "x")]
    df = table(spark, docs)
    evidence = language.of_documents(df)
    got = {r["doc_id"]: r for r in rows(language.identify(df, evidence, language.fit(df, evidence)))}
    assert sum(got[i]["language"] == x for i, x in truth.items()) >= 0.97 * len(truth)
    assert sum(got[i]["kept"] for i in truth) >= 0.97 * len(truth)
    assert not got[900]["kept"] and not got[901]["kept"]


def test_rare_languages_are_kept(spark):
    rng = random.Random(6)
    docs = [(i, speech(rng, lang, 40), lang, "h") for i, lang in enumerate(["de", "fr"] * 60)]
    docs += [(900 + i, " ".join(chr(0x10A0 + rng.randrange(30)) * 3 for _ in range(40)), x, "h")
             for i, x in enumerate(["ka", "ka-GE", None])]
    docs += [(910, speech(rng, "de", 40), "ka", "h"), (911, "123", "ka", "h")]
    df = table(spark, docs)
    evidence = language.of_documents(df)
    got = {r["doc_id"]: (r["language"], r["kept"]) for r in rows(
        language.identify(df, evidence, language.fit(df, evidence)))}
    assert [got[i] for i in (900, 901, 902, 910)] == [("ka", True), ("ka", True), ("und", False), ("de", True)]
    assert not got[911][1] and all(got[i] == (["de", "fr"][i % 2], True) for i in range(120))


def test_more_tags_than_profiles(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 20)
    rng = random.Random(7)
    tags = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    docs = [(i, speech(rng, "de", 40), "de", "h") for i in range(60)]
    # a hundred tags on five rows each, with letters of their own; the others once, with letters of another range
    texts = [(x, 0x4E00 + 64 * n, 64, 5) if n < 100 else (x, 0x400, 900, 1) for n, x in enumerate(tags)]
    docs += [(1000 + i, " ".join(chr(at + rng.randrange(size)) for _ in range(60)), x, "h")
             for i, (x, at, size) in enumerate((x, at, size) for x, at, size, k in texts for _ in range(k))]
    df = table(spark, docs)
    got = rows(language.identify(df, language.of_documents(df), language.fit(df, language.of_documents(df))))
    assert len(set(tags)) == 1000 and len(got) == len(docs)
    wrong = [r for r in got if (r["doc_id"] < 60 or r["declared"] >= "b") and (not r["kept"] or r["language"] != r["declared"])]
    assert len(wrong) <= 0.03 * len(got), (len(wrong), wrong[:3])  # few, by trigrams that share a slot


def test_host_prior_decides_without_text_evidence(spark):
    rng = random.Random(5)
    docs = [(i, speech(rng, lang, 40), lang, host) for i, (lang, host) in enumerate(
        [("de", "a.example.de")] * 60 + [("fr", "b.example.fr")] * 60)]
    df = table(spark, docs)
    model = language.fit(df, language.of_documents(df))
    probe = table(spark, [(1, "qq", None, "a.example.de"), (2, "qq", None, "b.example.fr"), (3, "qq", None, "c.example.fr")])
    got = {r["doc_id"]: r["language"] for r in rows(language.identify(probe, language.of_documents(probe), model))}
    assert got == {1: "de", 2: "fr", 3: "fr"}


def test_licence_notices(spark):
    rng = random.Random(6)
    notes = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0",
             "gpl": "This work is licensed under the GNU General Public License, version 3.",
             "cc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}
    docs, truth = [], {}
    for i in range(120):
        lines = [prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
        truth[i] = None
        if i % 3 == 0:
            truth[i] = rng.choice(list(notes))
            lines.insert(rng.randint(0, len(lines)), notes[truth[i]])
        docs.append((i, "\n".join(lines), "en", "s"))
    got = {r["doc_id"]: r for r in rows(licenses.scan(table(spark, docs)))}
    assert {i: got[i]["family"] for i in truth} == truth
    assert all(got[i]["n_paragraphs"] == len(docs[i][1].split("\n")) for i in truth)


def test_licence_sample_counts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SAMPLE", 40)
    rng = random.Random(9)
    note = "Released under the MIT License."
    lines = [f"{prose(rng, 12)} {i}" for i in range(300)]
    docs = [(i, "\n".join([*(lines[:60] * 3), lines[i], note]), "en", "s") for i in range(300)]
    sample = rows(licenses._training(licenses.raw_paragraphs(table(spark, docs))).where("family = 'unknown' AND size(words) > 0"))
    assert len({tuple(r["words"]) for r in sample}) == len(sample) == 40


def test_licence_notices_among_few_distinct_lines(spark):
    rng = random.Random(10)
    common, note = [prose(rng, 20) for _ in range(3)], "Released under the MIT License."
    for clean in ([], common):
        docs = [(i, "\n".join([*clean, note] if i % 2 or not clean else clean), "en", "s") for i in range(60)]
        for r in rows(licenses.scan(table(spark, docs))):
            noted = r["doc_id"] % 2 == 1 or not clean
            assert (r["n_predicted"], r["family"]) == ((1, "mit") if noted else (0, None)), (len(clean), r)


def test_page_evidence(spark):
    pages = spark.createDataFrame([
        (1, "https://www.a.example.de:80/x", '<!DOCTYPE html><HTML class="y" lang="de-AT"><script>let en=1</script><p>der <b>Text</b></p></html>'),
        (2, "http://b.example/", "<html><!-- lang --><p>plain</p>"), (3, None, None)],
        "page_id long, url string, html string")
    got = {r["page_id"]: r.asDict() for r in language.of_pages(pages).select(pages, pages["page_id"]).collect()}
    assert (got[1]["_declared"], got[1]["_host"], got[1]["_domain"], got[1]["_suffix"]) == ("de", "www.a.example.de", "example.de", "de")
    assert got[1]["_text"].split() == ["der", "Text"] and got[2]["_text"].split() == ["plain"]
    assert got[2]["_declared"] is None and got[2]["_suffix"] == "example" and got[3]["_text"] is None
