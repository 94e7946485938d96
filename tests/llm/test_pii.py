import hashlib
import random
import re
import time

from logsleuth.llm import pii
from tests.llm.helpers import rows, table

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_base(text):
    return [(k, m.start(), m.end()) for k, rule in RULES.items()
            for m in re.finditer(rule, text) if fits(k, m.group())]


def base(text):
    return [x for x in pii.find_spans(text) if x[0] in pii.BASE]


def test_base_spans_equal_the_rules():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "  ", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111",
            "10.0.0.1", "+49 (30) 123-456", "x@y.example", "é", "\n", "%", "(", ")", "0", "9.9", "@b.c@d.e", "00001.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base(text) == slow_base(text), text


def test_added_kinds_and_validation():
    text = 'IBAN: DE89 3704 0044 0532 0130 00 paid; token = "24be64439e3e49cf46b2"; ftp://bob:pw1@files.example.org/x'
    found = {k: text[s:e] for k, s, e in pii.find_spans(text)}
    assert found["account"] == "DE89 3704 0044 0532 0130 00"
    assert found["secret"] == "24be64439e3e49cf46b2"
    assert found["url"] == "ftp://bob:pw1@files.example.org/x"
    assert not [x for x in pii.find_spans("IBAN DE00 3704 0044 0532 0130 00 is wrong") if text[x[1]:x[2]].startswith("DE")]
    assert pii.find_spans(None) == pii.find_spans("") == pii.find_spans("no personal data here") == []


def test_report_and_redaction(spark):
    text = "é mail ann.lee@mail.example.com or +1 (555) 123-4567 now"
    docs = table(spark, [(1, text, "en", "s"), (2, None, "en", "s")])
    got = {r["doc_id"]: r for r in rows(pii.report(docs))}
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_base(text))
    assert got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_phone"], got[2]["n_email"], got[2]["spans"]) == (1, 1, 0, "")
    clean = {r["doc_id"]: r for r in rows(pii.redacted(docs))}
    assert clean[1]["text"] == "é mail <EMAIL> or <PHONE> now" and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] is None and clean[2]["n_chars"] is None


def test_overlapping_spans_are_replaced_once():
    text = "call +1 4111 1111 1111 1111 1 now"
    assert pii.redact("ab", [("card", 0, 2), ("phone", 1, 2)]) == "<CARD>"
    assert "4111" not in pii.redact(text, [("phone", 5, 20), ("card", 8, 29)])


def test_repeated_cues_take_linear_time():
    def seconds(text):
        start = time.perf_counter()
        pii.find_spans(text)
        return time.perf_counter() - start
    for unit in ("secret=", "token:a", "account   ", "iban number", "konto" + " " * 50, "@a.", "+1 (", "://a", "1.1-", "secret\t"):
        seconds(unit * 1000)
        assert seconds(unit * 40_000) < 20 * max(seconds(unit * 4_000), 0.01), unit


def test_a_value_without_digits_hides_no_later_one():
    text = "secret=my_token : abc12345 and password=passwd=letters; token=secret=onlyletters9 account   number  =  12345678"
    assert [text[s:e] for _, s, e in pii.find_spans(text) if _ != "card"] == ["12345678", "abc12345", "secret=onlyletters9"]
