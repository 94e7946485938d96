"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and
identifier cues.  Each anchor is handed to a local parser that expands it to
both sides and validates the boundaries; text without anchors costs the
automaton only.

Base kinds are leftmost and do not overlap within a kind: a match that fails
its validation is used up all the same.  Added kinds: ``url`` (an address with
user information before its host), ``account`` (IBAN with a valid check number
after its cue, or an account number with digits), ``secret`` (a token, key or
password value after its cue).  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logsleuth.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"://[^\s/@<>\"']+@[A-Za-z0-9.\[\]:-]*[A-Za-z0-9\]](?:/[^\s<>\"']*)?")
_GAP = r"[ \t]*(?:(?:number|no\.?|id)[ \t]*)?(?:[:=#][ \t]*)?"
_IBAN = re.compile(_GAP + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(_GAP + r"([0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])", re.IGNORECASE)
_VALUE = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/=.-]{8,})")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
_SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for kind, cues in (("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                found.add_word(form, kind)
    found.make_automaton()
    return found


_ANCHORS = None


def _anchors(text: str):
    global _ANCHORS
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    return _ANCHORS.iter(text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest prefix of text[start:end] that is a valid IBAN."""
    stops, packed = [], ""
    for i in range(start, end):
        if text[i] != " ":
            packed += text[i]
            stops.append(i + 1)
    for n in range(min(34, len(packed)), 14, -1):
        turned = packed[4:n] + packed[:4]
        if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
            return stops[n - 1]
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, ordered by kind as in ``KINDS``, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)  # up to where a kind's matches have used the text
    digits_end = 0
    for last, what in _anchors(text):
        if what == "digit":
            if last >= end["ip"] and (last >= digits_end or last == end["ip"]):
                m = _QUAD.match(text, last)
                if m:
                    end["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                        out["ip"].append(m.span())
            if last >= digits_end:
                digits_end = _DIGITS.match(text, last).end()
            if last >= end["card"]:
                m = _NUMBER.match(text, last)
                if m:
                    end["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
        elif what == "at":
            m = _DOMAIN.match(text, last)
            if m:
                start = last
                while start > end["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last:
                    out["email"].append((start, m.end()))
                    end["email"] = m.end()
        elif what == "plus":
            if last >= end["phone"] and (m := _PHONE.match(text, last)):
                end["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif what == "scheme":
            at = last - 2
            if at >= end["url"] and (m := _USERINFO.match(text, at)):
                start = at
                while start > end["url"] and text[start - 1] in _SCHEME:
                    start -= 1
                while start < at and not text[start].isalpha():
                    start += 1
                if start < at:
                    out["url"].append((start, m.end()))
                    end["url"] = m.end()
        elif what == "account":
            if last + 1 >= end["account"]:
                m = _IBAN.match(text, last + 1)
                stop = m and _iban_end(text, *m.span(1))
                if not stop:
                    m = _ACCOUNT.match(text, last + 1)
                    stop = m and m.end(1)
                if stop:
                    out["account"].append((m.start(1), stop))
                    end["account"] = stop
        elif last + 1 >= end["secret"] and (m := _VALUE.match(text, last + 1)):
            # a value without a digit is used up too: a value that starts inside it ends where it ends
            end["secret"] = m.end(1)
            if any("0" <= c <= "9" for c in m.group(1)):
                out["secret"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the upper-case
    kind of its first span in angle brackets."""
    parts, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            parts += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``, an array of (kind, start, end), for each row.

    Null texts have no spans; rows are independent, so repeated rows give
    repeated results and an empty table an empty one.  Columns other than
    ``keep`` and the text are not read."""
    common.prepare(docs.sparkSession)
    rows = docs.select(*keep, text)
    kinds = dict(rows.dtypes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)]
                 for t in _strings(batch.column(len(keep)))]
        return pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(found, kind)],
                                          names=[*keep, "spans"])
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return common.map_batches(rows, work, f"{schema}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the
    base spans, all spans, and the number of added spans.  See ``scan``."""
    common.prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for t in _strings(batch.column(1)):
            spans = find_spans(t)
            base = [x for x in spans if x[0] in BASE]
            for i, k in enumerate(BASE):
                cols[i].append(sum(x[0] == k for x in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(spans))
            cols[6].append(len(spans) - len(base))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])
    return common.map_batches(rows, work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email bigint, n_ip bigint, "
                              "n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, where
    present, set to the new length.  Null texts stay null; every row stays."""
    common.prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        new = [t if t is None else redact(t, find_spans(t)) for t in cols[at].to_pylist()]
        cols[at] = pa.array(new, cols[at].type)
        if size is not None:
            cols[size] = pa.array([n if t is None else len(t) for t, n in zip(new, cols[size].to_pylist())],
                                  pa.int64()).cast(cols[size].type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return common.map_batches(docs, work, docs.schema)
