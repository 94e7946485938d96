"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for each row:

* text: log-likelihood of its hashed byte trigrams under one profile for each
  language, learned from all rows that declare a language, and under a flat
  profile ``und`` for text in none of them.  Neighbouring trigrams overlap, so
  the sum is tempered;
* the declared language of the markup or the metadata, by how often rows whose
  text speaks clearly for a language declare it;
* the suffix of the address, likewise;
* the host: a prior smoothed hierarchically, host towards its parent domain,
  that towards the whole corpus, from counts by grouped aggregation.

The ``MAX_LANGUAGES`` tags that most rows declare, ``MIN_DECLARED`` at least,
have profiles.  Text in another language is likeliest under the flat profile:
where it is and the row declares a tag without a profile, that tag is its
language, with the text's own posterior of ``und``.  The priors of hosts and
corpus say nothing about languages without a profile.

A row is kept if it has letters and the best language, other than ``und``,
reaches ``MIN_POSTERIOR``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.llm import common, hashing

DIMS = 1 << 15
MAX_LANGUAGES = 256     # profiles; the rows of further tags go by their declaration
MIN_DECLARED = 5        # rows that must declare a language before it gets a profile
TEMPER = 0.25
CLEAR = 0.95            # text posterior from which a row counts in the evidence tables
PRIOR_ROWS = 20.0       # weight of the parent in a smoothed host prior, in rows
MIN_POSTERIOR = 0.5
UND, UND_PRIOR = "und", 1e-3
MAX_BROADCAST_ROWS = 100_000
_RUN = 1 << 18

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of the trigrams around each letter of a column's
    texts; other characters than letters count as blanks."""
    words = pc.fill_null(part.cast(pa.large_binary()), b"")
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    if data is None or at[-1] - at[0] < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.diff(at)
    raw = _FOLD[np.frombuffer(data, np.uint8)[at[0]:at[-1]]]
    x = np.full(len(raw) + 2 * len(size) + 2, 32, np.uint32)  # two blanks before each text
    owner = np.repeat(np.arange(len(size)), size)
    x[np.arange(len(raw)) + 2 * (owner + 1)] = raw
    whose = np.repeat(np.arange(len(size) + 1), np.append(size, 0) + 2)[:len(x)]
    a, b, c = x[:-2], x[1:-1], x[2:]
    keep = b != 32
    slot = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) >> np.uint32(17)
    return slot[keep].astype(np.int64), whose[:-2][keep]


def tag(column: Column | str) -> Column:
    """Primary subtag of a declared language, or null."""
    column = F.col(column) if isinstance(column, str) else column
    code = F.regexp_extract(F.lower(F.trim(column.cast("string"))), r"^([a-z]{2,3})(?:[-_][a-z0-9-_]*)?$", 1)
    return F.when((code != "") & (code != UND), code)


@dataclass
class Evidence:
    """Columns of the input: text, declared language, host and address (or null)."""
    text: Column
    declared: Column
    host: Column
    address: Column

    def select(self, df: DataFrame, *keep: Column) -> DataFrame:
        host = F.lower(self.host.cast("string"))
        return df.select(*keep, self.text.cast("string").alias("_text"), tag(self.declared).alias("_declared"),
                         host.alias("_host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("_domain"),
                         F.lower(F.regexp_extract(self.address.cast("string"),
                                                  r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#:]*\.([a-zA-Z]{2,})(?:[/?#:]|$)",
                                                  1)).alias("_suffix"))


def of_documents(docs: DataFrame) -> Evidence:
    return Evidence(F.col("text"), F.col("lang"), F.col("source"), F.col("source"))


def of_pages(pages: DataFrame) -> Evidence:
    """Web pages (url, html): the text between the tags, the language that the
    html tag declares, the host and the address."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return Evidence(text, F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1),
                    F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.col("url"))


@dataclass
class Model:
    languages: list[str]         # with UND last
    profiles: np.ndarray         # log-probabilities, (languages, DIMS)
    tables: dict[str, DataFrame]  # evidence -> (key, logs)
    small: dict[str, bool]       # whether a table's size lets it be broadcast
    base: np.ndarray             # log-prior of the whole corpus


def _profiles(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and trigram log-probabilities from all rows that declare one of them."""
    declared = rows.where("_declared IS NOT NULL").groupBy("_declared").count().where(F.col("count") >= MIN_DECLARED)
    languages = sorted(r[0] for r in declared.orderBy(F.desc("count"), "_declared").limit(MAX_LANGUAGES).collect())
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(number), DIMS), np.int64)
        for batch in batches:
            of = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for lo, part in hashing.slices(batch.column(1).cast(pa.large_binary()), _RUN):
                slot, whose = _trigrams(part)
                lang = of[lo:lo + len(part)][whose]
                known = lang >= 0
                total += np.bincount(lang[known] * DIMS + slot[known],
                                     minlength=total.size).reshape(total.shape)
        lang, slot = np.nonzero(total)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(total[lang, slot])],
                                             names=["lang", "slot", "n"])
    counts = np.full((len(languages) + 1, DIMS), 0.05)
    if languages:
        found = (rows.select("_declared", "_text").mapInArrow(count, "lang bigint, slot bigint, n bigint")
                 .groupBy("lang", "slot").agg(F.sum("n").alias("n")))
        for r in found.toLocalIterator():  # at most MAX_LANGUAGES x DIMS rows
            counts[r[0], r[1]] += r[2]
    counts[-1] = 1.0
    return [*languages, UND], np.log(counts / counts.sum(1, keepdims=True))


def _with_likelihood(rows: DataFrame, languages: list[str], profiles: np.ndarray) -> DataFrame:
    """``rows`` with ``_ll`` (tempered log-likelihoods) and ``_n`` (trigrams)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(profiles.T))
    at = rows.columns.index("_text")
    width = len(languages)
    run = max(1 << 12, _RUN * 4 // width)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ll = np.zeros((batch.num_rows, width))
        n = np.zeros(batch.num_rows, np.int64)
        for lo, part in hashing.slices(batch.column(at).cast(pa.large_binary()), run):
            slot, whose = _trigrams(part)
            for a in range(0, len(slot), run):
                logs, of = shared.value[slot[a:a + run]], whose[a:a + run]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                ll[lo + of[first]] += np.add.reduceat(logs, first, axis=0)
            n[lo:lo + len(part)] = np.bincount(whose, minlength=len(part))[:len(part)]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()),
                                        pa.array((ll * TEMPER).ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(n)], names=[*batch.schema.names, "_ll", "_n"])
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return common.map_batches(rows, work, f"{fields}, _ll array<double>, _n bigint")


def _doubles(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def fit(df: DataFrame, evidence: Evidence) -> Model:
    """Profiles, evidence tables and host priors from all rows of ``df``."""
    common.prepare(df.sparkSession)
    rows = evidence.select(df)
    languages, profiles = _profiles(rows)
    scored = _with_likelihood(rows, languages, profiles)
    own = _softmax(F.col("_ll"))
    clear = (scored.where("_n > 0").select("_declared", "_host", "_domain", "_suffix", own.alias("p"))
             .where(F.array_max("p") >= CLEAR)
             .select(F.coalesce("_declared", F.lit("")).alias("_declared"), "_host", "_domain", "_suffix",
                     (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("lang"))
             .groupBy("_declared", "_host", "_domain", "_suffix", "lang")
             .agg(F.count(F.lit(1)).alias("n")).checkpoint())
    width = len(languages)

    def vectors(key: str) -> DataFrame:
        """key -> array of counts by language."""
        by = clear.groupBy(key).agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"c{i}")
                                      for i in range(width)])
        return by.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.array(*[F.col(f"c{i}").cast("double") for i in range(width)]).alias("c"))

    total = np.zeros(width)
    for r in clear.groupBy("lang").agg(F.sum("n")).collect():
        total[r[0]] = r[1]
    base = (total + 1) / (total + 1).sum()
    base[-1] = UND_PRIOR
    base /= base.sum()

    def likelihood(key: str) -> DataFrame:
        """log P(value | language): a value's share of a language's rows, smoothed by half a row."""
        return vectors(key).select("key", F.transform("c", lambda x, i: F.log(
            (x + 0.5) / (F.element_at(_doubles(total), i + 1) + 1.0))).alias("logs"))

    def shrunk(counts: Column, parent: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, parent, lambda c, p: (c + PRIOR_ROWS * p) / (size + PRIOR_ROWS))

    flat = _doubles(base)
    domains = vectors("_domain").select(F.col("key").alias("domain"), shrunk(F.col("c"), flat).alias("dp"))
    homes = clear.select(F.col("_host").alias("key"), F.col("_domain").alias("domain")).distinct()
    hosts = (vectors("_host").join(homes, "key").join(domains, "domain", "left")
             .select("key", F.transform(shrunk(F.col("c"), F.coalesce("dp", flat)), lambda x: F.log(x)).alias("logs")))
    tables = {"_declared": likelihood("_declared"), "_suffix": likelihood("_suffix"), "_host": hosts}
    tables = {k: t.checkpoint() for k, t in tables.items()}
    small = {k: t.count() <= MAX_BROADCAST_ROWS for k, t in tables.items()}
    return Model(languages, profiles, tables, small, np.log(base))


def identify(df: DataFrame, evidence: Evidence, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row of ``df`` with language, posterior,
    text_language, declared and kept (boolean).

    Null and blank texts, and texts without letters, have text_language null
    and are not kept.  A null or unusual declared language, host or address is
    no evidence.  A tag without a profile is the language of its row where no
    profile fits better than the flat one.  Rows are judged each for itself, so repeated rows give
    repeated results; an empty table gives an empty one."""
    rows = evidence.select(df, *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    out = _with_likelihood(rows, model.languages, model.profiles).drop("_text")
    zero = _doubles(np.zeros(len(model.languages)))
    logs = F.col("_ll")
    for key, table in model.tables.items():
        table = table.select(F.col("key").alias(f"{key}_k"), F.col("logs").alias(f"{key}_logs"))
        on = F.coalesce(F.col(key), F.lit("")) if key == "_declared" else F.col(key)
        out = out.join(F.broadcast(table) if model.small[key] else table, on == F.col(f"{key}_k"), "left")
        other = _doubles(model.base) if key == "_host" else zero
        logs = F.zip_with(logs, F.coalesce(F.col(f"{key}_logs"), other), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in model.languages])
    without = ~F.coalesce(F.array_contains(names, F.col("_declared")), F.lit(True))  # a tag, but no profile
    out = out.withColumn("_p", _softmax(logs)).withColumn("_best", F.array_position("_p", F.array_max("_p")).cast("int"))
    own = F.array_position("_ll", F.array_max("_ll")).cast("int")
    by_tag = without & (own == len(model.languages))
    posterior = F.when(by_tag, F.element_at(_softmax(F.col("_ll")), -1)).otherwise(F.array_max("_p"))
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        F.when(by_tag, F.col("_declared")).otherwise(F.element_at(names, F.col("_best"))).alias("language"), posterior.alias("posterior"),
        F.when(F.col("_n") > 0, F.element_at(names, own)).alias("text_language"),
        F.col("_declared").alias("declared"),
        ((F.col("_n") > 0) & ((F.col("_best") < len(model.languages)) | by_tag) & (posterior >= MIN_POSTERIOR)).alias("kept"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs``, all columns unchanged, without the rows whose language is not
    identified.  Rows are judged where they stand."""
    evidence = of_documents(docs)
    return identify(docs, evidence, fit(docs, evidence), keep=tuple(docs.columns)).where("kept").select(
        *[F.col(f"`{c}`") for c in docs.columns])
