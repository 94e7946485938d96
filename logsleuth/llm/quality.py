"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z in lower case, blank runs as one space, digits as
0) and hashed.  The number of distinct documents that hold a line is counted
for each host; lines held by more than ``MAX_DOCS`` documents and by more than
``MAX_SHARE`` of the host's documents are boilerplate and removed.  A document
is rejected if its base rules fail or if removal takes more than
``MAX_REMOVED`` of its words.

Rows of (host, document, line) are aggregated before lines are counted, so a
line in a third of all documents is summed from partial counts and its rows
are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MAX_DOCS = 20
MAX_SHARE = 0.001
MAX_REMOVED_PERCENT = 70
SYMBOLS = r"[#*$%&|<>]"


def with_repeated_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """``rows`` with the number of words in three-word windows that the array
    column ``words`` holds twice or more.

    Windows are hashed to 64 bits; where some are equal they are sorted with
    their positions, equal neighbours are the repeated windows, and the words
    they cover are summed from the gaps between positions: the cost is that of
    two sorts.  Each step is a column of its own, since lambda bodies are
    evaluated for every element."""
    n = F.size(words) - WINDOW + 1
    none = F.array().cast("array<long>")
    rows = rows.withColumn("_h", F.when(n < 2, none).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.xxhash64(*[F.get(words, (i + (k - 1)).cast("int")) for k in range(WINDOW)]))))
    rows = rows.withColumn("_m", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("_p", F.sort_array(F.transform(
        F.filter("_m", lambda x, j: (F.get("_m", j + 1)["h"] == x["h"])
                 | ((j > 0) & (F.get("_m", F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))), lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"),
                                                i.alias("last")),
                          lambda s: s["n"])
    return rows.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_m", "_p")


def base_metrics(docs: DataFrame, **keep: Column) -> DataFrame:
    """The base measures of each row's text beside the columns ``keep``; null
    texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("_text"),
                       common.words_col("text").alias("_words"),
                       F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "").alias("_lines"))
    return with_repeated_words(rows, "_words", "n_repeat_words").select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", common.BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words")


def _normal_lines(docs: DataFrame) -> DataFrame:
    """(host, id, mark, pos, norm) of the non-blank lines: ``mark`` tells rows
    apart that share a doc_id but not the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("source").alias("host"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    norm = F.regexp_replace(F.regexp_replace(F.btrim("line", F.lit(common.BLANKS)), common.GAP, " "), "[0-9]", "0")
    norm = F.translate(norm, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("host", "id", "mark", "pos", norm.alias("norm")).where("norm <> ''")


def _lines(docs: DataFrame) -> DataFrame:
    """(host, id, mark, line hash) with the words of the line, summed."""
    rows = _normal_lines(docs).select(
        "host", "id", "mark", F.xxhash64("norm").alias("hash"),
        (F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))
    return rows.groupBy("host", "id", "mark", "hash").agg(F.sum("words").alias("words"))


def frequent_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(host, hash) of the lines above both limits of their host."""
    counts = (lines.groupBy("host", "hash", "id").agg(F.lit(1).alias("one"))
              .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"))
              .where(F.col("docs") > MAX_DOCS))
    homes = docs.groupBy(F.col("source").alias("home")).agg(F.count_distinct("doc_id").alias("size"))
    return counts.join(homes, F.col("host").eqNullSafe(F.col("home"))).where(
        F.col("docs") > MAX_SHARE * F.col("size")).select("host", "hash")


def _same(df: DataFrame, host: str, key: str, mark: str) -> Column:
    """Whether a row of ``df`` (host, doc_id, mark) is the document of the other columns."""
    return df["host"].eqNullSafe(F.col(host)) & df["doc_id"].eqNullSafe(F.col(key)) & (df["mark"] == F.col(mark))


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base measures, base_failed,
    n_removed (words in removed lines), kept.

    Null texts count as empty, a null source is a host of its own, null
    doc_ids count as one document.  A line counts once for each doc_id, so
    repeated rows do not make it frequent; each repeated row is judged alike.
    An empty table gives an empty one; other columns are not read."""
    common.prepare(docs.sparkSession)
    lines = _lines(docs).checkpoint()  # three branches read it: normalise and hash once
    return _judged(docs, lines, _bad_lines(lines, docs)).drop("host", "mark")


def kept_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that ``quality`` keeps, without the lines that
    it counts in n_removed; the other lines stand as they were, in their order."""
    common.prepare(docs.sparkSession)
    lines = _lines(docs).checkpoint()
    bad = _bad_lines(lines, docs).checkpoint()
    # stored, so that the filter is not pushed into the measures; equal rows are judged alike
    judged = _judged(docs, lines, bad).select("host", "doc_id", "mark", "kept").checkpoint()
    sure = judged.where("kept").select(F.col("host").alias("k_host"), F.col("doc_id").alias("k_id"),
                                       F.col("mark").alias("k_mark")).distinct()
    kept = docs.select(F.col("source").alias("host"), "doc_id", F.xxhash64("text").alias("mark"), "text")
    kept = kept.join(sure, _same(kept, "k_host", "k_id", "k_mark"), "left_semi")
    at = _normal_lines(docs).select("host", "id", "mark", "pos", F.xxhash64("norm").alias("hash"))
    at = at.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("hash") == F.col("bad_hash")))
    at = at.groupBy(F.col("host").alias("a_host"), F.col("id").alias("a_id"), F.col("mark").alias("a_mark")).agg(
        F.collect_set("pos").alias("gone"))
    rows = kept.join(at, _same(kept, "a_host", "a_id", "a_mark"), "left").withColumn("_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"))


def _bad_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    return frequent_lines(lines, docs).select(F.col("host").alias("bad_host"), F.col("hash").alias("bad_hash"))


def _judged(docs: DataFrame, lines: DataFrame, bad: DataFrame) -> DataFrame:
    """The columns of ``quality`` with host and mark."""
    hit = lines.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("hash") == F.col("bad_hash")))
    removed = hit.groupBy("host", "id", "mark").agg(F.sum("words").alias("gone"))
    # equal rows have been summed together: how many there are, to divide by
    copies = lines.groupBy("host", "id", "mark").agg(F.sum("words").alias("had"))
    removed = removed.select(F.col("host").alias("r_host"), F.col("id").alias("r_id"), F.col("mark").alias("r_mark"), "gone")
    share = (copies.join(removed, F.col("host").eqNullSafe(F.col("r_host")) & F.col("id").eqNullSafe(F.col("r_id"))
                         & (F.col("mark") == F.col("r_mark")))
             .select("r_host", "r_id", "r_mark", "gone", "had"))
    base = base_metrics(docs, doc_id=F.col("doc_id"), host=F.col("source"), mark=F.xxhash64("text"))
    out = base.join(share, _same(base, "r_host", "r_id", "r_mark"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.expr("n_words * gone div had"), F.lit(0)).cast("long")
    return out.select(
        "host", "mark", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.alias("n_removed"),
        (~failed & (100 * gone <= MAX_REMOVED_PERCENT * F.col("n_words"))).alias("kept"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS a FROM d),
g AS (SELECT doc_id, unnest(range(1, len(a) - 1)) AS i, a FROM w),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a[i], a[i + 1], a[i + 2]) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS a FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
r AS (SELECT doc_id, source, len(a) AS words, translate(regexp_replace(array_to_string(a, ' '), '[0-9]', '0', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, line FROM m),
f AS (SELECT source, norm FROM r JOIN (SELECT source, count(DISTINCT doc_id) AS size FROM d GROUP BY source) USING (source)
      GROUP BY source, norm, size HAVING count(DISTINCT doc_id) > {MAX_DOCS} AND count(DISTINCT doc_id) > {MAX_SHARE} * size),
x AS (SELECT doc_id, count(line) - count(DISTINCT line) AS n_dup_lines,
             sum(CASE WHEN f.norm IS NOT NULL THEN words ELSE 0 END) AS gone
      FROM r LEFT JOIN f USING (source, norm) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(a)::BIGINT AS n_words, length(array_to_string(a, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(gone, 0)::BIGINT AS n_removed
      FROM w LEFT JOIN x ON w.doc_id = x.doc_id LEFT JOIN p ON w.doc_id = p.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
       AND 100 * n_removed <= {MAX_REMOVED_PERCENT} * n_words AS kept
FROM b
"""
