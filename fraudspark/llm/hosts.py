"""Quality measures per document and verdicts per host, in Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(w)
    windows = F.transform(
        F.slice(w, F.lit(1), n - 2),
        lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def covered(starts: Column) -> Column:
        step = F.transform(
            starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3)))
        )
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(t: Column) -> Column:
        placed = F.sort_array(F.transform(t, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, i: (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]),
        )
        starts = _let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(_let(starts, covered))

    return F.when(n < 4, 0).otherwise(_let(windows, repeated))


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(split, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    return (
        docs.select(
            docs[id_col].alias("id"),
            docs[host_col].cast("string").alias("host"),
            of_words.alias("w"),
            F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")))
            .cast("long")
            .alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
            .cast("long")
            .alias("n_dup_lines"),
        )
        .withColumn("n_words", F.col("w.n").cast("long"))
        .withColumn("n_repeat_words", F.col("w.r").cast("long"))
        .drop("w")
    )


def host_rates(failures: DataFrame) -> DataFrame:
    """Failure rate per host, shrunk to a beta prior fitted to all hosts.

    ``failures`` has ``host`` and ``failed``. The prior has the pooled rate as mean; its strength
    comes from the spread of the hosts' rates beyond binomial noise (method of moments). Without
    such spread all hosts get the pooled rate. Only the four sums of the fit reach the driver.
    """
    hosts = failures.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails")
    )
    s = hosts.agg(
        F.count("*").alias("k"),
        F.sum("docs").alias("n"),
        F.sum("fails").alias("f"),
        F.sum(F.col("docs").cast("double") * F.col("docs")).alias("nn"),
        F.sum(F.col("fails").cast("double") * F.col("fails") / F.col("docs")).alias("ff"),
    ).first()
    n, f = s.n or 0, s.f or 0
    mean = f / n if n else 0.0
    noise = mean * (1 - mean)
    free = n - s.nn / n if n else 0.0
    spread = (s.ff - n * mean * mean - (s.k - 1) * noise) / free if free > 0 else 0.0
    if spread <= 0 or noise <= 0:
        rate = F.lit(float(mean))
    else:
        strength = max(noise / spread - 1, 0.0)
        rate = (F.col("fails") + strength * mean) / (F.col("docs") + strength)
    return hosts.withColumn("rate", rate)


def host_rules(
    docs: DataFrame,
    max_rate: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Measures, base rules, and the verdict of each document's host.

    A document fails the base rules with under 50 words, or when over half of its words lie in
    repeated 3-word windows. A host whose shrunk rate of failures is over ``max_rate`` is more
    likely to be junk than not, and loses its other documents too. Null text is the empty text
    and fails; documents without a host share one. Repeated rows count each. No rows give none.

    Texts are read once; their measures are written narrow. Failures are summed map-side before
    the shuffle by host, and the join back splits a hot host's rows.
    """
    m = measures(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = stage(m.withColumn("failed", failed), "host-rules")
    rates = host_rates(m).select(F.col("host").alias("h"), "docs", "fails", "rate")
    joined = m.join(rates, m["host"].eqNullSafe(rates["h"]))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.col("failed").alias("base_failed"),
        (~F.col("failed") & (F.col("rate") <= max_rate)).alias("kept"),
        F.col("docs").alias("host_docs"),
        F.col("fails").alias("host_fails"),
    )


HOST_RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM p) WHERE c > 1),
rw AS (SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS bigint) AS n FROM r GROUP BY 1),
l AS (SELECT doc_id, CAST(count(*) - count(DISTINCT x) AS bigint) AS n
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.source, CAST(len(w.w) AS bigint) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS bigint) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
        coalesce(l.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
      FROM d JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, CAST(sum(CAST(base_failed AS int)) AS bigint) AS fails
      FROM b GROUP BY 1),
s AS (SELECT count(*) AS k, sum(docs) AS n, sum(fails) / sum(docs) AS mean,
        sum(CAST(docs AS double) * docs) AS nn, sum(CAST(fails AS double) * fails / docs) AS ff FROM h),
v AS (SELECT *, (ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS spread
      FROM s),
q AS (SELECT mean, CASE WHEN spread > 0 AND mean * (1 - mean) > 0
        THEN greatest(mean * (1 - mean) / spread - 1, 0) END AS strength FROM v),
x AS (SELECT h.*, CASE WHEN strength IS NULL THEN mean
        ELSE (fails + strength * mean) / (docs + strength) END AS rate FROM h, q)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, x.docs AS host_docs, x.fails AS host_fails
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
