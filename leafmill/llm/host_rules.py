"""Host-level quality rules, with DataFrame functions only.

Base rules are judged document by document. Failures are summed by host (partial sums before the
shuffle, so a host of any share of the rows is one row a task), and each host's failure rate is
shrunk towards the rate of all documents with a beta prior fitted to the hosts' counts by beta-binomial moments:
hosts weigh by their documents, and what binomial chance alone explains is taken off, so that many hosts of few documents
don't pass for different ones. Hosts whose shrunk rate is above a threshold are dropped with all their documents.

Bound: a text's words, window hashes and places are arrays of one row, some 60 bytes a word of the longest text.

Defined results: null or empty texts have no words, so they fail the base rules; documents of a null
host are one host; extra columns pass through, and one that is called like a result column gets `_in` behind its name;
repeated rows count as often as they occur; with one host, or hosts of one document each, or hosts no more different than
by chance, all hosts get the rate of all documents; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, beside, place, words_of, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
RESULTS = [*BASE, "shrunk_rate", "host_failed", "kept"]

MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def covered(places: Column, width: int) -> Column:
    """Number of items that windows of `width` items at ascending places cover."""
    steps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), places, lambda b, a: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def base_columns(docs: DataFrame, text_col: str = "text", window: int = 3) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumns({
        "__w": words_of(text_col), "__lines": lines,
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    # Hashes of the windows, then (hash, place) in order: a window is repeated if a neighbour has its hash.
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - window + 1), lambda i: F.xxhash64(*[F.element_at("__w", (i + k).cast("int")) for k in range(window)]))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__pairs": F.when(F.size("__w") > window, pairs).otherwise(none),
    }).drop("__w", "__lines")
    pair = F.col("__pairs")
    twice = F.filter(pair, lambda x, i: (x["h"] == F.get(pair, i - 1)["h"]) | (x["h"] == F.get(pair, i + 1)["h"]))
    step = step.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("__pairs")
    step = step.withColumn("n_repeat_words", F.when(F.size("__p") > 0, covered(F.col("__p"), window)).otherwise(F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host_col: str = "source", most_failed: float = 0.6) -> DataFrame:
    """One row a host: n_docs, n_failed, shrunk_rate and host_failed.

    With N documents at H hosts, n_i documents and k_i failures each, m = sum(k_i) / N and
    S = sum(k_i^2 / n_i) - N m^2, the share of variance between hosts is
    r = (S / (m (1 - m)) - (H - 1)) / (N - sum(n_i^2) / N - (H - 1)), kept within 0 and 1. A beta prior of strength
    1 / r - 1 and mean m gives the posterior mean (r k_i + (1 - r) m) / (r n_i + (1 - r)).
    """
    hosts = judged.groupBy(F.col(host_col).alias("__host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = written(hosts, "hosts")
    k, n = F.col("n_failed").cast("double"), F.col("n_docs").cast("double")
    sums = hosts.agg(F.sum(k).alias("k"), F.sum(n).alias("n"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("h"))
    m, free = F.col("k") / F.col("n"), F.col("h") - 1
    spread = (F.col("kk") - F.col("n") * m * m) / F.nullif(m * (1 - m), F.lit(0.0))
    share = (spread - free) / F.nullif(F.col("n") - F.col("nn") / F.col("n") - free, F.lit(0.0))
    prior = sums.select(m.alias("__m"), F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("__r"))
    r = F.col("__r")
    shrunk = (r * F.col("n_failed") + (1 - r) * F.col("__m")) / (r * F.col("n_docs") + (1 - r))
    return hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk).withColumn("host_failed", F.col("shrunk_rate") > most_failed)  # one row: not a product


def host_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_failed: float = 0.6, broadcast_rows: int = 200_000) -> DataFrame:
    """docs without the text, with the base columns, shrunk_rate, host_failed and kept.

    Texts are read once; what is left is written to the shared folder, then joined with the hosts'
    verdicts, which are broadcast up to `broadcast_rows` hosts and else joined by AQE's skew join.
    """
    rows, given = apart(docs, __text=text_col, __of=host_col)
    text = place(given, text_col)
    judged = written(base_columns(rows, "__text").drop("__text", text), "judged")
    hosts = written(host_verdicts(judged, "__of", most_failed).select("__host", "shrunk_rate", "host_failed"), "host-verdicts")
    if hosts.count() <= broadcast_rows:
        hosts = F.broadcast(hosts)
    out = judged.join(hosts, F.col("__of").eqNullSafe(F.col("__host")), "left")
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
    return out.select(*beside(given, RESULTS, [text]), *RESULTS)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(text, '') AS t
  FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
g AS (SELECT doc_id, p, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q AS x FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g WHERE x IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE n >= 2 GROUP BY doc_id),
b AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    (SELECT CAST(len(l) - len(list_distinct(l)) AS BIGINT) FROM (SELECT list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS k FROM f GROUP BY source),
t AS (SELECT sum(k) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(k * k / n) AS kk, CAST(sum(n * n) AS DOUBLE) AS nn, count(*) AS h FROM h),
m AS (SELECT *, k / n AS m FROM t),
s AS (SELECT m, least(greatest(coalesce(((kk - n * m * m) / nullif(m * (1 - m), 0) - (h - 1)) / nullif(n - nn / n - (h - 1), 0), 0), 0), 1) AS r FROM m),
r AS (SELECT source, (r * k + (1 - r) * m) / (r * n + (1 - r)) > 0.6 AS host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
