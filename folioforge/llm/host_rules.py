"""Quality rules by host, in DataFrame functions only.

Each document meets the base rules. Failures are counted by host; a host's rate is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves
(method of moments, hosts weighted alike), so that a host of few documents is not
judged by chance. A document stays if it meets the base rules and its host's shrunk
rate is within bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import WORD, n_words, settled, table

WINDOW = 8
MIN_WORDS = 20
#: Most percent of words in repeated windows.
MAX_REPEATED = 30
#: Shrunk failure rate from which all of a host's documents go.
HOST_LIMIT = 0.5
SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of ``window`` words that occur twice or more in an array of words.

    Windows are hashed, sorted with their places, and those equal to a neighbour kept; the places then give the
    length of the union. No step compares all pairs.
    """

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        # most texts repeat nothing: a set of the hashes says so at less cost
        return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), _covered)))

    def _covered(s: Column) -> Column:
        places = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return _let(F.array_sort(F.filter(places, lambda p: p.isNotNull())), lambda p: F.coalesce(F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b), F.lit(0)))

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(of_words(words))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``; a null text has no word."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    line = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    found = docs.select(
        "id",
        "host",
        n_words("text").alias("n_words"),
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(line, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(host, n_docs, n_failed, rate, host_kept)``, one row for each host, null among them.

    The prior's mean is the mean of the hosts' rates and its strength follows from their variance beyond chance;
    hosts that do not differ beyond chance share one rate.
    """
    counts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    all_hosts = counts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1.0 / F.col("n_docs")).alias("inv"), F.count("*").alias("hosts"))
    # variance of rates = mean (1 - mean) (inv + (1 - inv) / (strength + 1)), solved for the strength
    spread = F.col("mean") * (1 - F.col("mean"))
    extra = (F.col("var") / spread - F.col("inv")) / (1 - F.col("inv"))
    strength = F.when((spread > 0) & (F.col("inv") < 1) & (extra > 0), F.least(1.0 / extra - 1, F.lit(1e6))).otherwise(F.lit(1e6))
    prior = all_hosts.select("mean", F.greatest(strength, F.lit(1e-6)).alias("strength"))
    joined = counts.join(F.broadcast(prior))  # one row by construction
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return joined.select("host", "n_docs", "n_failed", shrunk.alias("rate")).withColumn("host_kept", F.col("rate") < limit)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures of each row of ``docs`` with ``host_rate`` and ``kept``.

    Null hosts form a host of their own; repeated rows count each. An empty table gives an empty result.
    """
    own = settled(measures(docs, id_col, text_col, host_col), "measures")
    hosts = host_verdicts(own, limit).select(F.col("host").alias("host_"), F.col("rate").alias("host_rate"), "host_kept")
    out = own.join(hosts, own.host.eqNullSafe(F.col("host_")), "left").drop("host_")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_kept")


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    """Base measures of each document and the verdict of the rules and its host."""
    out = judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, source, t, w, len(w) AS n_words,
         list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')) AS g,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), place AS (
  SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM win
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM place) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS r
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) GROUP BY doc_id
), meas AS (
  SELECT win.doc_id, source, n_words::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM win LEFT JOIN rep ON win.doc_id = rep.doc_id
), failed AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM meas
), host AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM failed GROUP BY source
), moments AS (
  SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1.0 / n) AS inv FROM host
), prior AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 AND inv < 1 AND v / (m * (1 - m)) > inv
              THEN greatest(least(1 / ((v / (m * (1 - m)) - inv) / (1 - inv)) - 1, 1e6), 1e-6) ELSE 1e6 END AS s
  FROM moments
), verdict AS (
  SELECT source, (k + m * s) / (n + s) < 0.5 AS ok FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND ok) AS kept
FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source
"""
