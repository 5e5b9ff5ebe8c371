"""Quality rules with a cross-document line frequency rule, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and words in repeated three-word windows. The method
then normalises every line (lower case, white space collapsed), hashes it, counts the documents of each host that hold
it, and removes the lines that more documents of a host hold than the limits allow; a document that loses more than
half of its words that way is rejected.

Every distinct line of a document is one small row (host, hash, words); counts are pre-aggregated, and the join with
the few lines over the limit is salted, so a line or a host that is in a third of all documents is spread.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; a repeated row
is a document of its own with the same result; a null doc_id is returned as such; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import SPACES, Scratch, computed_once, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is over the limit in more documents of its host than this many, and than this share of the host's documents.
MAX_DOCUMENTS, MAX_SHARE = 20, 0.01
#: A document is kept while at least this percentage of its words is left.
MIN_LEFT_PERCENT = 50
SALTS = 32
#: Rows of frequent lines, of some tens of bytes, that may be broadcast.
BROADCAST_ROWS = 100_000


def base_rules(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, _host, _key (hash of the text) and the base columns of every document.

    Three-word windows are 64-bit hashes; sorted with their places, equal ones are neighbours. Texts without an equal
    pair stop before that.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.col(host).alias("_host"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    out = computed_once(out, _words=words(F.col("_text")), _lines=F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    n = F.size("_words")
    three = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, n).alias("b"), F.slice("_words", 3, n).alias("c"))
    hashes = F.transform(F.slice(three, 1, n - 2), lambda w: F.xxhash64(w))
    out = computed_once(out, _windows=F.when(n > 3, hashes).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    places = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = computed_once(out, _sorted=F.when(some, places).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_sorted", lambda x, k: x["h"].eqNullSafe(F.get("_sorted", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_sorted", k + 1)["h"]))
    # Each repeated window covers three words, less those that the one before it covers.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    return out.select(
        "doc_id", "_host", "_key",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        total.cast("long").alias("n_repeat_words"),
    )


def lines(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, _host, _key, _line, _n, _words): each distinct normalised line of a document, how often, and its words."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    flat = F.regexp_replace(text, r"[ \t\x0B\x0C\r]+", " ")
    split = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    each = F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))
    rows = docs.select("doc_id", F.col(host).alias("_host"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_key"), "text")
    rows = computed_once(rows, _each=F.sort_array(each)).drop("text")
    # In the sorted lines equal ones are neighbours; the distance between the first places of two lines is the first one's count.
    first = F.filter(F.sequence(F.lit(0), F.size("_each")), lambda i: (i == F.size("_each")) | ~F.get("_each", i)["h"].eqNullSafe(F.get("_each", i - 1)["h"]))
    rows = computed_once(rows, _at=first)
    runs = F.transform("_at", lambda a, k: F.struct(F.get("_each", a)["h"].alias("_line"), (F.get("_at", k + 1) - a).alias("_n"), F.get("_each", a)["w"].alias("_words")))
    rows = rows.select("doc_id", "_host", "_key", F.inline(F.slice(runs, 1, F.size("_at") - 1)))
    return rows.select("doc_id", "_host", "_key", "_line", "_n", "_words")


def frequent_lines(docs: DataFrame, found: DataFrame, host: str, max_documents: int, max_share: float) -> DataFrame:
    """(_host, _line) over the limits."""
    hosts = docs.groupBy(F.col(host).alias("_of")).agg(F.count("*").alias("_docs"))
    counts = found.groupBy("_host", "_line").agg(F.count("*").alias("_in")).where(F.col("_in") > max_documents)
    return counts.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_in") > F.col("_docs") * max_share).select("_host", "_line")


def apply_rules(spark: SparkSession, docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """One row per document: the base columns, base_failed, n_common_words (words in removed lines) and kept."""
    scratch = Scratch(spark, "quality-rules")
    found = lines(docs, host)
    over = scratch.save(frequent_lines(docs, found, host, max_documents, max_share), "over")
    # Frequent lines grow with the hosts: they are broadcast up to a number of rows, and merged beyond it.
    few = over.count() * SALTS <= BROADCAST_ROWS
    over = over.select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("_s")).hint("broadcast" if few else "merge")
    salted = found.withColumn("_salt", F.pmod(F.col("_key"), F.lit(SALTS)).cast("int"))
    hit = salted.join(over, (F.col("_line") == F.col("_l")) & (F.col("_salt") == F.col("_s")) & F.col("_host").eqNullSafe(F.col("_h")))
    # Copies of a row have the same lines and the same sum, so one distinct row of each stands for all.
    removed = hit.groupBy("doc_id", "_key", "_host", "_line").agg(F.max(F.col("_n") * F.col("_words")).alias("_words"))
    removed = removed.groupBy("doc_id", "_key", "_host").agg(F.sum("_words").cast("long").alias("n_common_words"))
    removed = removed.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("_host").alias("_o"), "n_common_words")
    rules = base_rules(docs, host)
    out = rules.join(removed, rules["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & F.col("_host").eqNullSafe(F.col("_o")), "left")
    common = F.coalesce("n_common_words", F.lit(0).cast(T.LongType()))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    enough = (F.col("n_words") - common) * 100 >= F.col("n_words") * min_left_percent
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), common.alias("n_common_words"))


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the rules over all documents, a document's source as its host."""
    return apply_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


RATE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
repeats AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY row),
raw_lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts),
dups AS (
  SELECT row, count(*) - count(DISTINCT line) AS n FROM raw_lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
clean AS (
  SELECT t.row, source, trim(regexp_replace(line, '[ \t\x0B\x0C\r]+', ' ', 'g'), ' ') AS line
  FROM (SELECT row, unnest(string_split(lower(text), chr(10))) AS line FROM texts) l JOIN texts t USING (row)),
counted AS (
  SELECT row, source, line, count(*) * (length(line) - length(replace(line, ' ', '')) + 1) AS words
  FROM clean WHERE line <> '' GROUP BY row, source, line),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
over AS (
  SELECT c.source, c.line FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  GROUP BY c.source, c.line, h.docs HAVING count(*) > 20 AND count(*) > h.docs * 0.01::DOUBLE),
common AS (
  SELECT c.row, sum(c.words)::BIGINT AS n FROM counted c JOIN over o
  ON c.line = o.line AND c.source IS NOT DISTINCT FROM o.source GROUP BY c.row),
base AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS n_common_words
  FROM texts t LEFT JOIN dups d USING (row) LEFT JOIN repeats r USING (row) LEFT JOIN common c USING (row)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words - n_common_words) * 100 >= n_words * 50 AS kept, n_common_words FROM judged
"""
