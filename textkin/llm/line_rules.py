"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules fail a text of fewer than MIN_WORDS words, or with over REPEAT_PERCENT per cent of its words inside 5-word
windows that the text holds twice or more. Then, per host, each normalised line (lower-cased, words joined by one
space) is counted in distinct texts, so exact copies of one text count once. A line in more than MIN_TEXTS texts and
more than MAX_SHARE of the host's texts is boilerplate and removed; a text with fewer than MIN_WORDS words or less
than MIN_LEFT of its words left is depleted and rejected.

Null and empty texts have no words and fail; a null host is a host of its own; repeated rows get the same verdict and
count once; an empty table gives an empty table. `filtered` returns kept texts without their boilerplate lines; their
other lines, blank ones too, and the other columns of the input pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, table, words, written

MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
MIN_TEXTS, MAX_SHARE, MIN_LEFT = 10, 0.02, 0.3
KEYS = ["id", "text_hash", "host"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_texts(text) -> F.Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(df: DataFrame, words_col: str) -> DataFrame:
    """Adds n_repeat_words: words inside windows of WINDOW words that the text holds twice or more, the first included.

    Windows are compared by their 64-bit hash. Only texts with an equal pair of windows sort theirs."""
    w = F.col(words_col)
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    df = df.withColumn("_hash", F.when(F.size(w) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.array_sort(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"]))
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"])))
    at = F.col("_at")
    steps = F.transform(at, lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, j - 1))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_hash", "_sorted", "_at")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and base_failed to docs."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text_col)))
    df = df.withColumn("_lines", line_texts(F.col(text_col)))
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    df = repeat_words(df, "_words").drop("_words", "_lines")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _keys(id_col: str, text_col: str, host_col: str) -> list[F.Column]:
    return [F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x01")).alias("host")]


def normal(line) -> F.Column:
    """A line lower-cased, its words joined by one space."""
    return F.trim(F.regexp_replace(F.lower(line), WORD_GAP, " "))


def line_hashes(text) -> F.Column:
    """(line, words) of each line with a word: the normalised line's hash and its number of words."""
    clean = F.transform(line_texts(text), normal)
    return F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, text_hash, host, the base columns, lines): all that the rules need of a row, from one pass over the texts.

    Written, as a filter pushed into these array functions would evaluate them again and again."""
    slim = docs.select(*_keys(id_col, text_col, host_col), F.col(text_col).alias("_text"))
    return written(base_rules(slim, "_text").withColumn("lines", line_hashes(F.col("_text"))).drop("_text"))


def frequent_lines(known: DataFrame) -> DataFrame:
    """(host, line): the boilerplate of `facts`. Distinct texts are counted per (host, line, text) first, so a common line is spread."""
    counted = known.select("host", "text_hash", F.explode("lines.line").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > MIN_TEXTS)
    hosts = known.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    return counted.join(hosts, "host").where(F.col("n") > MAX_SHARE * F.col("texts")).select("host", "line")


def without_lines(text, lines) -> F.Column:
    """The text less its lines whose normalised hash is in lines; the others stay as they are. With null lines, the text."""
    return F.when(lines.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(lines, F.xxhash64(normal(x)))), "\n"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, text_hash, host, the base columns, n_removed_words, removed_lines, kept), a row for each row of docs.

    removed_lines holds the hashes of the text's boilerplate lines, null if it has none.

    Texts aren't shuffled: what is joined back by (id, text, host) are removed-word sums and line hashes. The table of boilerplate lines is
    broadcast by Spark only while its written size is under spark.sql.autoBroadcastJoinThreshold."""
    known = facts(docs, id_col, text_col, host_col)
    base, common = known.drop("lines"), written(frequent_lines(known))
    lines = known.select(*KEYS, F.explode("lines").alias("e")).select(*KEYS, "e.line", "e.words")
    hit = lines.join(common, ["host", "line"]).groupBy(*KEYS).agg(F.sum("words").alias("w"), F.collect_set("line").alias("removed_lines"))
    # a row that stands n times has n times the words
    repeated = base.groupBy(*KEYS).agg(F.count("*").alias("times")).where("times > 1")
    removed = hit.join(repeated, KEYS, "left").select(F.col("id").alias("_i"), F.col("text_hash").alias("_t"), F.col("host").alias("_h"), (F.col("w") / F.coalesce("times", F.lit(1))).cast("long").alias("w"), "removed_lines")
    out = base.join(removed, F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_t")) & (F.col("host") == F.col("_h")), "left").drop("_i", "_t", "_h")
    out = out.withColumn("n_removed_words", F.coalesce("w", F.lit(0).cast("long"))).drop("w")
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= MIN_LEFT * F.col("n_words")))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, text_hash, host, the base columns, n_removed_words, kept), a row for each row of docs."""
    return judged(docs, id_col, text_col, host_col).drop("removed_lines")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns, the text without its boilerplate lines."""
    stay = judged(docs, id_col, text_col, host_col).where("kept").select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("removed_lines").alias("_removed_lines")).dropDuplicates([f"_{k}" for k in KEYS])
    own = dict(zip(KEYS, _keys(id_col, text_col, host_col), strict=True))
    marked = docs.withColumns({f"_own_{k}": c for k, c in own.items()})
    kept = marked.join(stay, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_text_hash") == F.col("_text_hash")) & (F.col("_own_host") == F.col("_host")))
    return kept.withColumn(text_col, without_lines(F.col(text_col), F.col("_removed_lines"))).select(docs.columns)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "n_removed_words")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, i - prev)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5) AS prev FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, t, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, t, host, unnest(ls) AS x FROM w)),
c AS (SELECT host, line, count(DISTINCT t) AS n FROM l GROUP BY 1, 2),
h AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY 1),
f AS (SELECT host, line FROM c JOIN h USING (host) WHERE n > 10 AND n > CAST(0.02 AS DOUBLE) * texts),
gone AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM l JOIN f USING (host, line) GROUP BY 1),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept
FROM b
"""
