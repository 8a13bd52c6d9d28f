"""Operator 1: quality rules, lines first.  Built-in functions only; every row by itself, no shuffle.

Each line with a word is judged: it must end in punctuation, must not be navigation (separators, menu
phrases), boilerplate (fixed phrases), mostly symbols or shouting.  Lines that fail are removed; a
document that so loses more than ``most_lost`` percent of its characters is rejected, as is one that
fails the base rules (fewer than 20 words, or more than 30 percent of its words in repeated windows).

Edge cases: a null or empty text has no words, fails the base rules and is not kept, its clean text is
empty; a null doc_id stays null; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Phrases of lines that aren't prose, as one pattern over the lower-cased line.
BOILERPLATE = r"all rights reserved|licensed under|released under the|under the terms of|terms of (use|service)|privacy policy|cookie policy|use of cookies|accept cookies|enable javascript|javascript is disabled|copyright \(c\)|powered by|creative commons|general public license"
NAVIGATION = r"^\s*(home|next|previous|menu|login|log in|sign in|sign up|search|share|tweet|read more|click here|back to top|skip to content|contact us|about us|subscribe|site map|sitemap)\W*$|[»›]\s*\S+\s*[»›]"
SYMBOLS = "#*$%&|<>"
LINE_END = r"""[.!?:;…"'”’»)\]]\s*$"""
#: More than half of 20 letters or more: few lines have so many capitals, so few have their letters counted.
CAPITALS = r"^(?:[^A-Z]*+[A-Z]){11}"
WORD = r"[^\x20\x09-\x0D]"


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """How many words lie in a window of ``width`` words that the array holds twice or more."""
    hashes = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def starts(z: Column) -> Column:
            same = lambda v, j: F.coalesce(F.get(z, j)["h"] == v["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(z, lambda v, i: same(v, i - 1) | same(v, i + 1)), lambda v: v["p"]))

        def total(p: Column) -> Column:
            begin = F.struct(F.lit(0).alias("c"), F.lit(-width).alias("at"))
            return F.aggregate(p, begin, lambda a, x: F.struct((a["c"] + F.least(F.lit(width), x - a["at"])).alias("c"), x.alias("at")), lambda a: a["c"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, starts), total))

    return let(hashes, covered)


def bad_line(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    letters, capitals = F.length(F.regexp_replace(line, "[^A-Za-z]", "")), F.length(F.regexp_replace(line, "[^A-Z]", ""))
    return (
        ~line.rlike(LINE_END)
        | (symbol_count(line) * 25 > F.length(line))
        | (F.length(line) - F.length(F.translate(line, "|", "")) >= 3)
        | (line.rlike(CAPITALS) & (capitals * 2 > letters) & (letters >= 20))
        | F.lower(line).rlike(NAVIGATION)
        | F.lower(line).rlike(BOILERPLATE)
    )


def quality_rules(docs: DataFrame, most_lost: int = 50, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, line_chars, clean_text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), words_of(F.col("text")).alias("w"), lines.alias("lines"))
    rows = rows.withColumn("good", F.filter("lines", lambda x: ~bad_line(x)))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        symbol_count(F.col("t")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).cast("long").alias("n_repeat_words"),
        chars("lines").cast("long").alias("line_chars"),
        (chars("lines") - chars("good")).cast("long").alias("lost_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * most_lost)
    return rows.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "line_chars", "clean_text")


_SQL_BOIL = BOILERPLATE.replace("'", "''")
_SQL_NAV = NAVIGATION.replace("'", "''")
_SQL_END = LINE_END.replace("'", "''")

#: The same columns, but for the clean text, in DuckDB's SQL.
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM d),
g AS (SELECT *, list_filter(ln, lambda x: regexp_matches(x, '{_SQL_END}')
    AND NOT (length(x) - length(translate(x, '{SYMBOLS}', ''))) * 25 > length(x)
    AND NOT length(x) - length(replace(x, '|', '')) >= 3
    AND NOT (length(regexp_replace(x, '[^A-Z]', '', 'g')) * 2 > length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 20)
    AND NOT regexp_matches(lower(x), '{_SQL_NAV}') AND NOT regexp_matches(lower(x), '{_SQL_BOIL}')) AS good,
    CASE WHEN len(w) < 8 THEN [] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END AS win FROM w),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, unnest(win) AS x, generate_subscripts(win, 1) AS i FROM g)) WHERE c > 1)) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(ln, lambda x: length(x))), 0)::BIGINT AS line_chars, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0)::BIGINT AS good_chars FROM g LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (line_chars - good_chars) * 100 <= line_chars * 50 AS kept, (line_chars - good_chars)::BIGINT AS lost_chars, line_chars FROM b
"""
