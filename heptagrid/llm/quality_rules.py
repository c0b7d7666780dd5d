"""Quality rules: a table of thresholds on counts of a text, compiled into Spark projections of built-in functions.

A word is a run of characters other than blanks and the control characters 9 to 13. Ratios are compared by products of
whole numbers, so SQL elsewhere gives the same verdicts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Common short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on with as was at by be this are from or not have an "
    "de la le les et des en un une est pour dans du qui que pas sur au par "
    "der die und das ist nicht zu den mit von dem ein eine auf sich als auch im "
    "el los y las se del por con una es al su para lo"
).split()


class Rule(NamedTuple):
    """Holds where ``100 * count`` is at least ``low`` and at most ``high`` times ``of``."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None


BASE_RULES = (
    Rule("words", "n_words", "one", 5000, None),
    Rule("repeated windows", "n_repeat_words", "n_words", None, 50),
)
RULES = (
    Rule("word length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop words", "n_stop_words", "n_words", 5, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut lines", "n_cut_lines", "n_lines", None, 30),
)
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines",
)


def _holds(rule: Rule) -> Column:
    count = 100 * F.col(rule.count)
    of = F.lit(1) if rule.of == "one" else F.col(rule.of)
    bounds = [count >= rule.low * of] if rule.low is not None else []
    bounds += [count <= rule.high * of] if rule.high is not None else []
    return reduce(Column.__and__, bounds)


def _all(rules: tuple[Rule, ...]) -> Column:
    return reduce(Column.__and__, map(_holds, rules), F.lit(True))


def _n(c: Column) -> Column:
    return F.length(c).cast("long")


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def _once(c: Column) -> Column:
    """Keeps a filter above from being pushed below, where a lambda would compute the column anew for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def counts(rows: DataFrame) -> DataFrame:
    """From columns id and text: id, then COUNTS. What a lambda reads is a column of the step before, computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = rows.select(
        "id",
        text.alias("text"),
        _once(F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    word = lambda i: F.get("words", i)
    windows = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, word(i + 1), word(i + 2)).alias("h"), i.alias("i")))
    start = lambda x: F.substring(F.btrim(x, F.lit(BLANKS)), 1, 1)
    sized = words.select(
        "id",
        _size(F.col("words")).alias("n_words"),
        _n(F.translate("text", BLANKS, "")).alias("word_chars"),
        (_n(F.col("text")) - _n(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        _size(F.col("lines")).alias("n_lines"),
        _size(F.filter("lines", lambda x: start(x).isin("*", "-", "•"))).alias("n_bullet_lines"),
        _size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_cut_lines"),
        _once(F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))))).alias("windows"),
    )
    h = lambda k: F.get("windows", k)["h"]
    twin = lambda x, k: x["h"].eqNullSafe(h(k - 1)) | x["h"].eqNullSafe(h(k + 1))
    found = sized.select(
        "*",
        _once(F.sort_array(F.transform(F.filter("windows", twin), lambda x: x["i"]))).alias("twins"),
    )
    # windows that overlap share words: each adds as many as it is ahead of the next, three at most
    step = lambda p, k: F.least(F.lit(3), F.coalesce(F.get("twins", k + 1) - p, F.lit(3)))
    steps = found.select("*", _once(F.transform("twins", step)).alias("steps"))
    repeated = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x)
    return steps.select("id", *[repeated.alias(c) if c == "n_repeat_words" else F.col(c) for c in COUNTS])


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, COUNTS, base_failed, kept (false where the base rules fail, else whether all ``rules`` hold).

    A null text counts as empty: no words, so the base rules fail. Repeated rows and null ids are kept; an empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = _all(BASE_RULES)
    return counts(rows).select(F.col("id").alias(id_col), *COUNTS, (~base).alias("base_failed"), (base & _all(rules)).alias("kept"))


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; the whole row rides along, so nothing is joined."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("id"), F.col(f"`{text_col}`").alias("text"))
    return counts(rows).where(_all(BASE_RULES) & _all(rules)).select("id.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        of = "1" if r.of == "one" else r.of
        parts += [f"100 * {r.count} >= {r.low} * {of}"] if r.low is not None else []
        parts += [f"100 * {r.count} <= {r.high} * {of}"] if r.high is not None else []
    return " AND ".join(parts)


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT t.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[*•-]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…) *$'))) AS n_cut_lines
  FROM t LEFT JOIN r ON t.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({_sql(BASE_RULES)}) AS base_failed, ({_sql(BASE_RULES)} AND {_sql(RULES)}) AS kept
FROM c
"""
