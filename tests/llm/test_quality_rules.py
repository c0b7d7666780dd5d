"""The rules against DuckDB and against plain Python."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from heptagrid.llm import quality_rules as q
from heptagrid.llm.common import table

ODD = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "a b c a b c a b c"), (4, "a b c a b c a b c"), (None, "x\ny\nx\n \n \nx "), (5, "the of " * 30000), (6, "##** a&b é b"), (7, "one"), (8, "a a a")]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_and_odd_rows(spark, sf):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("id", "words", "kept", "windows")})
    got = q.quality_rules(docs).collect()
    assert sorted((str(r[0]), *r[1:6], r.base_failed) for r in got) == sorted((str(d), *plain(t)) for d, t in ODD)
    assert not any(r.kept for r in got if r.base_failed)
    assert q.quality_rules(docs.limit(0)).count() == 0
    assert q.keep_quality(docs).columns == docs.columns and q.keep_quality(docs).count() == 0
    for r in table(spark, sf, "documents").join(q.op7_quality_rules(spark, sf), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(q.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, q.op7_quality_rules(spark, sf).collect())) == sorted(want)


def test_verdicts_follow_labels(spark, sf):
    kept = table(spark, sf, "labels").join(q.op7_quality_rules(spark, sf), "doc_id").where(~F.col("base_failed"))
    good, bad = (kept.where(F.col("quality") == v) for v in (1, 0))
    assert good.where("kept").count() == good.count()
    assert bad.where("kept").count() <= 0.05 * bad.count() + 1


def test_no_user_functions(spark, sf):
    assert "Python" not in q.op7_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
