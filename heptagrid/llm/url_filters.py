"""URL filters: rules, and for the rest a tree of path templates per host.

A url's path is cut at its slashes. From the root of a host's tree on, level by level to the end of every path, the segments
below a template are its branches. A segment that looks variable (with a digit in it), or that few urls of a template with many
branches share, becomes a wildcard. Branches of one template whose labelled shares of blocked urls don't differ by more than
chance allows are merged.

What becomes of the paths below a template depends on them alone. So a template with no more than SUBTREE of them is worked out
to the leaves in one task; larger ones go one level on by aggregations, until they have come apart.

Labels are the verdicts of the rules. A template's share of blocked urls is smoothed toward that of the same template over
all hosts, and that toward the share of all labelled urls; a template is rejected where it reaches the threshold. A
template no host of which has labels is not rejected.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, staged, table

#: Paths below a template that one task works out.
SUBTREE = 4096
#: A branch is kept apart if so many urls have it, or if its template has so few branches.
SUPPORT = 20
BRANCHES = 8
#: Branches differ if their shares are over so many standard errors apart from the rest of their template's.
ERRORS = 3.0
#: Weight of what a share is smoothed toward, in urls; and the share that rejects a template.
WEIGHT = 10.0
PURITY = 0.8
#: What stands for a variable segment and for merged ones; and for the end of a path, as no segment can be that.
WILD, MERGED, END = "*", "+", "/"
#: The rules of the query: host with its path, and verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parts(NamedTuple):
    host: Column
    path: Column


def parts_of(url: Column) -> Parts:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. Null, or without ``://``: both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return Parts(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. Of rules as long, the first in order of the alphabet."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        at = rule.index("/")
        fits = (host == rule[:at]) | host.endswith("." + rule[:at])
        found = F.when(fits & path.startswith(rule[at:]), F.lit(rule)).otherwise(found)
    return found


def _verdict(rule: Column, rules: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, verdict in rules.items():
        found = F.when(rule == name, F.lit(verdict)).otherwise(found)
    return found


def _name(segment: str, n: int, labelled: int, blocked: int, branches: int, all_labelled: int, all_blocked: int) -> str:
    """A branch's name, from its urls and those of its template."""
    if segment == END:
        return END
    if n < SUPPORT and branches > BRANCHES:
        return WILD
    rest_labelled, rest_blocked = all_labelled - labelled, all_blocked - blocked
    if branches > 1 and labelled > 0 and rest_labelled > 0:
        share = all_blocked / all_labelled
        error = math.sqrt(share * (1 - share) * (1 / labelled + 1 / rest_labelled))
        if abs(blocked / labelled - rest_blocked / rest_labelled) <= ERRORS * error:
            return MERGED
    return segment


def subtree(template: str, level: int, segments: list[list[str]], counts: list[tuple[int, int, int]]) -> list[str]:
    """The template of each path below one; counts: n, labelled, blocked of each."""
    out, nodes = [template] * len(segments), [(template, range(len(segments)))]
    while nodes:
        below = []
        for name, rows in nodes:
            branch = defaultdict(lambda: [0, 0, 0, []])
            for k in rows:
                found = branch[segments[k][level] if level < len(segments[k]) else END]
                for i, x in enumerate(counts[k]):
                    found[i] += x
                found[3].append(k)
            whole = len(branch), sum(x[1] for x in branch.values()), sum(x[2] for x in branch.values())
            merged = defaultdict(list)
            for segment, (n, labelled, blocked, members) in branch.items():
                merged[_name(segment, n, labelled, blocked, *whole)] += members
            for step, members in merged.items():
                if step != END:
                    for k in members:
                        out[k] = f"{name}/{step}"
                    below.append((f"{name}/{step}", members))
        nodes, level = below, level + 1
    return out


def _subtrees(rows: DataFrame, level: int) -> DataFrame:
    """The templates of all paths, each node's in one task."""
    columns = ("host", "template", "path", "n", "labelled", "blocked", "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list):
            found = subtree(held[0][1], level, [r[6] for r in held], [r[3:6] for r in held])
            values = [[r[k] for r in held] for k in (0, 2, 3, 4, 5)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(v, kind) for v, kind in zip([*values, found], kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["host", "path", "n", "labelled", "blocked", "template"])

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    met = rows.select(*columns).repartition("host", "template").sortWithinPartitions("host", "template")
    return met.mapInArrow(run, "host string, path string, n bigint, labelled bigint, blocked bigint, template string")


def _level(rows: DataFrame, level: int) -> DataFrame:
    """Rows, their templates one level on; a path that ends gets no further, and ended. By aggregations that combine on the
    map side, and joins in which a branch or template of very many rows is dealt to many tasks."""
    keys = ["host", "template"]
    rows = rows.withColumn("segment", F.coalesce(F.get("segments", F.lit(level)), F.lit(END)))
    sums = [F.sum(c).alias(f"b_{c}") for c in ("n", "labelled", "blocked")]
    branch = staged(rows.groupBy(*keys, "segment").agg(F.count("*").alias("rows"), *sums), "branch")
    whole = branch.groupBy(*keys).agg(F.count("*").alias("branches"), F.sum("b_labelled").alias("all_labelled"), F.sum("b_blocked").alias("all_blocked"))
    of = salted_join(branch, whole, keys, hot_keys(whole.select(*keys, F.col("branches").alias("n"))), ["segment"])
    small = (F.col("b_n") < SUPPORT) & (F.col("branches") > BRANCHES)
    rest_labelled, rest_blocked = F.col("all_labelled") - F.col("b_labelled"), F.col("all_blocked") - F.col("b_blocked")
    share = F.col("all_blocked") / F.col("all_labelled")
    error = F.sqrt(share * (1 - share) * (1 / F.col("b_labelled") + 1 / rest_labelled))
    alike = F.abs(F.col("b_blocked") / F.col("b_labelled") - rest_blocked / rest_labelled) <= ERRORS * error
    known = (F.col("branches") > 1) & (F.col("b_labelled") > 0) & (rest_labelled > 0)
    name = F.when(F.col("segment") == END, F.lit(END)).when(small, F.lit(WILD))
    name = name.when(F.when(known, alike).otherwise(F.lit(False)), F.lit(MERGED)).otherwise(F.col("segment"))
    named = of.select(*keys, "segment", name.alias("name"))
    hot = hot_keys(branch.select(*keys, "segment", F.col("rows").alias("n")))
    rows = salted_join(rows, named, [*keys, "segment"], hot, ["path"])
    ended = F.col("name") == END
    template = F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
    return rows.withColumns({"template": template, "ended": ended}).drop("segment", "name")


def templates(urls: DataFrame) -> DataFrame:
    """urls: host, path, n, labelled, blocked, a row per host and path. Adds template."""
    shaped = lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9]+", WILD), "^[^.*]*[*][^.]*", WILD)
    cut = F.split(F.col("path"), "/")  # the piece before the first slash is always empty
    segments = F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.when(x.rlike("[0-9]"), shaped(x)).otherwise(x))
    columns = ("host", "path", "n", "labelled", "blocked", "template")
    rows, done, level = staged(urls.withColumns({"segments": segments, "template": F.lit("")}), "urls"), [], 0
    while True:
        sizes = rows.groupBy("host", "template").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > SUBTREE).select("host", "template", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        tagged = staged(salted_join(rows, large, ["host", "template"], hot_keys(sizes), ["path"], "left"), "sizes")
        done.append(staged(_subtrees(tagged.where("large IS NULL"), level), "subtrees"))
        rows = staged(_level(tagged.where("large").drop("large"), level), "level")
        done.append(rows.where("ended").select(*columns))
        rows, level = rows.where("NOT ended").drop("ended"), level + 1
    found = staged(_subtrees(rows, level), "subtrees").select(*columns)
    for part in done:
        found = found.union(part.select(*columns))
    return found


def url_verdicts(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: its id, host, path, rule, verdict (the rule's, else the method's: allow or block), template, purity.

    A null url, or one without ``://``, has an empty host and path and is judged like any other of them. Repeated rows and
    null ids are kept; an empty table gives an empty result; without a url that a rule fits nothing is rejected. Other
    columns, whatever their names, are not read.
    """
    parts = parts_of(F.col("url"))
    rows = pages.select(F.col(id_col), F.col(url_col)).toDF("id", "url").select("id", parts.host.alias("host"), parts.path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = _verdict(F.col("rule"), rules)
    urls = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("rule").alias("labelled"), F.coalesce(F.count_if(given == "block"), F.lit(0)).alias("blocked")
    )
    found = templates(urls)
    total = found.agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")).first()
    prior = total["all_blocked"] / total["all_labelled"] if total["all_labelled"] else 0.0

    def smoothed(blocked: str, labelled: str, toward: Column) -> Column:
        return (F.col(blocked) + WEIGHT * toward) / (F.col(labelled) + WEIGHT)

    by_host = found.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    by_template = by_host.groupBy("template").agg(F.sum("labelled").alias("every_labelled"), F.sum("blocked").alias("every_blocked"))
    count = F.count("*").alias("n")
    of_all = salted_join(by_host, by_template, ["template"], hot_keys(by_host.groupBy("template").agg(count)), ["host"])
    judged = of_all.select(
        "host", "template", F.when(F.col("every_labelled") > 0, smoothed("blocked", "labelled", smoothed("every_blocked", "every_labelled", F.lit(prior)))).otherwise(F.lit(0.0)).alias("purity"),
    )
    hosts = hot_keys(found.groupBy("host", "template").agg(count))
    judged = salted_join(found.select("host", "path", "template"), judged, ["host", "template"], hosts, ["path"])
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return salted_join(rows, judged, ["host", "path"], hot_keys(found.select("host", "path", "n")), ["id"]).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(given, method).alias("verdict"), "template", "purity"
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    return url_verdicts(table(spark, sf_dir, "pages"))
