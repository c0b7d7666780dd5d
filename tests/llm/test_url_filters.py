"""Hosts, paths and rules against plain Python, and templates by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heptagrid.llm import url_filters as u
from heptagrid.llm.common import table


def plain(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule in sorted(u.RULES):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


ODD = [
    None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "a://b://c/d", "http://com", "http://com/", "http://notcom/en/", "http://x.net/es/1",
    "http://x.net/es", "http://net/fr/#", "https://É.com/É", "http://example.com#/en/", "http://deep.org/" + "a/" * 3000, "http://sub.www.example.com/en/x",
]


def check(got, rows):
    assert sorted((str(r.page_id), r.host, r.path, r.rule) for r in got) == sorted((str(i), *plain(x)) for i, x in rows)
    for r in got:
        assert r.verdict == (u.RULES[r.rule] if r.rule else "block" if r.purity >= u.PURITY else "allow")


def test_op3(spark, sf):
    rows = [(r.page_id, r.url) for r in table(spark, sf, "pages").collect()]
    got = u.op3_url_filters(spark, sf).collect()
    check(got, rows)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_odd_rows(spark):
    rows = [*enumerate(ODD), (0, ODD[4]), (0, ODD[4]), (None, ODD[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit(1) for n in ("id", "host", "path", "rule", "template", "n")})
    check(u.url_verdicts(pages).collect(), rows)
    assert u.url_verdicts(pages.limit(0)).count() == 0


def test_templates_by_hand(spark):
    urls = [(f"http://a.org/{lang}/{k}.html", 1) for lang in ("en", "de") for k in range(60)]
    urls += [(f"http://a.org/tag/t{chr(97 + k // 26)}{chr(97 + k % 26)}", 1) for k in range(100)]
    urls += [(f"http://bad.net/es/{k}", 1) for k in range(50)] + [(f"http://other.org/es/{k}", 1) for k in range(5)] + [("http://a.org", 1)]
    urls += [(f"http://good.com/es/{k}x", 1) for k in range(50)] + [(f"http://mixed.com/{x}/{k}", 1) for x in ("en", "fr") for k in range(40)]
    pages = spark.createDataFrame(urls, "url string, page_id long")
    got = u.url_verdicts(pages).select("host", "path", "template", "purity", "verdict", "rule").collect()
    by = lambda host: {r.template for r in got if r.host == host}
    assert by("a.org") == {"/en/*.html", "/de/*.html", "/tag/*", ""}
    assert by("bad.net") == {"/es/*"}
    assert by("mixed.com") == {"/+/*"}
    verdict = {r.host: r.verdict for r in got}
    assert verdict["bad.net"] == "block" and verdict["good.com"] == "allow" and verdict["a.org"] == "allow"
    purity = {r.host: r.purity for r in got}
    assert purity["bad.net"] > u.PURITY > purity["other.org"] > purity["good.com"]


def plain_verdicts(urls):
    """The whole method by a recursion over one host's paths at a time, written from its description."""
    of = {}
    for url in urls:
        host, path, rule = plain(url)
        at = of.setdefault(host, {}).setdefault(path, [0, 0, 0])
        at[0] += 1
        at[1] += rule is not None
        at[2] += bool(rule) and u.RULES[rule] == "block"
    template = {}

    def grow(host, name, level, paths):
        kids = {}
        for path in paths:
            parts = path.split("/")[1:]
            part = parts[level] if level < len(parts) else None
            if part is not None and re.search("[0-9]", part):
                part = re.sub("^[^.*]*[*][^.]*", "*", re.sub("[0-9]+", "*", part))
            kids.setdefault(part, []).append(path)
        total = lambda group, k: sum(of[host][p][k] for p in group)
        steps = {}
        for part, group in kids.items():
            if part is None:
                template.update({(host, p): name for p in group})
                continue
            step = part
            if total(group, 0) < u.SUPPORT and len(kids) > u.BRANCHES:
                step = "*"
            elif len(kids) > 1:
                own, rest = (total(group, 1), total(group, 2)), (total(paths, 1) - total(group, 1), total(paths, 2) - total(group, 2))
                if own[0] and rest[0]:
                    mean = total(paths, 2) / total(paths, 1)
                    if abs(own[1] / own[0] - rest[1] / rest[0]) <= u.ERRORS * math.sqrt(mean * (1 - mean) * (1 / own[0] + 1 / rest[0])):
                        step = "+"
            steps.setdefault(step, []).extend(group)
        for step, group in steps.items():
            grow(host, f"{name}/{step}", level + 1, group)

    for host, paths in of.items():
        grow(host, "", 0, list(paths))
    labelled, blocked = {}, {}
    for (host, path), t in template.items():
        for key in ((host, t), t, None):
            labelled[key] = labelled.get(key, 0) + of[host][path][1]
            blocked[key] = blocked.get(key, 0) + of[host][path][2]
    prior = blocked[None] / labelled[None] if labelled.get(None) else 0.0
    found = []
    for url in urls:
        host, path, rule = plain(url)
        t = template[host, path]
        every = (blocked[t] + u.WEIGHT * prior) / (labelled[t] + u.WEIGHT)
        purity = (blocked[host, t] + u.WEIGHT * every) / (labelled[host, t] + u.WEIGHT) if labelled[t] else 0.0
        found.append((host, path, rule, u.RULES[rule] if rule else "block" if purity >= u.PURITY else "allow", t, round(purity, 12)))
    return found


def of_method(spark, urls):
    pages = spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string")
    rows = sorted(u.url_verdicts(pages).collect(), key=lambda r: r.page_id)
    return [(r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 12)) for r in rows]


@pytest.mark.parametrize("subtree", [4096, 12])
def test_whole_method_against_plain_recursion(spark, sf, monkeypatch, subtree):
    monkeypatch.setattr(u, "SUBTREE", subtree)
    rng = random.Random(4)
    urls = [r.url for r in table(spark, sf, "pages").collect()] if subtree > 12 else []
    for _ in range(600):
        host = rng.choice(("a.net", "b.net", "c.com", "d.org", "example.com", "e.org"))
        depth = rng.choice((0, 1, 2, 3, 5, 9))
        words = ["es", "fr", "en"], ["tag", "p", "$", "*"], ["x%d" % rng.randrange(50), "y"], ["".join(rng.choices("abcdef", k=2))]
        urls.append(f"http://{host}/" + "/".join(rng.choice(words[min(k, 3)]) for k in range(depth)))
    urls += ["http://deep.org/" + "/".join("s" * (1 + (k == at)) for k in range(9)) for at in range(9) for _ in range(30)] + [x for x in ODD if not x or len(x) < 1000]
    assert of_method(spark, urls) == plain_verdicts(urls)


def test_no_level_is_the_last(spark):
    """Two branches of the twelfth level, of which the rules block one: they stay apart."""
    urls = [f"http://x.{top}/{lang}/" + "a/" * 10 + f"{leaf}/{k}" for top, lang, leaf in (("net", "es", "bad"), ("org", "es", "bad"), ("com", "es", "good")) for k in range(30)]
    found = {(r[0], r[4]) for r in of_method(spark, urls)}
    assert found == {("x.net", "/es/" + "a/" * 10 + "bad/*"), ("x.org", "/es/" + "a/" * 10 + "bad/*"), ("x.com", "/es/" + "a/" * 10 + "good/*")}
