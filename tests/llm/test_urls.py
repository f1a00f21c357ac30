"""URL parsing, rules and the template tree against plain Python and hand-made hosts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import urls
from ledgerspark.llm.queries import RULES

SCHEMA = "page_id long, url string, host string, verdict int"


def plain(url):
    """The contract's host, path and rule."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = (None, None)
    for verdict, rule in RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


def test_contract_columns(spark):
    odd = [None, "", "nohost/path", "http://", "HTTP://A.Example.NET/en/x?q#f", "x://y://z/fr/", "http://exampleXnet/en/", "http://É.Org/fr/É", "http://a.net?x=/", "http://net/", "//a.net/", "http://example.com/de/\nx/", "http://a.b/" + "s/" * 5000]
    docs = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(i, u, "z", 0) for i, u in enumerate(odd + odd[:3] + [r.url for r in docs.collect()])]
    got = sorted(urls.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect())
    assert len(got) == len(rows)
    for r, (_, url, *_) in zip(got, rows, strict=True):
        host, path, rule, verdict = plain(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_templates_follow_the_labels(spark):
    """A branch that is bad by its labels is rejected under new names and on a host without labels; its good siblings are not."""
    rows = [(i, f"http://h.com/ads/{i}/x{i}", "bad", 0) for i in range(30)]
    rows += [(100 + i, f"http://h.com/blog/{i}", "good", 0) for i in range(30)] + [(200 + i, f"http://h.com/news/{i}", "good", 0) for i in range(30)]
    rows += [(300, "http://h.com/ads/999/new", None, 0), (301, "http://h.com/blog/77777", None, 0), (302, "http://h.com/other/1", None, 0), (303, "http://fresh.com/ads/1/y", None, 0), (304, "http://fresh.com/blog/1", None, 0)]

    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, k int"), [], bad=F.col("host") == "bad").collect()}
    assert got[300].verdict == "block" and got[300].template.startswith("/ads/<n>")
    assert [got[i].verdict for i in (301, 302, 303, 304)] == ["allow", "allow", "block", "allow"]
    assert got[301].template == got[205].template == "/<good>/<n>"  # alike branches have merged
    assert all(got[i].verdict == "block" for i in range(30)) and all(got[i].verdict == "allow" for i in range(100, 130))


def test_verdicts_do_not_depend_on_the_number_of_siblings(spark):
    """Of hosts with 200 and 201 first segments, one bad by rule, clean pages are allowed and the bad branch stays literal."""
    rows = []
    for host, kids in (("a.example.com", 200), ("b.example.com", 201)):
        rows += [(f"http://{host}/de/{i}", 0) for i in range(12)] + [(f"http://{host}/s{'x' * i}/{i}", 1) for i in range(kids - 1)]
    rows += [(f"http://quiet{i}.org/fr/{i}", 2) for i in range(40)]  # a low share of bad labels overall
    got = urls.judge(spark.createDataFrame([(i, u, "", v) for i, (u, v) in enumerate(rows)], SCHEMA), RULES).collect()
    assert {r.verdict for r in got if r.path.startswith("/s")} == {"allow"}
    assert {r.template for r in got if r.path.startswith("/de/")} == {"/de/<n>"}


def plain_templates(counts):
    """The template of each shape of one scope: counts is {shape: (good, bad)}."""
    out = {}

    def grow(rows, template):  # rows: (shape, rest, good, bad)
        rests = {r[1] for r in rows}
        if len(rests) == 1 or not sum(g + b for _, _, g, b in rows):
            for shape, rest, _, _ in rows:
                out[shape] = "/".join([*template, *(rest if len(rests) == 1 else ["**"])])
            return
        n = 0
        while len({r[n] for r in rests}) == 1:
            template, n = [*template, next(iter(rests))[n]], n + 1
        kids = {}
        for shape, rest, g, b in rows:
            kids.setdefault(rest[n], []).append((shape, rest[n + 1 :], g, b))
        pg, pb = sum(r[2] for r in rows), sum(r[3] for r in rows)
        merged = {}
        for segment, own in kids.items():
            g, b = sum(r[2] for r in own), sum(r[3] for r in own)
            to = "*"
            if g + b and pg + pb - g - b:
                share = (pb + 0.5) / (pg + pb + 1)
                gap = b / (g + b) - (pb - b) / (pg + pb - g - b)
                if abs(gap) > urls.CRITICAL * (share * (1 - share) * (1 / (g + b) + 1 / (pg + pb - g - b))) ** 0.5:
                    to = segment if gap > 0 else "<good>"
            elif g + b >= urls.EVIDENCE:
                to = segment
            merged.setdefault(to, []).extend(own)
        for to, own in merged.items():
            for r in [r for r in own if not r[1]]:
                out[r[0]] = "/".join([*template, to])
            if left := [r for r in own if r[1]]:
                grow(left, [*template, to])

    grow([(s, s, g, b) for s, (g, b) in counts.items()], [""])
    return out


def plain_judged(counts, reject=0.8):
    """{(host, shape): (template, purity, rejected)} from {(host, shape): (good, bad)}."""
    scopes = lambda h: [h, "*." + ".".join(h.split(".")[-2:]), "*"]
    by_scope = {}
    for (host, shape), (g, b) in counts.items():
        for scope in set(scopes(host)):
            own = by_scope.setdefault(scope, {})
            own[shape] = tuple(map(sum, zip(own.get(shape, (0, 0)), (g, b), strict=True)))
    template, sums = {}, {}
    for scope, own in by_scope.items():
        for shape, t in plain_templates(own).items():
            template[scope, shape] = t
            g, b = sums.get((scope, t), (0, 0))
            sums[scope, t] = g + own[shape][0], b + own[shape][1]
    good, bad = sum(g for g, _ in counts.values()), sum(b for _, b in counts.values())
    out = {}
    for host, shape in counts:
        purity, labels = (bad + 0.5) / (good + bad + 1), 0
        for scope in reversed(scopes(host)):
            g, b = sums[scope, template[scope, shape]]
            purity, labels = (b + urls.WEIGHT * purity) / (g + b + urls.WEIGHT), max(labels, g + b)
        out[host, shape] = template[host, shape], round(purity, 9), purity >= reject and labels >= urls.EVIDENCE
    return out


def check_tree(spark, counts):
    rows = [(h, list(s), g, b) for (h, s), (g, b) in counts.items()]
    got = urls.judged_shapes(spark.createDataFrame(rows, "host string, shape array<string>, good long, bad long")).collect()
    found = {(r.host, tuple(r["shape"])): (r.template, round(r.purity, 9), r.rejected) for r in got}
    strip = lambda t: t.removesuffix("/" + urls.END)
    assert found == {k: (strip(t), p, r) for k, (t, p, r) in plain_judged(counts).items()}
    return found


@pytest.mark.parametrize("chars", [0, 300, urls.NODE_CHARS])
def test_tree_against_plain_python(spark, monkeypatch, chars):
    """In rounds only, in rounds until nodes are small, and in one pass."""
    monkeypatch.setattr(urls, "NODE_CHARS", chars)
    rng = random.Random(4)
    counts = {}
    for _ in range(300):
        host = rng.choice(["a.b.com", "c.b.com", "x.org", "", "solo"])
        shape = (*(rng.choice(["ads", "news", "<n>", "p", ""]) for _ in range(rng.randint(1, 5))), urls.END)
        bad = rng.random() < (0.9 if "ads" in shape[:2] else 0.1)
        counts[host, shape] = rng.choice([(0, 0), (0, 4), (1, 1)] if bad else [(0, 0), (5, 0), (1, 1)])
    found = check_tree(spark, counts)
    assert {r for _, _, r in found.values()} == {True, False}


def test_deep_and_wide_trees(spark):
    """A branch in the twelfth segment counts, and 1,000 siblings do not change what is bad."""
    deep = tuple("abcdefghijk")
    counts = {("h.com", (*deep, "bad", "<n>", urls.END)): (0, 9), ("h.com", (*deep, "fine", "<n>", urls.END)): (9, 0)}
    counts |= {("w.org", ("bad", f"k{i}", urls.END)): (0, 1) for i in range(10)}
    counts |= {("w.org", (f"s{i}", "<n>", urls.END)): (i % 2, 0) for i in range(1_000)}
    found = check_tree(spark, counts)
    assert found["h.com", (*deep, "bad", "<n>", urls.END)][2] and not found["h.com", (*deep, "fine", "<n>", urls.END)][2]
    assert all(found["w.org", ("bad", f"k{i}", urls.END)][2] for i in range(10))
    assert not any(found["w.org", (f"s{i}", "<n>", urls.END)][2] for i in range(1_000))


def test_a_chain_of_nested_paths(spark):
    """1,500 paths, each one segment longer than the one before, and a segment that looks like the mark of the end."""
    counts = {("h.com", (*(["s"] * n), urls.END)): (n % 2, n % 3 == 0) for n in range(1, 1_501)}
    counts |= {("x.org", ("a", "<end>", urls.END)): (3, 0), ("x.org", ("a", "<end>", "b", urls.END)): (0, 3), ("x.org", ("", urls.END)): (1, 0)}
    rows = [(h, list(s), int(g), int(b)) for (h, s), (g, b) in counts.items()]
    began = time.monotonic()
    got = urls.judged_shapes(spark.createDataFrame(rows, "host string, shape array<string>, good long, bad long")).collect()
    assert len(got) == len(rows) and time.monotonic() - began < 60


def test_tree_of_a_table(spark):
    """The whole query's verdicts, with the labels its rules give."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urls.judge(pages, RULES).collect()
    counts, shapes = {}, {}
    for r in pages.select("page_id", "url", urls.shape(urls.host_and_path(F.col("url"))[1]).alias("shape")).collect():
        host, _, _, verdict = plain(r.url)
        at = shapes[r.page_id] = host, tuple(r["shape"])
        g, b = counts.get(at, (0, 0))
        counts[at] = g + (verdict == "allow"), b + (verdict == "block")
    want = plain_judged(counts)
    for r in got:
        assert r.verdict == (plain(r.path and f"x://{r.host}{r.path}")[3] or ("block" if want[shapes[r.page_id]][2] else "allow"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0
