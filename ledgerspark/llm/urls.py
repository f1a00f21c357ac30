"""URL filter: rules first, then path-template trees for each host, with evidence shared upwards.

Paths are cut into segments, and segments that are numbers, hexadecimal names or dates are replaced
by a class at once. What is left is counted for each host and shape, with the labels of the pages
behind it. A tree is grown on those counts for every host, for every registered domain (the last two
labels of a host) and for all pages together. Growing passes over the segments that all shapes of a
node have in common, then judges the children by their next segment: a child stays literal
if its share of bad labels is above its siblings' by a two-proportion test, or if it has labels and
its siblings have none; those below merge into one good branch, and all others, statistically alike
or without evidence, into a wildcard. A node without labels, or with one shape only, is a template
as it is. So a tree is as deep as its paths branch, and no segment is left out.

A template's share of bad labels is smoothed: the host's towards the domain's, that towards all
pages', that towards the share of bad labels at large, each with ``WEIGHT`` labels. A page is
rejected if the result reaches ``reject`` and its three templates hold ``EVIDENCE`` labels at least.
So a branch that is bad wherever it is labelled is rejected on hosts without labels of their own,
and a host's own good labels outweigh it.

Counts are combined before each shuffle. A node of at most ``NODE_CHARS`` characters of shapes is
grown to its leaves in one grouped pass, whatever its depth; larger ones grow a level a round by
DataFrame aggregation until their branches are small, so rounds follow how often more than that many
characters share a branch, not the depth of paths. The pages meet the finished trees once, in a join
that adaptive execution splits for a hot host.

Nulls: a null url, or one without ``://``, has an empty host and path and is judged like any other
template. Repeated rows each give a row. An empty table gives an empty result; without any label
the share of bad is taken as one half before smoothing, and nothing is rejected. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import forget, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The test's critical value; labels that count as evidence; weight of the smoothing; the mark that ends a shape, which no segment can be.
CRITICAL, EVIDENCE, WEIGHT, END = 1.96, 3, 2.0, "/<end>"
#: Characters of shapes up to which a node's tree is grown in one task.
NODE_CHARS = 1 << 24
#: The trees that a host's pages belong to, from its own to that of all pages.
SCOPES = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits. ``rules``: (verdict, ``host/path``), a short list."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, tail = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, said).otherwise(verdict)
    return found, verdict


def segment_class(segment: Column) -> Column:
    """The class of a segment that varies by its nature, else the segment itself."""
    return (
        F.when(segment.rlike("^[0-9]+$"), "<n>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("<n>."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
        .when(segment.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<hex>")
        .otherwise(segment)
    )


def shape(path: Column) -> Column:
    """All segments by class, and the end mark: an array of strings."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.concat(F.transform(parts, segment_class), F.array(F.lit(END)))


def scopes(host: Column) -> Column:
    """The keys of a host's trees: itself, its registered domain, all."""
    return F.array(host, F.concat(F.lit("*."), F.substring_index(host, ".", -2)), F.lit("*"))


def grown(template: str, segments: np.ndarray, names: list[str], starts: np.ndarray, ends: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[str]:
    """The template of each shape below a node: ``segments`` index ``names``, a shape's are those from its start to its end."""
    out = [""] * len(starts)
    open_ = [(np.arange(len(starts)), 0, template)]  # shapes, segments used up, template so far
    while open_:
        rows, at, template = open_.pop()
        first, n = rows[0], ends[rows] - starts[rows]
        if not (good[rows].sum() + bad[rows].sum()):
            alike = (n == n[0]).all() and all((segments[starts[rows] + k] == segments[starts[first] + k]).all() for k in range(at, n[0]))
            onward = [names[s] for s in segments[starts[first] + at : ends[first]]] if alike else ["**"]
            for r in rows:
                out[r] = "/".join([template, *onward])
            continue
        while at < n.min() and (segments[starts[rows] + at] == segments[starts[first] + at]).all():
            template, at = f"{template}/{names[segments[starts[first] + at]]}", at + 1
        if at == n.min():  # only where all are alike: a shape ends with a mark of its own
            for r in rows:
                out[r] = template
            continue
        kinds, own = np.unique(segments[starts[rows] + at], return_inverse=True)
        g, b = np.bincount(own, good[rows]), np.bincount(own, bad[rows])
        pg, pb = g.sum(), b.sum()
        n_own, n_rest = g + b, pg + pb - g - b
        pooled = (pb + 0.5) / (pg + pb + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = b / n_own - (pb - b) / n_rest
            differs = np.abs(gap) > CRITICAL * np.sqrt(pooled * (1 - pooled) * (1 / n_own + 1 / n_rest))
        differs &= (n_own > 0) & (n_rest > 0)
        literal = (differs & (gap > 0)) | ((n_own >= EVIDENCE) & (n_rest == 0))
        to = np.array([names[k] if keep else "<good>" if apart else "*" for k, keep, apart in zip(kinds, literal, differs, strict=True)], object)
        merged, branch = np.unique(to, return_inverse=True)
        branch = branch[own]
        order = np.argsort(branch, kind="stable")
        for name, some in zip(merged, np.split(rows[order], np.cumsum(np.bincount(branch, minlength=len(merged)))[:-1]), strict=True):
            ended = ends[some] - starts[some] == at + 1
            for r in some[ended]:
                out[r] = f"{template}/{name}"
            if not ended.all():
                open_.append((some[~ended], at + 1, f"{template}/{name}"))
    return out


def small_trees(nodes: DataFrame) -> DataFrame:
    """``scope``, ``shape``, ``template``, ``good``, ``bad`` of all shapes of nodes that are small, each grown in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rest = table["rest"].chunk(0)
        coded = rest.flatten().dictionary_encode()
        ends = np.cumsum(rest.value_lengths().to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        good, bad = table["good"].to_numpy(), table["bad"].to_numpy()
        found = grown(table["template"][0].as_py(), coded.indices.to_numpy(), coded.dictionary.to_pylist(), starts, ends, good, bad)
        return table.select(["scope", "shape"]).append_column("template", pa.array(found, pa.string())).append_column("good", table["good"]).append_column("bad", table["bad"])

    return nodes.select("scope", "shape", "template", "good", "bad", "rest").groupBy("scope", "template").applyInArrow(run, "scope string, shape array<string>, template string, good long, bad long")


def template_tree(counts: DataFrame) -> DataFrame:
    """Stored: ``scope``, ``shape`` and its ``template`` for ``counts`` (scope, shape, good, bad), one row a shape."""
    growing = staged(counts.withColumn("rest", F.col("shape")).withColumn("template", F.lit("")), "url-tree")
    finished, parts = [], [growing]
    while not growing.isEmpty():
        chars = F.sum(F.length(F.array_join("rest", "/")))
        sized = growing.join(growing.groupBy("scope", "template").agg((chars <= NODE_CHARS).alias("small")), ["scope", "template"])
        sized = staged(sized, "url-sized")
        finished.append(staged(small_trees(sized.filter("small")), "url-small"))
        growing = sized.filter("NOT small").drop("small")
        parts += [sized, finished[-1]]
        if growing.isEmpty():
            break
        nodes = growing.groupBy("scope", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum(F.col("good") + F.col("bad")).alias("labels"))
        # the smallest and the largest shape of a node share just what all of them share
        shared = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        done = (F.col("lo") == F.col("hi")) | (F.col("labels") == 0)
        nodes = nodes.select("scope", "template", done.alias("done"), F.when(~done, shared).otherwise(0).alias("shared"), (F.col("lo") == F.col("hi")).alias("single"))
        tree = growing.join(nodes, ["scope", "template"])
        onward = F.when(F.col("done"), F.when(F.col("single"), F.array_join("rest", "/")).otherwise("**")).otherwise(F.array_join(F.slice("rest", F.lit(1), F.col("shared")), "/"))
        tree = tree.withColumn("template", F.concat_ws("/", "template", F.when(F.col("done") | (F.col("shared") > 0), onward)))
        tree = tree.withColumn("rest", F.expr("slice(rest, shared + 1, size(rest))")).withColumn("segment", F.get("rest", F.lit(0)))
        tree = staged(tree.drop("shared", "single"), "url-tree")
        parts.append(tree)
        finished.append(tree.filter("done").select("scope", "shape", "template", "good", "bad"))
        children = tree.filter("NOT done").groupBy("scope", "template", "segment").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        parents = children.groupBy("scope", "template").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb"))
        judged = children.join(parents, ["scope", "template"])
        n, rest = F.col("g") + F.col("b"), F.col("pg") + F.col("pb") - F.col("g") - F.col("b")
        pooled = (F.col("pb") + 0.5) / (F.col("pg") + F.col("pb") + 1)
        gap = F.try_divide("b", n) - F.try_divide(F.col("pb") - F.col("b"), rest)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
        differs = F.coalesce(F.abs(gap) > CRITICAL * error, F.lit(False))
        alone = (n >= EVIDENCE) & (rest == 0)
        to = F.when((differs & (gap > 0)) | alone, F.col("segment")).when(differs, "<good>").otherwise("*")
        judged = judged.select("scope", "template", "segment", to.alias("to"))
        onward = tree.filter("NOT done").join(judged, ["scope", "template", "segment"])
        onward = onward.withColumn("template", F.concat_ws("/", "template", "to")).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
        # a shape that ends here leaves nothing to grow on
        ended = F.size("rest") == 0
        onward = staged(onward.select("scope", "shape", "template", "good", "bad", "rest", ended.alias("ended")), "url-tree")
        finished.append(onward.filter("ended").select("scope", "shape", "template", "good", "bad"))
        parts.append(onward)
        growing = onward.filter("NOT ended").drop("ended")
    found = staged(reduce(DataFrame.unionByName, finished, growing.select("scope", "shape", "template", "good", "bad")), "url-templates")
    forget(*parts)
    return found


def judged_shapes(counts: DataFrame, reject: float = 0.8) -> DataFrame:
    """``host``, ``shape``, ``template`` (the host's own), ``purity``, ``rejected`` for ``counts`` (host, shape, good, bad), one row each."""
    counts = staged(counts, "url-counts")
    by_scope = counts.select(F.explode(F.array_distinct(scopes(F.col("host")))).alias("scope"), "shape", "good", "bad")
    tree = template_tree(by_scope.groupBy("scope", "shape").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    told = counts.agg(F.sum("good"), F.sum("bad")).first()
    good, bad = float(told[0] or 0), float(told[1] or 0)
    sums = tree.groupBy("scope", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    found = counts.select("host", "shape", F.posexplode(scopes(F.col("host"))).alias("at", "scope")).join(tree.select("scope", "shape", "template"), ["scope", "shape"]).join(sums, ["scope", "template"])
    found = found.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("at", "template", "g", "b"))).alias("t"))  # SCOPES entries
    purity = F.lit((bad + 0.5) / (good + bad + 1))
    for at in reversed(range(SCOPES)):
        t = F.col("t")[at]
        purity = (t["b"] + WEIGHT * purity) / (t["g"] + t["b"] + WEIGHT)
    labels = F.col("t")[SCOPES - 1]["g"] + F.col("t")[SCOPES - 1]["b"]  # all pages': at least as many as the host's and the domain's
    labels = F.greatest(labels, *(F.col("t")[i]["g"] + F.col("t")[i]["b"] for i in range(SCOPES - 1)))
    found = found.select("host", "shape", F.regexp_replace(F.col("t")[0]["template"], f"/{END}$", "").alias("template"), purity.alias("purity"), labels.alias("labels"))
    return found.withColumn("rejected", (F.col("purity") >= reject) & (F.col("labels") >= EVIDENCE))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url: str = "url",
    bad: Column | None = None,
    reject: float = 0.8,
) -> DataFrame:
    """One row for each page: id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity``.

    ``bad``: a boolean column that labels pages, null where unknown; by default the rules' verdicts
    are the labels, so that the method carries them over to the templates the rules don't name.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if bad is None else bad).alias("label"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", said).withColumn("shape", shape(F.col("path")))
    label = F.coalesce("label", F.col("said") == "block")
    counts = parsed.groupBy("host", "shape").agg(F.count_if(~label).alias("good"), F.count_if(label).alias("bad"))
    tree = staged(judged_shapes(counts, reject), "url-judged")
    verdict = F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow"))
    return parsed.join(tree, ["host", "shape"]).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
