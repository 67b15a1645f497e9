"""URL filtering by host rules and gradient-boosted trees over lexical features, in DataFrame functions only.

URLs that a rule decides are the labelled ones. Trees are grown level by level: Spark sums gradients by leaf,
feature and bin, the driver picks splits from that table, whose size depends on the model only, and the finished
model is one column expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, written

#: The rules that the registered query applies: (host, path start, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_suffix1", "f_suffix2", "f_suffix1_n", "f_suffix2_n", "f_folder", "f_folder_n"]
BINS = 16
#: Parts of the hosts, of which each is told the statistics of the others.
FOLDS = 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as `host` + `path`, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical_features(urls: DataFrame) -> DataFrame:
    """`urls` (url, host, path and others) with f_length to f_labels, the host's last one and two labels and the path's first folder."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "f_digits": F.regexp_count(url, F.lit("[0-9]")) / size,
            "f_entropy": entropy,
            "f_params": F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "suffix1": F.regexp_extract("host", r"[^.]*$", 0),
            "suffix2": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
            "folder": F.regexp_extract("path", "^/([^/]*)/", 1),
        }
    )


def _with_statistics(rows: DataFrame, labelled: DataFrame, prior: float, own: bool = False) -> DataFrame:
    """Adds the smoothed share of blocked urls, and the number of labelled ones, of each host suffix and of each first folder.

    With `own`, `rows` are the labelled ones, and each is told about the hosts of the other FOLDS only: what a row is told
    must not depend on its own label, and leaving out the row alone would give the label away by what is missing.
    """
    for k in ("suffix1", "suffix2", "folder"):
        parts = [F.struct(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("y"))), F.lit(0)).alias("y"), F.count_if(F.col("fold") == f).alias("n")) for f in range(FOLDS)]
        rows = rows.join(labelled.groupBy(k).agg(F.sum("y").alias("_y"), F.count("*").alias("_n"), F.array(*parts).alias("_in")), k, "left")
        less = lambda c: F.coalesce(F.col(f"_{c}") - (F.col("_in")[F.col("fold")][c] if own else 0), F.lit(0))
        rows = rows.withColumns({f"f_{k}": (less("y") + 10 * prior) / (less("n") + 10), f"f_{k}_n": F.log2(less("n") + 1.0)}).drop("_y", "_n", "_in")
    return rows


def _leaf(tree: dict, value) -> Column:
    if "value" in tree:
        return value(tree)
    return F.when(F.col(tree["feature"]) <= tree["cut"], _leaf(tree["left"], value)).otherwise(_leaf(tree["right"], value))


def fit_trees(labelled: DataFrame, trees: int = 8, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> tuple[float, list[dict]]:
    """(start, trees) of a logistic model of `y` over FEATURES; deterministic but for rounding in sums.

    Rows are first summed up by their binned features, so repeated urls cost nothing. Without labels, or with
    labels of one kind, there are no trees and the start says it all.
    """
    n, blocked = labelled.select(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    start = math.log((blocked + 0.5) / (n - blocked + 0.5)) if n else -1.0
    if not n or blocked in (0, n):
        return start, []
    cuts = labelled.select(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first().asDict()
    cuts = {f: sorted(set(v)) for f, v in cuts.items()}
    binned = {f: F.lit(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in v), F.lit(0))).alias(f) for f, v in cuts.items()}
    table = written(labelled.select("y", *binned.values()).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    table = table.withColumn("margin", F.lit(start))
    grown: list[dict] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("margin")))
        rows = table.withColumns({"g": F.col("y") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        root: dict = {"leaf": 0, "value": 0.0}
        leaves = [root]
        for level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(FEATURES)])).alias("c")
            found = rows.select(_leaf(root, lambda t: F.lit(t["leaf"])).alias("leaf"), "g", "h", cells).groupBy("leaf", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            split = []
            for leaf in leaves:
                best = (1e-6, 0, 0, None)
                for k in range(len(FEATURES)):
                    bins = sorted((r["b"], r["g"], r["h"]) for r in found if r["leaf"] == leaf["leaf"] and r["f"] == k)
                    g, h = sum(b[1] for b in bins), sum(b[2] for b in bins)
                    gl = hl = 0.0
                    for b, gb, hb in bins[:-1]:
                        gl, hl = gl + gb, hl + hb
                        gain = round(gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge), 9)
                        if gain > best[0]:
                            best = (gain, k, b, (gl / (hl + ridge), (g - gl) / (h - hl + ridge)))
                if best[3]:
                    _, k, b, values = best
                    for side, v in zip(("left", "right"), values, strict=True):
                        leaf[side] = {"leaf": 2 * leaf["leaf"] + 1 + (side == "right"), "value": rate * v}
                        split.append(leaf[side])
                    del leaf["value"]
                    leaf |= {"feature": FEATURES[k], "cut": b}
            leaves = split
            if not leaves:
                break
        if "value" in root:
            break
        table = table.withColumn("margin", F.col("margin") + _leaf(root, lambda t: F.lit(t["value"])))
        grown.append(root)

    def real(tree: dict) -> dict:  # from bins to the features' own values
        return tree if "value" in tree else {"feature": tree["feature"], "cut": cuts[tree["feature"]][tree["cut"]], "left": real(tree["left"]), "right": real(tree["right"])}

    return start, [real(t) for t in grown]


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", held_out: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): a verdict for each row of `pages`.

    The longest fitting rule decides; other urls are blocked where the trees' score is above 0. Null urls and those
    without `://` have empty parts, fit no rule and are scored like others; urls of any length are read whole. Rows may
    repeat; an empty table gives an empty result; other columns are not read. Hosts may be very uneven: statistics are
    pre-aggregated and joined back on plain keys, which adaptive execution can split. `held_out`: a fold of hosts (of
    FOLDS) from whose labels nothing is learnt, to measure the scores by.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = lexical_features(rows.withColumns({"rule": rule, "given": verdict})).drop("url").withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    rows = written(rows)
    learnt = F.col("given").isNotNull() if held_out is None else F.col("given").isNotNull() & (F.col("fold") != held_out)
    labelled = rows.where(learnt).withColumn("y", (F.col("given") == "block").cast("int"))
    prior = labelled.agg(F.avg("y")).first()[0] or 0.0
    start, trees = fit_trees(_with_statistics(labelled, labelled, prior, own=True))
    score = sum((_leaf(t, lambda x: F.lit(x["value"])) for t in trees), F.lit(start))
    scored = _with_statistics(rows, labelled, prior).withColumn("score", score)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")


def held_out_agreement(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, folds: int = FOLDS) -> DataFrame:
    """One row (n, agreement, majority): how often scores of held-out hosts agree with the rules, over the first `folds`
    of FOLDS, each with trees of its own, and the share that the more frequent verdict would reach."""
    parts = []
    for fold in range(folds):
        scored = url_filter(pages, rules, held_out=fold)
        own = F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == fold
        parts.append(scored.where(own & F.col("rule").isNotNull()).select((F.col("verdict") == "block").cast("int").alias("y"), (F.col("score") > 0).cast("int").alias("told")))
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("told")).cast("int")).alias("agreement"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("majority"))
