"""URL filtering: allow and block rules, and gradient-boosted trees over lexical features for what no rule decides.

The trees are trained on labelled URLs with DataFrame aggregations: features are
cut to bins, and a level of a tree is one aggregation of gradients by node,
feature and bin, whose few rows pick the splits.  A trained model is a column
expression, so scoring runs inside the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Labelled URLs that the trees are fitted to, at most: those of the least hashes.
MAX_LABELLED = 20_000


def _cut(text: Column, stops: str) -> Column:
    return F.regexp_extract(text, f"^[^{stops}]*", 0)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = _cut(rest, "/?#")
    return _lower(host), _cut(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string; the earlier of equal length), and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL. Entropy is that of its characters."""
    url = _lower(F.coalesce(url, F.lit("")))
    length = F.length(url)
    safe = F.greatest(length, F.lit(1)).cast("double")
    share = lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / safe
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "length": length.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "host_parts": _count(host, ".").cast("double"),
        "digit_ratio": digits / safe,
        "host_hyphens": _count(host, "-").cast("double"),
        "entropy": entropy,
        "parameters": (_count(url, "=") + _count(url, "&")).cast("double"),
        "secure": url.startswith("https://").cast("double"),
    }


@dataclass(frozen=True)
class UrlModel:
    """Trained trees: bin edges of features, statistics of suffixes, and nested splits."""

    prior: float
    suffixes: tuple[tuple[str, float], ...]
    trees: tuple

    def score(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (url, host, path and others) with the log-odds of block; features are columns first, so each is computed once."""
        features = _with_suffix(lexical_features(F.col("url"), F.col("host"), F.col("path")), F.col("host"), self.suffixes, self.prior)
        wide = rows.select("*", *[v.alias(f"__{k}") for k, v in features.items()])
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + _walk(tree, {k: F.col(f"__{k}") for k in features})
        return wide.select(*rows.columns, total.alias(name))


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _with_suffix(features: dict[str, Column], host: Column, suffixes, prior: float) -> dict[str, Column]:
    rate = F.lit(prior)
    if suffixes:
        table = F.create_map(*[F.lit(x) for pair in suffixes for x in pair])
        rate = F.coalesce(F.try_element_at(table, _suffix(host)), rate)
    return {**features, "suffix_log_odds": rate}


def _walk(tree, features: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, edge, below, above = tree
    return F.when(features[name] <= edge, _walk(below, features)).otherwise(_walk(above, features))


def train(labelled: DataFrame, trees: int = 6, depth: int = 3, bins: int = 16, rate: float = 0.3, penalty: float = 1.0, max_labelled: int = MAX_LABELLED) -> UrlModel | None:
    """Fit trees to ``url, blocked`` (0 or 1); None if there aren't both labels.

    Rows with a null url or label are left out.  At most ``max_labelled`` rows are
    used, those whose URLs have the least hashes, so the sample is the same
    however the rows are dealt.  A suffix with fewer than 20 rows or with labels of
    one kind only says nothing: it counts like an unknown one.
    """
    rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled)
    host, path = host_and_path(F.col("url"))
    base = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    rows = rows.select("*", host.alias("host"), path.alias("path")).select("y", F.col("host"), *[v.alias(k) for k, v in base.items()])
    rows = durable(rows)
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        return None
    prior = math.log(positive / (n - positive))
    by_suffix = rows.groupBy(_suffix(F.col("host")).alias("s")).agg(F.sum("y").alias("b"), F.count("*").alias("n")).where("n >= 20 and b > 0 and b < n").orderBy("s").collect()  # of the bounded sample: a twentieth of its rows at most
    strength = 20 * positive / n
    suffixes = tuple((r.s, math.log((r.b + strength) / (r.n - r.b + 20 - strength))) for r in by_suffix)
    features = _with_suffix({k: F.col(k) for k in base}, F.col("host"), suffixes, prior)
    rows = rows.select("y", *[v.alias(k) for k, v in features.items()])
    edges = rows.agg(*[F.percentile(k, F.lit([(i + 1) / bins for i in range(bins - 1)])).alias(k) for k in features]).first().asDict()
    edges = {k: sorted(set(v)) for k, v in edges.items()}
    # rows in the same bins are one row with a weight; the sample is bounded, so a single task holds it
    features_binned = [sum(((F.col(k) > e).cast("int") for e in edges[k]), F.lit(0)).alias(k) for k in features]
    binned = rows.select("y", *features_binned).groupBy("y", *features).agg(F.count("*").cast("double").alias("w"))
    state = durable(binned.withColumn("margin", F.lit(prior)).coalesce(1))
    grown: list = []
    for _ in range(trees):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
        slopes = state.select(*features, (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (F.lit(1.0) - p)).alias("h"))
        tree = _grow(slopes, list(features), edges, depth, rate, penalty)
        if isinstance(tree, float) and abs(tree) < 1e-9:
            break
        grown.append(_at_edges(tree, edges))
        state = durable(state.withColumn("margin", F.col("margin") + _walk(tree, {k: F.col(k) for k in features})))
    return UrlModel(prior, suffixes, tuple(grown))


def _at_edges(tree, edges: dict):
    """A tree over bins as one over values."""
    if isinstance(tree, float):
        return tree
    name, b, below, above = tree
    return (name, float(edges[name][b]), _at_edges(below, edges), _at_edges(above, edges))


def _grow(state: DataFrame, names: list[str], edges: dict, depth: int, rate: float, penalty: float):
    """One tree over bins, level by level; an aggregation of at most nodes x features x bins rows a level."""
    raw = {k: F.col(k) for k in names}
    splits: dict[str, tuple | float] = {}
    live = [""]
    for level in range(depth + 1):
        node = _node(splits, raw)
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names])).alias("x")
        sums = state.select(node.alias("node"), "g", "h", cells).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        table: dict[str, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums:
            table.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        following = []
        for at in live:
            if at not in table:
                splits[at] = 0.0
                continue
            first = table[at][names[0]].values()
            g, h = math.fsum(x[0] for x in first), math.fsum(x[1] for x in first)
            best = (1e-6, None)
            for k in names if level < depth else []:
                left_g = left_h = 0.0
                for b in range(len(edges[k])):
                    more = table[at][k].get(b, (0.0, 0.0))
                    left_g, left_h = left_g + more[0], left_h + more[1]
                    if left_h < 1.0 or h - left_h < 1.0:
                        continue
                    gain = left_g**2 / (left_h + penalty) + (g - left_g) ** 2 / (h - left_h + penalty) - g**2 / (h + penalty)
                    if round(gain, 6) > best[0]:
                        best = (round(gain, 6), (k, b))
            if best[1] is None:
                splits[at] = -rate * g / (h + penalty)
            else:
                splits[at] = best[1]
                following += [at + "l", at + "r"]
        live = following
        if not live:
            break
    build = lambda at: splits[at] if isinstance(splits[at], float) else (*splits[at], build(at + "l"), build(at + "r"))
    return build("")


def _node(splits: dict, raw: dict, at: str = "") -> Column:
    """The node, named by its steps, that a row is at."""
    if at not in splits or isinstance(splits[at], float):
        return F.lit(at)
    name, edge = splits[at]
    return F.when(raw[name] <= edge, _node(splits, raw, at + "l")).otherwise(_node(splits, raw, at + "r"))


def holdout_accuracy(labelled: DataFrame, **options) -> tuple[float, float] | None:
    """Share of the labelled URLs of one half (by hash) that trees fitted to the other half judge rightly, and the share of its more frequent label.

    None if the fitted half hasn't both labels.
    """
    halves = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"), F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2)).alias("half"))
    halves = durable(halves)
    model = train(halves.where("half = 0"), **options)
    if model is None:
        return None
    host, path = host_and_path(F.col("url"))
    scored = model.score(halves.where("half = 1").select("*", host.alias("host"), path.alias("path")), "odds")
    right, blocked = scored.agg(F.avg(((F.col("odds") > 0) == (F.col("blocked") == 1)).cast("double")), F.avg("blocked")).first()
    return right, max(blocked, 1 - blocked)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5, **options) -> DataFrame:
    """A row for each page: ``page_id, host, path, rule, verdict`` and ``score``, the trees' log-odds of block.

    ``labelled`` has ``url, blocked``; by default the URLs that a rule decides are
    the labelled ones; since rules go by hosts, trees would then only learn the rules'
    hosts anew, so a URL whose suffix hasn't labels of both kinds is left to no tree and allowed.  Without both labels there
    are no trees, and what no rule decides is allowed; null urls and those without a host are allowed too.
    Repeated rows each get a row; other columns are ignored.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url")).select("*", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    derived = labelled is None
    if derived:
        labelled = rows.where("said is not null").select("url", (F.col("said") == "block").cast("int").alias("blocked"))
    model = train(labelled, **options)
    rows = model.score(rows, "odds") if model else rows.withColumn("odds", F.lit(None).cast("double"))
    rows = rows.withColumn("score", F.when(F.col("host") != "", F.col("odds")))
    cut = math.log(threshold / (1 - threshold))
    told = F.lit(True) if not derived else _suffix(F.col("host")).isin([s for s, _ in model.suffixes] if model else [])
    judged = F.when((F.col("score") > cut) & told, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "score")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``filter_urls``."""
    return found.select("page_id", "host", "path", "rule", "verdict")
