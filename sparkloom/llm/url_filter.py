"""URL filters: rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame expressions.  A rule is (verdict, host, path): it fits its host and all subdomains where the URL's
path starts with the rule's, and the longest fitting rule decides.  URLs that a rule decides are the labelled ones; at most
``labelled`` of them (those with the smallest hashes) train the trees, which judge the rest.

Trees grow by histogram: features are cut at sample quantiles, and each level of a tree is one aggregation that sends
gradient and hessian sums for (node, feature, bin) to the driver: a few hundred numbers at any corpus size.  The model is a
column expression, so scoring stays inside the scan's stage.

Features: length, host length, depth, digit ratio, letter entropy, parameters, hyphens, labels of the host, length of the
last path part, suffix length, and the suffix's smoothed share of blocked labels (its statistics come from the training
sample, out of fold for the sample's own rows, so the table that is broadcast has at most ``labelled`` rows).

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; it is judged on the features that it has;
with no labelled URL, or labels of one kind, the trees are empty and the verdict is the majority's (allow where unknown); ties go
to allow; rows that repeat are judged alike; an empty table gives an empty result; other columns and their names play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, shared_dir

LABELLED = 20_000
ROUNDS, DEPTH, BINS, RATE = 8, 3, 16, 0.3
#: Parts of the sample: a row's suffix rate comes from the other ones.
PARTS = 5
#: Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "last_part", "suffix_length", "suffix_rate")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def lexical(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, suffix and the features of a URL but for suffix_rate."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double") / size)
    entropy = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log(p))
    base = picked(pages, page_id=id_col, url=url_col)
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    less = lambda c, pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    return base.select(
        "page_id", "url", "host", "path", F.substring_index("host", ".", -2).alias("suffix"),
        F.length(url).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
        less(F.col("path"), "/").alias("depth"), (less(url, "[0-9]") / size).alias("digits"), entropy.alias("entropy"),
        less(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^=&]+").alias("parameters"), less(F.col("host"), "-").alias("hyphens"),
        less(F.col("host"), r"\.").alias("labels"), F.length(F.substring_index("path", "/", -1)).cast("double").alias("last_part"),
        F.length(F.substring_index("host", ".", -1)).cast("double").alias("suffix_length"),
    )


class Trees:
    """Boosted trees over binned features; ``margin`` is their sum as a column."""

    def __init__(self, cuts: dict[str, list[float]], base: float):
        self.cuts, self.base, self.trees = cuts, base, []

    def bin_of(self, feature: str) -> Column:
        return sum(((F.col(feature) > c).cast("int") for c in self.cuts[feature]), F.lit(0))

    def margin(self, value) -> Column:
        """``value(feature)`` gives the column that a split compares: the bins in training, the raw features in use."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + self._walk(tree, value)
        return total

    def _walk(self, node, value) -> Column:
        if not isinstance(node, dict):
            return F.lit(float(node))
        return F.when(value(node), self._walk(node["right"], value)).otherwise(self._walk(node["left"], value))

    def by_bin(self, node) -> Column:
        return F.col(node["feature"]) > node["bin"]

    def by_feature(self, node) -> Column:
        return F.col(node["feature"]) > self.cuts[node["feature"]][node["bin"]]


def _leaf(g: float, h: float, rate: float) -> float:
    return -rate * g / (h + 1.0)


def fit(sample: DataFrame, features=FEATURES, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic boosting on ``sample(features..., blocked)``."""
    told = sample.agg(
        F.count("*").alias("n"), F.sum("blocked").alias("blocked"),
        *[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in features],
    ).first()
    n, blocked = told["n"], told["blocked"] or 0
    share = min(max((blocked + 0.5) / (n + 1), 1e-3), 1 - 1e-3) if n else 0.25
    trees = Trees({f: sorted(set(told[f] or [])) for f in features}, math.log(share / (1 - share)))
    if not 0 < blocked < n:
        return trees
    # equal rows of bins are one row from here on
    binned = sample.select(*[trees.bin_of(f).alias(f) for f in features], "blocked").groupBy(*features).agg(F.count("*").alias("row_n"), F.sum("blocked").alias("row_b"))
    binned = binned.coalesce(4).checkpoint()
    melted = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features])).alias("m")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-trees.margin(trees.by_bin)))
        graded = binned.withColumn("row_p", p).withColumn("row_g", F.col("row_n") * F.col("row_p") - F.col("row_b")).withColumn("row_h", F.col("row_n") * F.col("row_p") * (1 - F.col("row_p")))
        tree = None
        for _level in range(depth):
            # a node's name is its path of l and r from the root
            node = F.lit("") if tree is None else _walk_names(tree)
            sums = (
                graded.select(node.alias("node"), F.col("row_g").alias("g"), F.col("row_h").alias("h"), melted).groupBy("node", "m.feature", "m.bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            splits = _best_splits(sums, features, rate)
            tree = _grow(tree, "", splits)
            if not splits:
                break
        trees.trees.append(tree if tree is not None else 0.0)
    return trees


def _walk_names(node, name: str = "") -> Column:
    if not isinstance(node, dict):
        return F.lit(name)
    return F.when(F.col(node["feature"]) > node["bin"], _walk_names(node["right"], name + "r")).otherwise(_walk_names(node["left"], name + "l"))


def _best_splits(sums, features, rate: float) -> dict[str, dict]:
    """The split of each node with the largest gain, over its bins in order."""
    grouped: dict[str, dict[str, dict[int, tuple[float, float]]]] = {}
    for r in sums:
        grouped.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
    out = {}
    for node, by_feature in grouped.items():
        best = None
        for feature in features:
            cells = by_feature.get(feature, {})
            g_all, h_all = sum(g for g, _ in cells.values()), sum(h for _, h in cells.values())
            g_left = h_left = 0.0
            for b in sorted(cells)[:-1]:
                g_left, h_left = g_left + cells[b][0], h_left + cells[b][1]
                g_right, h_right = g_all - g_left, h_all - h_left
                gain = g_left**2 / (h_left + 1) + g_right**2 / (h_right + 1) - g_all**2 / (h_all + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, {"feature": feature, "bin": b, "left": _leaf(g_left, h_left, rate), "right": _leaf(g_right, h_right, rate)})
        if best:
            out[node] = best[1]
    return out


def _grow(tree, name: str, splits: dict[str, dict]):
    if tree is None:
        return splits.get("")
    if not isinstance(tree, dict):
        return splits.get(name, tree)
    return {**tree, "left": _grow(tree["left"], name + "l", splits), "right": _grow(tree["right"], name + "r", splits)}


def _rates(sample: DataFrame, share: Column) -> tuple[DataFrame, Column, Column]:
    """(known_suffix, told) of the sample, a row's rate without the rows of its own part, and the rate of a row that isn't in the sample.

    ``told`` has the labels and blocked ones of a suffix in each part of the sample.  A row that is learned from must not meet its own
    label in a feature, so that its rate comes from the other parts; a suffix that these don't know has the sample's share, as
    an unseen one has."""
    parts = sample.groupBy("suffix", "part").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    told = parts.groupBy("suffix").agg(F.collect_list(F.struct("part", "n", "b")).alias("told")).withColumnRenamed("suffix", "known_suffix")
    others = lambda kept: (_total(kept, "b") + 2 * share) / (_total(kept, "n") + 2)
    own = F.filter("told", lambda t: t["part"] != F.col("part"))
    return told, F.coalesce(others(own), share), F.coalesce(others(F.col("told")), share)


def _total(told: Column, field: str) -> Column:
    return F.aggregate(told, F.lit(0).cast("long"), lambda s, t: s + t[field])


def judge(pages: DataFrame, rules=RULES, labelled: int = LABELLED, id_col: str = "page_id", url_col: str = "url", learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block probability for every row.

    ``learn``, of page_id, says which of the URLs that a rule decides may be learned from; None: all."""
    shared_dir(pages.sparkSession)  # checkpoint() needs the folder
    made = lexical(pages, id_col, url_col)
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    made = made.withColumn("rule", text).withColumn("ruled", verdict)
    sample = (
        made.filter(F.col("ruled").isNotNull() & (F.lit(True) if learn is None else learn)).withColumn("blocked", (F.col("ruled") == "block").cast("int"))
        .orderBy(F.xxhash64(F.lit("urls"), "url"), "url").limit(labelled).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "url"), F.lit(PARTS))).checkpoint()
    )
    told = sample.agg(F.avg("blocked")).first()[0]
    told_of, own, whole = _rates(sample, F.lit(0.25 if told is None else float(told)))
    # a checkpoint gives it columns of its own; at most ``labelled`` rows
    rates = F.broadcast(told_of.checkpoint())
    known = lambda df, rate: df.join(rates, F.col("suffix") == F.col("known_suffix"), "left").withColumn("suffix_rate", rate)
    trees = fit(known(sample, own))
    margin = trees.margin(trees.by_feature)
    said = F.coalesce(F.col("ruled"), F.when(margin > 0, F.lit("block")).otherwise(F.lit("allow")))
    return known(made, whole).select("page_id", "host", "path", "rule", said.alias("verdict"), (1 / (1 + F.exp(-margin))).alias("block_score"))
