"""URL filter: rules, and gradient-boosted trees on lexical features for the rest.

DataFrame functions only.  The trees are grown level by level: each level is one
grouped sum of gradients over a bounded table of training rows, of which the
driver gets a histogram of nodes, features and bins and picks the best splits.
Gradients are whole numbers (millionths), so sums and trees don't depend on the
order of rows.  Both labels weigh the same in total, so a URL of which nothing is known
leans to neither side.  A suffix's rate is learnt out of fold: a training row sees
what the other folds say of its suffix, and an unseen suffix is neutral.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: (host, path, verdict), as the contract has them.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Labelled URLs that the trees are trained on, at most: those of the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 8, 3, 16, 0.4, 1.0
UNIT = 1_000_000
#: Parts of the training rows, and the rows' weight by which a suffix's rate is drawn towards neutral.
FOLDS, SMOOTHING, NEUTRAL = 5, 10.0, 0.5
#: Tasks that measure the drawn URLs.
DRAWN_PARTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does.

    The rules are a parameter that becomes part of the plan: some hundreds at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    return F.xxhash64(F.regexp_extract(host, r"(?s)[^.]*$", 0))


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "suffix_rate")


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with a column ``f`` of all features but the suffix's rate; a null URL counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(u)
    count = lambda pattern: F.length(u) - F.length(F.regexp_replace(u, pattern, ""))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars))
    # rounded, so that the order of characters makes no other number
    entropy = F.round(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), 9)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    params = F.when(query == "", 0).otherwise(F.length(query) - F.length(F.regexp_replace(query, "&", "")) + 1)
    depth = F.length(path) - F.length(F.regexp_replace(path, "/", ""))
    dots = F.length(host) - F.length(F.regexp_replace(host, r"\.", ""))
    values = (F.length(u), F.length(host), F.length(path), depth, dots, count("[0-9]") / F.greatest(F.length(u), F.lit(1)), count("-"), entropy, params)
    return rows.withColumn("f", F.array(*[v.cast("double") for v in values])).withColumn("suffix", suffix(host))


@dataclass(frozen=True)
class Model:
    trees: tuple  # each: {node: (feature, cut)} of heap-numbered nodes, {leaf: value in millionths}
    base: int
    suffix_rates: DataFrame  # (suffix, rate): a row a training suffix, TRAIN_ROWS at most
    cuts: tuple = ()  # of each feature, where it may be split


def _value(node: int, splits: dict, leaves: dict) -> Column:
    if node in splits:
        feature, cut = splits[node]
        return F.when(F.col("x")[feature] <= cut, _value(2 * node, splits, leaves)).otherwise(_value(2 * node + 1, splits, leaves))
    return F.lit(leaves.get(node, 0)).cast("long")


def _margin(model_base: int, trees) -> Column:
    total = F.lit(model_base).cast("long")
    for splits, leaves in trees:
        total = total + _value(1, splits, leaves)
    return total


def _node(splits: dict, node: int = 1) -> Column:
    if node not in splits:
        return F.lit(node)
    feature, cut = splits[node]
    return F.when(F.col("x")[feature] <= cut, _node(splits, 2 * node)).otherwise(_node(splits, 2 * node + 1))


def _bin(feature: int, cuts: list[float]) -> Column:
    """How many cuts the feature's value exceeds."""
    value = F.col("x")[feature]
    return F.size(F.filter(F.lit([float(c) for c in cuts]).cast("array<double>"), lambda c: value > c))


def _with_rate(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``x``: all features.  ``rates`` is broadcast: two numbers for each of at most TRAIN_ROWS suffixes."""
    known = F.broadcast(rates.select(F.col("suffix").alias("__suffix"), "rate"))
    joined = rows.join(known, F.col("suffix") == F.col("__suffix"), "left")
    return joined.withColumn("x", F.concat("f", F.array(F.coalesce("rate", F.lit(NEUTRAL))))).drop("__suffix", "rate", "f", "suffix")


def _rate(bad: Column, all_: Column) -> Column:
    return (bad + SMOOTHING * NEUTRAL) / (all_ + SMOOTHING)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _leaf(g: float, h: float) -> int:
    return round(RATE * g / (h + L2) * UNIT)


def _best_split(features: dict, cuts: list[list[float]], g: float, h: float):
    """``((feature, cut), (left gradient, left curvature))`` of the highest gain; None if nothing gains."""
    best, found = 1e-6, None
    for k in sorted(features):
        left_g = left_h = 0.0
        for b, cut in enumerate(cuts[k]):
            dg, dh = features[k].get(b, (0.0, 0.0))
            left_g, left_h = left_g + dg, left_h + dh
            gain = left_g**2 / (left_h + L2) + (g - left_g) ** 2 / (h - left_h + L2) - g**2 / (h + L2)
            if left_h > 1e-3 and h - left_h > 1e-3 and gain > best + 1e-9:
                best, found = gain, ((k, float(cut)), (left_g, left_h))
    return found


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Trees for ``labelled(url, label)``, label 1 to block.

    Equal URLs count once, with the mean of their labels rounded.  The model is
    trained on at most ``rows`` of them, chosen by hash; both labels weigh half.
    Without any, or with one label only, every URL gets that label, or allow.
    """
    once = labelled.filter(F.col("url").isNotNull()).groupBy("url").agg(F.round(F.avg("label")).cast("int").alias("label"))
    drawn = once.orderBy(F.xxhash64("url"), "url").limit(rows).repartition(DRAWN_PARTS, "url")
    sample = written(lexical(drawn).select("f", "suffix", "label", _fold(F.col("url")).alias("fold")), "labelled")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    # a label's rows weigh half of all rows together
    weight = F.when(F.col("label") == 1, F.lit(n / 2 / max(blocked, 1))).otherwise(F.lit(n / 2 / max(n - blocked, 1)))
    weighted = sample.withColumn("w", weight)
    sums = [F.sum(F.col("w") * F.col("label")).alias("bad"), F.sum("w").alias("held")]
    folds = written(weighted.groupBy("suffix", "fold").agg(*sums), "folds")
    whole = folds.groupBy("suffix").agg(F.sum("bad").alias("all_bad"), F.sum("held").alias("all_held"))
    rates = written(whole.select("suffix", F.round(_rate(F.col("all_bad"), F.col("all_held")), 9).alias("rate")), "suffixes")
    if not 0 < blocked < n:
        return Model((), UNIT if blocked else -UNIT, rates)
    others = folds.join(whole, "suffix").select(F.col("suffix").alias("s"), F.col("fold").alias("k"), F.round(_rate(F.col("all_bad") - F.col("bad"), F.col("all_held") - F.col("held")), 9).alias("rate"))
    known = sample.join(F.broadcast(others), (F.col("suffix") == F.col("s")) & (F.col("fold") == F.col("k")))
    features = known.select(F.concat("f", F.array("rate")).alias("x"), "label")
    # a few thousand distinct rows, one partition: levels are short jobs
    train_rows = written(features.groupBy("x", "label").agg(F.count("*").alias("n")).coalesce(1), "train")
    places = [b / bins for b in range(1, bins)]
    quantiles = train_rows.agg(*[F.percentile(F.col("x")[k], places, F.col("n")).alias(f"q{k}") for k in range(len(FEATURES))]).first()
    at = [sorted(set(quantiles[f"q{k}"])) for k in range(len(FEATURES))]
    # halfway to the next value that there is: what lies in between, as neutral suffixes do, goes to the nearer side
    x = lambda k: F.col("x")[k]
    below = [F.max(F.when(x(k) <= c, x(k))).alias(f"b{k}_{j}") for k, cs in enumerate(at) for j, c in enumerate(cs)]
    above = [F.min(F.when(x(k) > c, x(k))).alias(f"a{k}_{j}") for k, cs in enumerate(at) for j, c in enumerate(cs)]
    ends = train_rows.agg(*below, *above).first()
    pairs = [[(ends[f"b{k}_{j}"], ends[f"a{k}_{j}"]) for j in range(len(cs))] for k, cs in enumerate(at)]
    cuts = [sorted({(b + a) / 2 for b, a in ps if b is not None and a is not None}) for ps in pairs]
    base = 0
    grown: list[tuple[dict, dict]] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-_margin(base, grown) / UNIT))
        whole_ = lambda x: F.round(weight * x * UNIT).cast("long")
        rows_g = train_rows.select("x", "n", whole_(F.col("label") - p).alias("g"), whole_(p * (1 - p)).alias("h"))
        splits: dict = {}
        leaves: dict = {}
        for level in range(depth):
            binned = rows_g.select(_node(splits).alias("node"), F.posexplode(F.array(*[_bin(k, c) for k, c in enumerate(cuts)])).alias("feature", "bin"), "n", "g", "h")
            nodes = binned.filter((F.col("node") >= 1 << level) & (F.col("node") < 2 << level))
            # nodes * features * bins rows at most
            sums = nodes.groupBy("node", "feature", "bin").agg(F.sum(F.col("g") * F.col("n")).alias("g"), F.sum(F.col("h") * F.col("n")).alias("h")).collect()
            by: dict = {}
            for r in sums:
                by.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT)
            before = len(splits)
            for node, features in sorted(by.items()):
                g, h = (sum(v[i] for v in features[0].values()) for i in (0, 1))
                if node == 1:
                    leaves[1] = _leaf(g, h)
                split = _best_split(features, cuts, g, h)
                if split:
                    splits[node], (left_g, left_h) = split
                    leaves[2 * node], leaves[2 * node + 1] = _leaf(left_g, left_h), _leaf(g - left_g, h - left_h)
            if len(splits) == before:
                break
        grown.append((splits, {k: v for k, v in leaves.items() if k not in splits}))
    discard(sample, folds, train_rows)
    return Model(tuple(grown), base, rates, tuple(map(tuple, cuts)))


def scored(rows: DataFrame, model: Model, url: str = "url") -> DataFrame:
    """``rows`` with ``margin``: above zero to block."""
    ready = _with_rate(lexical(rows, url), model.suffix_rates)
    return ready.withColumn("margin", _margin(model.base, model.trees) / UNIT).drop("x")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, margin)`` for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with its path, and
    the longest wins.  Where none fits the trees decide, trained on ``labelled``
    or, by default, on the URLs of ``pages`` that a rule decides.  Null URLs and
    those without ``://`` have an empty host and path, and the trees judge them.
    Repeated rows get a row each, ids may be null, and other columns are not
    looked at.
    """
    raw = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = raw.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = ruled.filter(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    model = train(labelled)
    own = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return scored(ruled, model).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "margin")
