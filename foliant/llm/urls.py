"""URL filters: rules on host and path, and gradient-boosted trees on lexical features.

Everything is a DataFrame expression.  Features are string expressions on the
URL, the trees are grown from histograms that Spark aggregates over the binned
training rows (the driver sees nodes x features x bins sums, a size set by the
parameters), and a grown ensemble is one CASE expression inside the scan's
generated code.

Labels: URLs whose host has a word of a seed list are unwanted.  Suffix
statistics (share of unwanted URLs under each host suffix, smoothed) come from
one half of the labelled URLs and the trees from the other half, so that a
suffix's own label does not leak into its statistic.  At most ``LABELLED_ROWS``
labelled URLs are used, so the statistics are small enough to broadcast.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is judged by the trees like any other; without labelled URLs of both kinds
everything is allowed; URLs of any length are read whole; of rules with equal
length the last one given wins, and a score of one half blocks; repeated rows
and ids each get their row; an empty table gives no rows; columns may have any
name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, written

#: Labelled URLs that the statistics and trees are fitted on, at most.
LABELLED_ROWS = 20_000
TREES = 10
LEVELS = 3
BINS = 16
RATE = 0.4
RIDGE = 1.0
#: Weight of the overall share in a suffix's statistic, in URLs.
PRIOR_ROWS = 4
SUFFIXES = 3
#: Rules are an administrator's list; one CASE expression holds them all.
MOST_RULES = 1000

# Words in host names of advertising, gambling, adult, pill and spam sites.
SEED_WORDS = (
    "ad ads adult advert banner bet bets betting bingo casino cheap click crack escort free gamble gambling jackpot loan "
    "lottery pharma pill pills poker popunder porn replica sex slots spam tracker track viagra warez win xxx"
).split()

LEXICAL = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "hyphens")


def parsed(urls: DataFrame, url_col: str, *keep: str) -> DataFrame:
    """(kept, url, host, path); ``kept`` holds the columns ``keep``, whatever their names."""
    own = urls.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return own.select(
        "kept",
        "url",
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, host, path) that fits; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for given, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(given)).otherwise(verdict)
    return rule, verdict


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the columns of ``LEXICAL``."""
    url = F.col("url")
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")), F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))
    )
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("host"), r"\.").alias("host_depth"),
        count(F.col("path"), "/").alias("path_depth"),
        (count(url, "[0-9]") / size).alias("digit_ratio"),
        entropy.alias("entropy"),
        count(url, r"[?&][^=&#]+=").alias("parameters"),
        count(F.col("host"), "-").alias("hyphens"),
    )


def suffixes(host: Column) -> Column:
    """The host's last 1, 2, ... SUFFIXES labels."""
    labels = F.split(host, r"\.")
    take = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    return F.array(*[take(n) for n in range(1, SUFFIXES + 1)])


def with_suffix_statistics(urls: DataFrame, statistics: DataFrame, base: float) -> DataFrame:
    """``urls`` with the smoothed share of unwanted URLs under each of the host's suffixes."""
    for n in range(1, SUFFIXES + 1):
        own = F.broadcast(statistics.select(F.col("suffix").alias("_suffix"), F.col("share").alias(f"suffix_{n}")))  # at most SUFFIXES x LABELLED_ROWS rows
        urls = (
            urls.withColumn("_suffix", F.element_at(suffixes(F.col("host")), n))
            .join(own, "_suffix", "left")
            .withColumn(f"suffix_{n}", F.coalesce(f"suffix_{n}", F.lit(base)))
            .drop("_suffix")
        )
    return urls


FEATURES = (*LEXICAL, *(f"suffix_{n}" for n in range(1, SUFFIXES + 1)))


@dataclass
class Node:
    """A split (feature, threshold: at most goes left) or, with no feature, a leaf."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def leaf(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.threshold, self.left.leaf()).otherwise(self.right.leaf())


@dataclass
class Ensemble:
    base: float
    trees: list[Node] = field(default_factory=list)

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.leaf()
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _place(node: Node, at: dict[int, int]) -> Column:
    """Number of the open leaf a row falls into, -1 for closed ones."""
    if node.feature is None:
        return F.lit(at.get(id(node), -1))
    return F.when(F.col(node.feature) <= node.threshold, _place(node.left, at)).otherwise(_place(node.right, at))


def grow(rows: DataFrame, features: Sequence[str], thresholds: dict[str, list[float]], trees: int, levels: int) -> Ensemble:
    """Boosted trees for the logistic loss; ``rows`` has the features, n (rows) and positive (unwanted rows)."""
    total = rows.agg(F.sum("n").alias("n"), F.sum("positive").alias("p")).first()
    if not total["p"] or total["p"] == total["n"]:
        return Ensemble(-20.0 if not total["p"] else 20.0)
    share = total["p"] / total["n"]
    model = Ensemble(math.log(share / (1 - share)))
    bins = F.array(
        *[
            F.struct(F.lit(i).alias("feature"), sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0)).alias("bin"))
            for i, f in enumerate(features)
            if thresholds[f]
        ]
    )
    for _ in range(trees):
        chance = model.probability()
        scored = rows.withColumn("g", F.col("positive") - F.col("n") * chance).withColumn("h", F.col("n") * chance * (1 - chance))
        root = Node()
        open_leaves = [root]
        for level in range(levels):
            at = {id(leaf): i for i, leaf in enumerate(open_leaves)}
            sums = (
                scored.withColumn("node", _place(root, at))
                .where("node >= 0")
                .select("node", "g", "h", F.explode(bins).alias("b"))
                .groupBy("node", "b.feature", "b.bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )
            open_leaves = _split(open_leaves, sums, features, thresholds, last=level == levels - 1)
            if not open_leaves:
                break
        model.trees.append(root)
    return model


def _split(leaves: list[Node], sums: list, features: Sequence[str], thresholds: dict[str, list[float]], last: bool) -> list[Node]:
    opened = []
    for number, leaf in enumerate(leaves):
        own = sorted((r for r in sums if r["node"] == number), key=lambda r: (r["feature"], r["bin"]))
        if not own:
            continue
        first = [r for r in own if r["feature"] == own[0]["feature"]]
        g, h = sum(r["g"] for r in first), sum(r["h"] for r in first)
        best, choice = 1e-6, None
        left_g = left_h = 0.0
        for i, r in enumerate(own):
            if i == 0 or own[i - 1]["feature"] != r["feature"]:
                left_g = left_h = 0.0
            left_g, left_h = left_g + r["g"], left_h + r["h"]
            if r["bin"] >= len(thresholds[features[r["feature"]]]):
                continue
            gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
            if gain > best:
                best, choice = gain, (features[r["feature"]], r["bin"], left_g, left_h)
        leaf.value = RATE * g / (h + RIDGE)
        if choice is None:
            continue
        name, at, left_g, left_h = choice
        leaf.feature, leaf.threshold = name, thresholds[name][at]
        leaf.left = Node(RATE * left_g / (left_h + RIDGE))
        leaf.right = Node(RATE * (g - left_g) / (h - left_h + RIDGE))
        opened += [] if last else [leaf.left, leaf.right]
    return opened


@dataclass
class UrlModel:
    ensemble: Ensemble
    statistics: DataFrame
    base: float

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path) with ``score``, the probability that the URL is unwanted."""
        whole = with_suffix_statistics(lexical_features(urls), self.statistics, self.base)
        return whole.withColumn("score", self.ensemble.probability()).drop(*FEATURES)


def seed_labels() -> Column:
    """1 where the host has a word of the seed list, else 0."""
    words = F.split("host", r"[.\-]")
    return F.arrays_overlap(words, F.array(*map(F.lit, SEED_WORDS))).cast("int")


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most: int = LABELLED_ROWS) -> UrlModel:
    """Suffix statistics and boosted trees from at most ``most`` distinct labelled URLs (label 1: unwanted)."""
    own = labelled.select(F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    drawn = own.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(most)
    whole = lexical_features(parsed(drawn, "url", "label")).withColumn("label", F.col("kept.label")).drop("kept")
    sample = written(whole.withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2))), "url-sample")
    known = sample.where("half = 0")
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    base = (total["p"] or 0) / total["n"] if total["n"] else 0.0
    statistics = written(
        known.select(F.explode(F.array_distinct(suffixes(F.col("host")))).alias("suffix"), "label")
        .groupBy("suffix")
        .agg(((F.sum("label") + PRIOR_ROWS * base) / (F.count("*") + PRIOR_ROWS)).alias("share")),
        "url-suffixes",
    )
    rows = with_suffix_statistics(sample.where("half = 1"), statistics, base)
    rows = written(rows.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("positive")).coalesce(1), "url-rows")
    cuts = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted(set(found[f] or [])) for f in FEATURES}
    return UrlModel(grow(rows, FEATURES, thresholds, TREES, LEVELS), statistics, base)


def filter_urls(urls: DataFrame, url_col: str, rules: Sequence[tuple[str, str, str]], model: UrlModel, *keep: str) -> DataFrame:
    """The columns ``keep`` with host, path, rule, verdict (the rule's, else the model's) and score."""
    rule, verdict = rule_of(rules)
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    judged = model.scored(parsed(urls, url_col, *keep))
    return judged.select("kept.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


#: Rules (verdict, host, start of the path) of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = parsed(pages, "url")
    model = fit_urls(hosts.select("url", seed_labels().alias("label")))
    return filter_urls(pages, "url", RULES, model, "page_id")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the filter that SQL can state: host, path and the rules' verdicts (null where none fits)."""
    rule, verdict = rule_of(RULES)
    return parsed(table(spark, sf_dir, "pages"), "url", "page_id").select("kept.*", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


QUERIES = {"op1_url_filters": op1_url_filters, "url_rules": url_rules}

_FITS = " OR ".join(
    f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') AND r.rule = '{h + p}')" for _, h, p in RULES
)
ORACLES = {
    "url_rules": rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h + p}', '{v}')" for v, h, p in RULES)}) AS r(rule, verdict)),
f AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS rn FROM p LEFT JOIN r ON {_FITS})
SELECT page_id, host, path, rule, verdict AS rule_verdict FROM f WHERE rn = 1
"""
}
