"""URL filter: allow and block rules, and gradient-boosted trees on lexical
features for the URLs no rule covers.

Parsing, rules and features are column expressions; the trees are Spark ML's,
fitted on a bounded sample of labelled URLs, and score inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import shared_checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX_BINS = 1024
FEATURES = ["length", "host_length", "host_labels", "path_length", "depth", "digit_ratio", "letter_ratio",
            "hyphens", "entropy", "parameters", "has_fragment", "last_segment_length", "suffix_rate", "suffix_share"]


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host, then the beginning of the path from its first "/"

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; empty for null and for a url without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Pattern of the longest rule that fits (the first listed among equals),
    else null.  A rule fits its host and all subdomains if the path starts
    with the rule's."""
    found = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.pattern))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (with url, host and path) plus the features of the url's text."""
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url)
    per = F.greatest(n, F.lit(1))

    def count(pattern: str, text: Column) -> Column:
        return n_of(text) - n_of(F.regexp_replace(text, pattern, ""))

    def n_of(text: Column) -> Column:
        return F.char_length(text).cast("double")

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = F.transform(F.array_distinct(F.split(url, "")), lambda c: (
        n - F.char_length(F.replace(url, c, F.lit("")))) / per)
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: F.when(p > 0, acc - p * F.log2(p)).otherwise(acc))
    return df.select(
        "*", n.cast("double").alias("length"), n_of(F.col("host")).alias("host_length"),
        (F.size(F.split("host", r"\.")).cast("double")).alias("host_labels"), n_of(F.col("path")).alias("path_length"),
        count("[/]", F.col("path")).alias("depth"), (count("[0-9]", url) / per).alias("digit_ratio"),
        (count("[A-Za-z]", url) / per).alias("letter_ratio"), count("-", url).alias("hyphens"),
        entropy.alias("entropy"),
        F.when(F.char_length(query) > 0, count("&", query) + 1).otherwise(F.lit(0.0)).alias("parameters"),
        F.when(F.locate("#", url) > 0, 1.0).otherwise(0.0).alias("has_fragment"),
        n_of(F.regexp_extract("path", r"([^/]*)$", 1)).alias("last_segment_length"),
        F.pmod(F.xxhash64(F.regexp_extract("host", r"([^.]*)$", 1)), F.lit(SUFFIX_BINS)).cast("int").alias("suffix_bin"))


class UrlModel:
    """Fitted trees with the suffix statistics they use; ``constant`` stands
    for a training set with fewer than two kinds of label."""

    def __init__(self, stats: DataFrame | None, trees, constant: float | None):
        self.stats, self.trees, self.constant = stats, trees, constant

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` (with url, host and path, no null in host or path) plus
        ``block_score`` from 0 to 1."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(self.constant))
        kept = F.struct("*").alias("row")
        x = _with_stats(lexical(df.select(kept, "url", "host", "path")), self.stats)
        x = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x))
        return x.select("row.*", vector_to_array("probability")[1].alias("block_score"))


def _with_stats(x: DataFrame, stats: DataFrame) -> DataFrame:
    """Smoothed share of blocked URLs and share of URLs of the suffix's bin;
    ``stats`` has at most SUFFIX_BINS rows."""
    return x.join(F.broadcast(stats), "suffix_bin", "left").withColumns({
        "suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))})


def fit(labelled: DataFrame, max_rows: int = 10_000, trees: int = 12, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on (url, host, path, blocked 0/1).  Equal rows are one row with a
    weight, so copies take no room.  Suffix statistics count all labelled
    rows; the trees see at most ``max_rows`` distinct ones, half of them with
    each label, in the order of a hash of the url, weighted so that the labels
    keep the shares they have in all rows."""
    spark = labelled.sparkSession
    known = labelled.where("blocked IS NOT NULL").select("url", "host", "path", F.col("blocked").cast("double").alias("label"))
    rows = lexical(shared_checkpoint(known.groupBy("url", "host", "path", "label").agg(F.count(F.lit(1)).alias("copies"))))
    counts = rows.groupBy("suffix_bin", "label").agg(F.sum("copies").alias("n")).collect()  # at most 2 * SUFFIX_BINS rows
    n, bad = {}, {}
    for r in counts:
        n[r["suffix_bin"]] = n.get(r["suffix_bin"], 0) + r["n"]
        bad[r["suffix_bin"]] = bad.get(r["suffix_bin"], 0) + r["n"] * r["label"]
    total, blocked = sum(n.values()), sum(bad.values())
    if not 0 < blocked < total:
        return UrlModel(None, None, 1.0 if total and blocked else 0.0)
    stats = spark.createDataFrame([(k, float(bad[k] + 1) / (n[k] + 2), n[k] / total) for k in n],
                                  "suffix_bin int, suffix_rate double, suffix_share double")
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(max(1, max_rows // 2)) for y in (0.0, 1.0)]
    sample = shared_checkpoint(_with_stats(parts[0].unionByName(parts[1]), stats))
    seen = dict(sample.groupBy("label").agg(F.sum("copies")).collect())
    weight = F.col("copies") * F.when(F.col("label") == 1.0, blocked / seen[1.0]).otherwise((total - blocked) / seen[0.0])
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", weight))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, weightCol="weight").fit(
        train.select("features", "label", "weight"))
    return UrlModel(stats, model, None)


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", **training) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score), one row per page.

    The verdict is the rule's, else ``block`` where the trees give 0.5 or
    more, else ``allow``.  ``labelled`` (url, blocked 0/1) are the URLs to
    learn from; by default those that a rule covers, labelled by the rule.
    Null and empty urls are judged like any other text; null and repeated ids
    pass through; with labels of one kind only (or none) the trees give way
    to that kind (to ``allow``)."""
    def parsed(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))

    own = parsed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url")
    own = own.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdicts = {r.pattern: r.verdict for r in rules}
    rule_verdict = F.lit(None).cast("string")
    for pattern, verdict in verdicts.items():
        rule_verdict = F.when(F.col("rule") == pattern, F.lit(verdict)).otherwise(rule_verdict)
    if labelled is None:
        learn = own.where("rule IS NOT NULL").withColumn("blocked", (rule_verdict == "block").cast("int"))
    else:
        learn = parsed(labelled.select(F.col("url").cast("string").alias("url"), "blocked"), "url")
    model = fit(learn.select("url", "host", "path", "blocked"), **training)
    return model.score(own).select(
        "page_id", "host", "path", "rule",
        F.coalesce(rule_verdict, F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "block_score")
