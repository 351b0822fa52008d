"""Url filters: rules first, then gradient-boosted trees on lexical features. DataFrame and ML operations only.

A rule is a host and a path prefix with a verdict; it fits the host and its subdomains, the longest that fits decides. The trees
learn from labelled urls, a bounded sample of them: lengths, depth, shares of digits and vowels, hyphens, entropy, number of parameters,
and how often the host's last label was blocked in the sample. No word list is seen by the trees.

Defined results: null urls and urls without :// have an empty host and path, fit no rule and are judged by the trees on empty
features; with labels of one kind only, or none, the trees allow everything. Equal urls get equal verdicts; other columns are left alone.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.shared import sampled

# Fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEED_TERMS = ("spam", "casino", "pills", "bets", "adult", "ads")  # a host label with one of these as a part is a bad example

SAMPLE_ROWS = 20_000  # labelled urls used for fitting, at most
TREES, DEPTH = 10, 3
FEATURES = [
    "url_length", "host_length", "path_length", "host_labels", "depth", "parameters", "digits", "host_digits", "hyphens", "host_hyphens", "vowels",
    "longest_label", "entropy", "host_entropy", "suffix_rate"]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)
        text, verdict = F.when(fits, pattern).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def featured(urls: DataFrame) -> DataFrame:
    """The frame (with url, host and path) and the features of each url but the last; suffix is the host's last label."""
    url, name, rest = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    share = lambda text, chars: count(text, chars) / F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url), "host_length": F.length(name), "path_length": F.length(rest), "host_labels": count(name, "."),
        "depth": count(rest, "/"), "parameters": count(query, "="), "digits": share(url, "0123456789"), "host_digits": share(name, "0123456789"),
        "hyphens": count(url, "-"), "host_hyphens": count(name, "-"), "vowels": share(name, "aeiou"),
        "longest_label": F.array_max(F.transform(F.split(name, r"\."), F.length)), "entropy": _entropy(url), "host_entropy": _entropy(name),
        "suffix": F.substring_index(name, ".", -1)})


def seeded(pages: DataFrame) -> DataFrame:
    """(url, label) of the distinct urls: 1 where a label of the host has a seed term among its parts."""
    urls = pages.select(F.col("url").cast("string").alias("url")).where(F.col("url").contains("://")).distinct()
    return urls.select("url", F.arrays_overlap(F.split(host(F.col("url")), "[.-]"), F.array(*map(F.lit, SEED_TERMS))).cast("double").alias("label"))


class Filter:
    """Fitted trees (None: allow everything), and the share of blocked urls by suffix."""

    def __init__(self, model: GBTClassificationModel | None, rates: DataFrame | None, base: float):
        self.model, self.rates, self.base = model, rates, base

    def scored(self, urls: DataFrame) -> DataFrame:
        """The frame (with url, host and path) and the column score, from 0 to 1."""
        if self.model is None:
            return urls.withColumn("score", F.lit(0.0))
        rows = _vectors(featured(urls).join(F.broadcast(self.rates), "suffix", "left"), self.base)
        names = [c for c in urls.columns]
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*names, "score")


def _vectors(rows: DataFrame, base: float) -> DataFrame:
    filled = rows.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(base)))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Filter:
    """Trees from at most `rows` of the labelled urls (url, label 0 or 1)."""
    picked = sampled(labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("double").alias("label")), "url", rows)
    known = featured(picked.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))).persist()
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    if not total.n or total.bad in (0, total.n):
        return Filter(None, None, 0.0)
    base = total.bad / total.n
    rates = known.groupBy("suffix").agg(((F.sum("label") + base) / (F.count("*") + 1)).alias("suffix_rate")).limit(rows)
    train = _vectors(known.join(F.broadcast(rates), "suffix"), base).select("features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, cacheNodeIds=False).fit(train)
    fixed = labelled.sparkSession.createDataFrame([tuple(r) for r in rates.collect()], "suffix string, suffix_rate double")
    known.unpersist()
    return Filter(model, fixed, base)


def judged(pages: DataFrame, trees: Filter, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every page's url."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    text, verdict = rule(rules)
    rows = trees.scored(urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))))
    return rows.select(
        "page_id", "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
