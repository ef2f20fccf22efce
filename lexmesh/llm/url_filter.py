"""Operator 3, URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Features come from the url alone: lengths, depth, shares of digits and of other marks, entropy of its characters, parameter
counts, and for its host's last label and last two labels the smoothed rate of bad urls among the labelled ones. All of them
are column expressions; the trees are fitted on at most ``sample`` labelled urls, picked by a hash of the url. In fitting, a
url's suffix rates come from the labels of the other ``FOLDS`` - 1 folds, so the trees don't see its own label in them.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule fits it, and the trees judge its empty
features. With labels of one kind only, or none, the trees' verdict is that kind, or allow. Repeated rows are judged each on
its own. An empty table gives an empty result. Columns of the input keep their names; result columns replace namesakes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, settle


@dataclass(frozen=True)
class Rule:
    """Applies to a host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """The text or verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def count_of(c: Column, what: str) -> Column:
    return F.regexp_count(c, F.lit(what)).cast("double")


LEXICAL = (
    "length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "mark_share", "hyphens", "host_hyphens",
    "parameters", "query_length", "fragment", "secure", "entropy", "host_entropy", "longest_label", "extension",
)
SUFFIX = ("suffix1_rate", "suffix2_rate")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(c).cast("double")
    each = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(x != "", (n - F.length(F.replace(c, x, F.lit("")))) / n))
    return F.aggregate(each, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def with_features(urls: DataFrame, url: str) -> DataFrame:
    """urls with host, path, the LEXICAL columns and the suffixes s1 and s2."""
    u = F.coalesce(F.col(url), F.lit(""))
    base = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path, one = F.col("host"), F.col("path"), F.lit(1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return base.withColumns(
        {
            "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": count_of(path, "/[^/]"), "labels": count_of(host, "[^.]+"),
            "digit_share": count_of(u, "[0-9]") / F.greatest(F.length(u), one), "host_digit_share": count_of(host, "[0-9]") / F.greatest(F.length(host), one),
            "mark_share": count_of(u, r"[^A-Za-z0-9/.:]") / F.greatest(F.length(u), one), "hyphens": count_of(path, "-"), "host_hyphens": count_of(host, "-"),
            "parameters": count_of(query, "[^&;]+"), "query_length": F.length(query).cast("double"), "fragment": u.contains("#").cast("double"),
            "secure": u.startswith("https:").cast("double"), "entropy": entropy(u), "host_entropy": entropy(host),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double"),
            "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "s1": F.substring_index(host, ".", -1), "s2": F.substring_index(host, ".", -2),
        }
    )


FOLDS = 5


def suffix_sums(labelled: DataFrame, suffix: str) -> DataFrame:
    """(suffix, fold, n, bad): labelled urls and bad ones; fold goes by a hash of the url."""
    return labelled.groupBy(suffix, "fold").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


def suffix_rates(sums: DataFrame, suffix: str, prior: float, others: bool, strength: float = 20.0) -> DataFrame:
    """(suffix, rate): share of bad urls, shrunk towards the prior; others: (suffix, fold, rate), from all folds but the row's."""
    name = f"suffix{suffix[1:]}_rate"
    rate = lambda bad, n: ((bad + F.lit(prior * strength)) / (n + F.lit(strength))).alias(name)
    whole = sums.groupBy(suffix).agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    if not others:
        return whole.select(suffix, rate(F.col("all_bad"), F.col("all_n")))
    return sums.join(whole, suffix).select(suffix, "fold", rate(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")))


def judge_urls(urls: DataFrame, labels: DataFrame, rules: list[Rule], url: str = "url", sample: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """urls with host, path, rule, verdict and score (the trees' probability that a url is bad).

    labels: (url, bad) with bad 0 or 1; urls that repeat count as often as they are labelled.
    """
    taken = {"host", "path", "rule", "verdict", "score", *LEXICAL, *SUFFIX, "s1", "s2", "features"}
    rest = [c for c in urls.columns if c == url or c.lower() not in taken]
    featured = with_features(urls.select(*rest), url)
    labelled = labels.select(F.col(url), F.col("bad").cast("double").alias("bad")).filter("bad is not null")
    n, bad = labelled.agg(F.count("*"), F.sum("bad")).first()
    host, path = F.col("host"), F.col("path")
    rule, ruled = matching_rule(host, path, rules, "text"), matching_rule(host, path, rules, "verdict")

    def done(df: DataFrame, score: Column) -> DataFrame:
        own = F.when(score >= 0.5, "block").otherwise("allow")
        return df.select(*rest, "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), score.alias("score"))

    if not n or bad in (0, n):
        return done(featured, F.lit(bad / n if n else 0.0))
    prior = bad / n
    fold = F.pmod(F.xxhash64(F.lit(5), F.col(url)), F.lit(FOLDS)).alias("fold")
    known = settle(with_features(labelled, url).select("*", fold))
    sums = {x: settle(suffix_sums(known, x)) for x in ("s1", "s2")}

    def assembled(df: DataFrame, others: bool) -> DataFrame:
        for x, own in sums.items():
            df = df.join(suffix_rates(own, x, prior, others), [x, "fold"] if others else x, "left")
        df = df.fillna(prior, list(SUFFIX))
        return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features", handleInvalid="keep").transform(df)

    share = min(1.0, sample / n)
    picked = known.filter(F.pmod(F.xxhash64(F.lit(3), F.col(url)), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    gbt = GBTClassifier(labelCol="bad", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7)
    model = gbt.fit(settle(assembled(picked, True).select("features", "bad")))
    return done(model.transform(assembled(featured, False)), vector_to_array("probability")[1])
