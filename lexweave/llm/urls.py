"""URL filter: host and path rules, then gradient-boosted trees.

Native: features, rules and verdicts are SQL expressions; the trees are
trained and applied by Spark's ML library on the JVM.  The features are
lexical: length, depth, digit ratio, entropy, parameter counts and the label
statistics of the host's suffix and of the path's first section, which are
counted over all labelled URLs; a URL that is learned from is given the counts
of the other folds, so that its own label is not among them.

Labelled are the URLs that a rule judges (blocked or allowed) and those whose
host has a word of a fixed list (blocked): the trees extend these judgements
to the URLs without a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.runtime import written_by_spark

#: Parts of the labelled URLs, by hash, that are left out of each other's counts.
FOLDS = 4
#: Distinct labelled URLs that are drawn of each class for training, at most.
PER_CLASS = 5000
#: Labels of the overall rate that a suffix or section is given, against chance.
PRIOR = 10
#: Host words of advertising, adult, gambling, pharmacy and spam lists.
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "escort", "free", "loan", "pills", "poker", "porn", "slots", "spam", "track", "viagra", "win", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and the path; both
    empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    terms = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / n)
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "host_digits", "url_digits", "vowels", "parameters", "fragment", "secure", "longest_label", "host_entropy", "path_entropy")
_NAMES = [f"lexweave_{x}" for x in (*FEATURES, "suffix_rate", "section_rate")]


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Named numbers of the whole url."""
    whole = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")
    share = lambda text, pattern: F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(F.lit(0.0))
    return {
        "url_length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "hyphens": count(host, r"\-"),
        "host_digits": share(host, "0-9"),
        "url_digits": share(whole, "0-9"),
        "vowels": share(host, "aeiou"),
        "parameters": count(whole, "&=") / 2,
        "fragment": count(whole, "#"),
        "secure": F.when(whole.startswith("https"), 1.0).otherwise(0.0),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(F.regexp_replace(path, "[0-9]", "0")),
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _section(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)", 1)


@dataclass
class UrlModel:
    """Trees, label counts of suffixes and sections, the rate of blocked urls."""

    trees: GBTClassificationModel | None
    counts: dict[str, DataFrame]
    rate: float

    def scored(self, rows: DataFrame, host: str = "host", path: str = "path", url: str = "url") -> DataFrame:
        """Adds ``score``: the probability that the url is to be blocked."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.rate))
        assembled = VectorAssembler(inputCols=_NAMES, outputCol="lexweave_features").transform(_with_features(rows, self.counts, self.rate, host, path, url))
        return self.trees.transform(assembled).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit("fold")), F.lit(FOLDS)).cast("int")


def _with_features(rows: DataFrame, counts: dict[str, DataFrame], rate: float, host: str = "host", path: str = "path", url: str = "url", learned: bool = False) -> DataFrame:
    """Adds the features; rows that are ``learned`` from leave their fold out.

    The written tables of counts are small unless urls are garbage: Spark
    broadcasts them under its threshold, else splits the rows of a frequent key.
    """
    features = lexical_features(F.col(url), F.col(host), F.col(path))
    rows = rows.withColumns({f"lexweave_{name}": value for name, value in features.items()} | {"lexweave_suffix": _suffix(F.col(host)), "lexweave_section": _section(F.col(path))})
    for kind, table in counts.items():
        key = f"lexweave_{kind}"
        found = rows.join(table.toDF(key, "lexweave_sums", "lexweave_ns"), key, "left")
        total = lambda name: F.aggregate(F.coalesce(name, F.array()), F.lit(0.0), lambda a, x: a + x)
        ones, every = total("lexweave_sums"), total("lexweave_ns")
        if learned:
            own = lambda name: F.coalesce(F.try_element_at(F.col(name), _fold(url) + 1), F.lit(0.0))
            ones, every = ones - own("lexweave_sums"), every - own("lexweave_ns")
        rows = found.withColumn(f"{key}_rate", (ones + PRIOR * rate) / (every + PRIOR)).drop(key, "lexweave_sums", "lexweave_ns")
    return rows


def labelled_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``(url, label)``: 1 where a rule blocks or a word of the host is on the
    fixed list, 0 where a rule allows; other urls are not labelled."""
    rows = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    listed = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(x) for x in BLOCKED_WORDS]))
    _, verdict = matching_rule(host, path, rules)
    label = F.when(listed | (verdict == "block"), 1.0).when(verdict == "allow", 0.0)
    return rows.where(host != "").select("url", label.alias("label")).where("label is not null")


def fit_url_model(labelled: DataFrame, per_class: int = PER_CLASS, rounds: int = 30, depth: int = 4) -> UrlModel:
    """Boosted trees on at most ``per_class`` distinct urls of each class of
    ``(url, label)``, each with its number of copies as weight.

    With one class only there are no trees and the class's rate is the score.
    """
    spark = labelled.sparkSession
    sizes = {int(r[0]): (r[1], r[2]) for r in labelled.groupBy("label").agg(F.count("*"), F.approx_count_distinct("url")).collect()}
    total = sum(n for n, _ in sizes.values())
    if len(sizes) < 2:
        return UrlModel(None, {}, float(next(iter(sizes), 0)))
    space = 1 << 40
    place = F.pmod(F.xxhash64("url"), F.lit(space))
    drawn = []
    for label, (size, kinds) in sorted(sizes.items()):
        # Twice the number wanted, by hash, of which the first are taken.
        own = labelled.where((F.col("label") == label) & (place < int(space * min(1.0, 2 * per_class / kinds)))).groupBy("url", "label").agg(F.count("*").alias("copies"))
        rows = own.orderBy(place, "url").limit(per_class).collect()
        drawn += [(r.url, r.label, 0.5 * total / size * r.copies) for r in rows]
    host, path = host_and_path(F.col("url"))
    rate = sizes[1][0] / total
    kinds = {"suffix": _suffix(host), "section": _section(path)}
    of_fold = lambda value, k: F.sum(F.when(_fold("url") == k, value).otherwise(0.0))
    folds = [F.array(*[of_fold(value, k) for k in range(FOLDS)]) for value in (F.col("label"), F.lit(1.0))]
    counts = {kind: written_by_spark(labelled.groupBy(key.alias(kind)).agg(*folds).toDF(kind, "sums", "ns"), kind) for kind, key in kinds.items()}
    sample = spark.createDataFrame(drawn, "url string, label double, weight double").withColumn("host", host).withColumn("path", path)
    rows = VectorAssembler(inputCols=_NAMES, outputCol="lexweave_features").transform(_with_features(sample, counts, rate, learned=True))
    trees = GBTClassifier(featuresCol="lexweave_features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, featureSubsetStrategy="onethird", seed=7)
    return UrlModel(trees.fit(rows.select("lexweave_features", "label", "weight")), counts, rate)


def filter_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: ``(id, host, path, rule, verdict, score double)``.

    A rule ``host/path`` fits its host and all subdomains if the url's path
    starts with ``/path``; the longest that fits decides, else the trees.

    * null urls and urls without ``://`` have empty host and path, fit no rule
      and have score 0;
    * repeated rows and null ids are kept; other columns are ignored, whatever
      their names; long urls are measured whole; an empty table is no error.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    scored = model.scored(rows).withColumn("score", F.when(F.col("host") == "", 0.0).otherwise(F.col("score")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
