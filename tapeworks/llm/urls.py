"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep

# Fixed values of the contract: host, path and verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
FEATURES = 2048
GRAMS = (3, 4)
LABELLED = 2048
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, _SPLIT, 1), upper, upper.lower()), F.regexp_extract(text, _SPLIT, 2)


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and ruled: the longest rule that fits, nulls where none does."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in longest]
    pick = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)])
    return parts.select("*", pick([h + p for h, p, _ in longest]).alias("rule"), pick([v for _, _, v in longest]).alias("ruled"))


def gram_cells(host: str = "host", path: str = "path", features: int = FEATURES) -> Column:
    """The hashed cell of every character n-gram of the marked host and of the marked path; host and path differ in seed."""
    def grams(part: str, seed: int, n: int) -> Column:
        marked = F.concat(F.lit("^"), F.col(part), F.lit("$"))
        starts = F.when(F.char_length(marked) >= n, F.sequence(F.lit(1), F.char_length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substring(marked, i, F.lit(n))), F.lit(features)).cast("int"))

    return F.concat(*[grams(part, seed, n) for seed, part in enumerate((host, path)) for n in GRAMS])


def fit_urls(labelled: DataFrame, features: int = FEATURES) -> tuple[list[float], float]:
    """Weights and intercept of a regularised logistic regression; ``labelled`` has host, path and label (1: allow).

    With one class only, or no row at all, the weights are zero and the intercept says that class, or allow. The table
    is a bounded sample, so it is one partition and every rerun adds in the same order.
    """
    cells = F.transform(gram_cells(features=features), lambda c: c.cast("string"))
    table = keep(labelled.coalesce(1).select(F.col("label").cast("double").alias("label"), cells.alias("cells")))
    classes = [r["label"] for r in table.select("label").distinct().limit(3).collect()]
    if len(classes) < 2:
        return [0.0] * features, (-1.0 if classes == [0.0] else 1.0)
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(features)], inputCol="cells", outputCol="features")
    model = LogisticRegression(maxIter=60, regParam=0.01, standardization=False).fit(counts.transform(table))
    return [float(w) for w in model.coefficients], float(model.intercept)


def labelled_sample(ruled: DataFrame, rows: int = LABELLED) -> DataFrame:
    """The small labelled table: of each verdict that rules give, the ``rows`` / 2 rows with the least hash of the id."""
    key = F.xxhash64("page_id")
    part = lambda verdict: ruled.filter(F.col("ruled") == verdict).orderBy(key, "page_id", "host", "path").limit(rows // 2)
    return part("allow").unionByName(part("block")).withColumn("label", (F.col("ruled") == "allow").cast("int"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page; only the url is read.

    The longest rule that fits gives the verdict. The others get the regression's: allow at a score of 0 or more. It
    learns from ``labelled`` (host, path, label), or else from at most LABELLED of the pages that rules judge. A null or
    broken url has an empty host and path and the score of no n-grams but the marks'; repeated rows are judged alike.
    """
    ruled = with_rules(pages, rules)
    weights, intercept = fit_urls(labelled if labelled is not None else labelled_sample(ruled))
    table = F.lit(weights)
    score = F.aggregate(gram_cells(features=len(weights)), F.lit(intercept), lambda total, cell: total + F.get(table, cell))
    judged = ruled.withColumn("score", score)
    method = F.when(F.col("score") >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
