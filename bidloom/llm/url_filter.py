"""URL filter: fixed host and path rules, then association rules mined from labelled urls.

FP-growth mines frequent combinations of url tokens together with the label of the page. A combination whose presence makes the
bad label likely enough becomes a blocking rule; a rule that holds a shorter rule of at least its confidence is pruned. Each rule is
indexed by its rarest token, and a url is tested only against rules whose token it holds.

Defined results: a NULL url, or one without ``://``, has empty host and path, fits no fixed rule and has no tokens, so it is allowed.
Equal urls get equal verdicts. Labels that are NULL count as not bad. Without labelled pages there are no mined rules.
Several labels of one page count as bad if any is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import lower_ascii

# Action, host, path start.
BASE_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BAD = "label:bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _first_fit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else NULL."""
    choices = []
    for action, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        choices.append(F.when(fits, F.lit(value((action, name, start)))))
    return F.coalesce(*choices) if choices else F.lit(None).cast("string")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys, each marked with its part of the url."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    found = F.concat(
        marked("s:", F.array(lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        marked("h:", F.split(url_host(url), r"\.")),
        marked("p:", F.split(lower_ascii(url_path(url)), "/")),
        marked("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def _contained(rows: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Rows of ``rows`` (key, tokens) with each rule (rule_id, antecedent, anchor, confidence) they hold in full, by the rules' anchors."""
    return (
        rows.select(key, "tokens", F.explode("tokens").alias("anchor"))
        .join(rules, "anchor")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .drop("anchor", "tokens")
    )


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6) -> DataFrame:
    """Blocking rules (rule_id, antecedent, anchor, confidence, support) from rows (tokens, bad)."""
    spark = labelled.sparkSession
    empty = "rule_id string, antecedent array<string>, confidence double, support double, anchor string"
    if labelled.isEmpty():
        return spark.createDataFrame([], empty)
    items = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    mined = (
        model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
        .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
        .withColumn("rule_id", F.array_join("antecedent", " "))
    )
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = (
        mined.select("rule_id", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    )
    rules = mined.join(anchors, "rule_id")
    longer = rules.select(F.col("rule_id").alias("longer"), F.col("antecedent").alias("tokens"), F.col("confidence").alias("own"))
    implied = (
        _contained(longer.select("longer", "tokens"), "longer", rules)
        .join(longer.select("longer", "own"), "longer")
        .filter((F.col("rule_id") != F.col("longer")) & (F.col("confidence") >= F.col("own")))
        .select(F.col("longer").alias("rule_id"))
        .distinct()
    )
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support", "anchor")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    base_rules: Sequence[tuple[str, str, str]] = BASE_RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule (the surest mined rule the url holds), confidence."""
    url = F.col("url")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    labelled = pages.select("page_id", url_tokens(url).alias("tokens")).join(bad, "page_id").select("tokens", "bad")
    rules = mine_rules(labelled, min_support, min_confidence)
    found = (
        _contained(pages.select("url").filter(url.isNotNull()).distinct().select("url", url_tokens(url).alias("tokens")), "url", rules)
        .groupBy("url")
        .agg(F.max_by(F.struct(F.col("rule_id").alias("mined_rule"), "confidence"), F.struct("confidence", "rule_id")).alias("best"))
    )
    named = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path")).join(found, "url", "left")
    host, path = F.col("host"), F.col("path")
    return named.select(
        "page_id",
        "host",
        "path",
        _first_fit(host, path, base_rules, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(
            _first_fit(host, path, base_rules, lambda r: r[0]),
            F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
        ).alias("verdict"),
        F.col("best.mined_rule").alias("mined_rule"),
        F.col("best.confidence").alias("confidence"),
    )
