"""URL filters: listed rules, and association rules mined from labels. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, fresh_name, materialize, read_table

#: Host and path, and what a url gets that they fit; the longest fitting one wins.
LISTED = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Rules hold on at least this share of the labelled urls, and on at least this share of those with their tokens.
MIN_SUPPORT = 0.002
#: And on at least this many rows, so that a few labels make no rule by chance.
MIN_ROWS = 30
MIN_CONFIDENCE = 0.6
#: The item that stands for a bad label; no url token looks like it.
BAD = "!bad"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = LISTED) -> Column:
    """Struct of `rule` and `verdict` of the longest fitting listed rule, or null. A rule fits its
    host and all subdomains, if the path starts with the rule's."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host and its labels, path segments, ending, keys and values of
    the query, fragment. Digits become `#`, so that numbers do not tell urls apart. Empty for null."""
    host, path = host_of(url), path_of(url)
    scheme = ascii_lower(F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    fragment = F.coalesce(F.regexp_extract(url, r"(?s)#(.*)$", 1), F.lit(""))
    no_digits = lambda c: F.regexp_replace(c, "[0-9]+", "#")

    def named(prefix: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v))

    return F.array_distinct(
        F.concat(
            named("scheme:", F.array(scheme)),
            named("host:", F.array(host)),
            named("label:", F.flatten(F.transform(F.split(no_digits(host), r"\."), lambda x: F.concat(F.array(x), F.split(x, "-"))))),
            named("path:", F.split(no_digits(path), "/")),
            named("query:", F.split(no_digits(query), "[&;]")),
            named("fragment:", F.array(no_digits(fragment))),
        )
    )


def mine_rules(labelled: DataFrame, tokens: str, bad: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules `rule_id`, `tokens` (an array), `confidence`, `support`: sets of tokens of which urls are
    bad with at least `min_confidence`, and occur and are bad on at least `min_support` of the rows
    and on `min_rows` rows.

    labelled: an array column of distinct strings and a boolean; rows with a null in either are left
    out. FP-growth mines the sets. A rule is dropped if one with fewer of its tokens is at least as
    confident. As each frequent token is on at least `min_support` of the rows, their number is at
    most the mean number of tokens divided by it, whatever the number of rows. No rows give no rules.
    """
    spark = labelled.sparkSession
    items = F.when(F.col(bad), F.array_append(F.col(tokens), F.lit(BAD))).otherwise(F.col(tokens))
    baskets = labelled.filter(F.col(tokens).isNotNull() & F.col(bad).isNotNull()).select(items.alias("items"))
    # Only tokens that occur with a bad label often enough can be in a rule.
    counts = baskets.agg(F.count("*").alias("n"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    schema = "rule_id long, tokens array<string>, confidence double, support double"
    if not counts["bad"]:
        return spark.createDataFrame([], schema)
    support = max(min_support, min_rows / counts["n"])
    if support > 1:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.array_contains("consequent", BAD))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    rules = rules.withColumn("rule_id", F.xxhash64(F.array_join("tokens", " ")))
    # A shorter rule that makes it needless: they share the shorter one's least token.
    short = rules.select(F.col("rule_id").alias("other"), F.col("tokens").alias("part"), F.col("confidence").alias("of_part"), F.element_at("tokens", 1).alias("first"))
    long = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("first"))
    part_of = (F.size(F.array_except("part", "tokens")) == 0) & (F.size("part") < F.size("tokens")) & (F.col("of_part") >= F.col("confidence"))
    needless = long.join(short, "first").filter(part_of).select("rule_id").distinct()
    return rules.join(needless, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def match_rules(rows: DataFrame, key: str, tokens: str, rules: DataFrame) -> DataFrame:
    """`key` and `mined` (the most confident fitting rule, its tokens joined by ` + `) of the rows that
    some rule fits.

    Inverted index: every rule is posted under its rarest token (by the rows' counts); a row looks up
    its tokens, and a posted rule fits if the row has its other tokens too. So a rule costs the rows
    that have its rarest token, not those that have any.
    """
    counted = rows.select(F.explode_outer(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(counted, "token")
    rarest = posted.groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("needs"), F.max("confidence").alias("confidence"))
    index = broadcast_if_small(materialize(rarest.select("token", "needs", "confidence"), "url-index"))
    looked_up = rows.select(key, F.col(tokens).alias("has"), F.explode_outer(tokens).alias("token")).join(index, "token")
    fitting = looked_up.filter(F.size(F.array_except("needs", "has")) == 0)
    best = F.max(F.struct("confidence", F.array_join("needs", " + ").alias("rule")))
    return fitting.groupBy(key).agg(best["rule"].alias("mined"))


def judge_urls(pages: DataFrame, url: str, labelled: DataFrame, keep: list[str], listed: tuple[tuple[str, str, str], ...] = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """`keep` columns of every row of `pages`, with `host`, `path`, `rule` (the listed rule or null),
    `verdict` (that rule's; else `block` if a mined rule fits; else `allow`) and `mined` (null if none).

    labelled: `url` and boolean `bad`. Null urls, and urls without `://`, have an empty host and path.
    Equal urls are judged once and get the same verdict. Empty tables: no rows, or no mined rules.
    `keep` may not hold the new names.
    """
    if clash := {c.lower() for c in keep} & {"host", "path", "rule", "verdict", "mined"}:
        raise ValueError(f"keep may not hold {sorted(clash)}")
    baskets = labelled.select(url_tokens(F.col("url")).alias("tokens"), F.col("bad").alias("bad"))
    rules = mine_rules(baskets, "tokens", "bad", min_support, min_confidence, min_rows)
    u = fresh_name(keep, "_url")
    rows = pages.select(*keep, F.col(url).alias(u))
    if rules.isEmpty():
        found = rows.withColumn("mined", F.lit(None).cast("string"))
    else:
        distinct = rows.select(u).filter(F.col(u).isNotNull()).distinct().withColumn("tokens", url_tokens(F.col(u)))
        found = rows.join(match_rules(distinct, u, "tokens", rules), u, "left")
    found = found.withColumns({"host": host_of(F.col(u)), "path": path_of(F.col(u))})
    listing = listed_rule(F.col("host"), F.col("path"), listed)
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return found.select(*keep, "host", "path", listing["rule"].alias("rule"), F.coalesce(listing["verdict"], method).alias("verdict"), "mined")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """`url` and `bad` of the pages with a label: a page's document is named by the number that ends
    its path; it is bad if it is toxic or of low quality."""
    doc = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:/|\.[a-z]+)?$", 1)
    rows = pages.select("url", F.when(doc != "", doc.cast("long")).alias("doc_id"))
    bad = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return rows.join(bad, "doc_id").select("url", "bad")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    return judge_urls(pages, "url", labelled_urls(pages, labels), ["page_id"])


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE_SQL: dict[str, str] = {}
