"""URL filters: allow and block lists, then association rules that FP-growth mines from labelled pages.

A page's url becomes a set of tokens (scheme, host and its parents, leading path segments, file ending, query keys). The
labelled pages' token sets, each with its label as one more token, go through Spark's FP-growth; rules whose consequence
is a label and that reach the least support, confidence and lift remain, but for those that a rule one token shorter
makes needless. Tokens that occur on exactly the same labelled pages are one item, named by the smallest: no itemset is
lost by it, and a long url that is repeated doesn't give all subsets of its tokens. A url has an item if it has any of
its tokens, since each of them alone would have made the same rule.

Rules are looked up in an inverted index under every token of their rarest item, so a url meets only rules that hold one of
its tokens. Distinct urls are judged; pages then take their url's verdict.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table

ALLOW, BLOCK = "allow", "block"
#: A rule's tokens stand on at least this share of the labelled pages, and on at least so many of them.
MIN_SUPPORT = 0.001
MIN_ROWS = 10
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.2

#: (rule, verdict): host, then path; a rule fits its host and all subdomains.
LISTS = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, lists=LISTS) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. The lists are arguments, and short."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(lists, key=lambda x: len(x[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; runs of digits count as 0. A null url has none."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    segments = F.filter(F.split(F.regexp_replace(path(url), r"[0-9]+", "0"), "/"), lambda x: x != "")
    places = F.transform(segments, lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    ending = F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    single = F.array_compact(
        F.array(
            F.when(F.instr(url, "://") > 0, F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER))),
            F.when(ending != "", F.concat(F.lit("ending="), ending)),
            F.when(F.instr(url, "#") > 0, F.lit("fragment")),
        )
    )
    return F.coalesce(F.array_distinct(F.concat(single, parents, places, keys)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """(antecedent, verdict, confidence, support, anchor, members, anchors) from (url, blocked).

    antecedent has the names of the items, members the tokens of each in the same order; anchor is the rarest item and
    anchors are its tokens.
    """
    rows = labelled.where(F.col("blocked").isNotNull() & F.col("url").isNotNull())
    rows = stored(rows.select(F.monotonically_increasing_id().alias("rid"), tokens(F.col("url")).alias("tokens"), "blocked"), "labelled")
    support = max(support, MIN_ROWS / max(rows.count(), MIN_ROWS))
    each = rows.select("rid", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("where"))
    least = support * rows.count()
    # the tokens of an item stand on the same pages, so they are no more than a url has
    items = counts.where(F.col("n") >= least).groupBy("n", "where").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("tokens"))
    items = stored(items.select("token", "n", "tokens"), "items")
    sets = each.join(items.select("token"), "token").groupBy("rid").agg(F.collect_list("token").alias("tokens"))
    label = F.when(F.col("blocked"), "=" + BLOCK).otherwise("=" + ALLOW)
    sets = rows.select("rid", label.alias("label")).join(sets, "rid", "left")
    sets = stored(sets.select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array("label")).alias("items")), "sets")
    spark = rows.sparkSession
    if sets.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, anchor string, members array<array<string>>, anchors array<string>")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.col("lift") >= lift))
    found = stored(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support"), "rules")
    # a rule goes if one that lacks one of its tokens is as sure of the same verdict
    shorter = found.select(
        F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("sure"), F.explode("antecedent").alias("without")
    ).withColumn("antecedent", F.array_remove("whole", F.col("without")))
    needless = shorter.join(found, ["antecedent", "verdict"]).where("confidence >= sure").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    kept = found.join(needless, ["antecedent", "verdict"], "left_anti")
    held = kept.select("antecedent", "verdict", F.explode("antecedent").alias("token")).join(items, "token")
    held = held.groupBy("antecedent", "verdict").agg(
        F.min(F.struct("n", "token", "tokens")).alias("rarest"), F.array_sort(F.collect_list(F.struct("token", "tokens"))).alias("members")
    )
    named = held.select("antecedent", "verdict", F.col("rarest.token").alias("anchor"), F.col("members.tokens").alias("members"), F.col("rarest.tokens").alias("anchors"))
    return kept.join(named, ["antecedent", "verdict"])


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, confidence, because) of the distinct urls that a rule fits: the surest rule, then the best supported,
    then a block, then the first in order of its tokens."""
    spread = urls.select("url", tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
    # a url that has several tokens of a rule's anchor meets the rule as often; the best one stays the same
    fits = spread.join(rules.withColumn("token", F.explode("anchors")), "token").where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("tokens"))))
    because = F.array_join("antecedent", " ")
    rank = F.struct("confidence", "support", F.col("verdict"), because.alias("because"))
    best = fits.groupBy("url").agg(F.max(rank).alias("best"))
    return best.select("url", "best.verdict", "best.confidence", "best.because")


def judge(pages: DataFrame, labels: DataFrame, lists=LISTS) -> DataFrame:
    """(page_id, host, path, rule, verdict, method_verdict, confidence, because) of every row of pages.

    labels: (page_id, blocked), any number of rows a page. The lists decide where a rule fits; else the mined rules do,
    and where none fits the page is allowed. A null url, or one without ://, has an empty host and path. Repeated rows
    stay. Without labels, or without rules that reach the thresholds, only the lists block.
    """
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url")
    known = pages.join(labels.where("page_id is not null"), "page_id").select("url", "blocked")
    found = matches(pages.select("url").where("url is not null").distinct(), mine(known))
    found = found.withColumnRenamed("verdict", "method_verdict")
    rows = pages.join(found, "url", "left").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    listed = list_rule(F.col("host"), F.col("path"), lists)
    verdict = F.coalesce(F.col("listed.verdict"), F.col("method_verdict"), F.lit(ALLOW))
    rows = rows.withColumn("listed", listed)
    return rows.select("page_id", "host", "path", "listed.rule", verdict.alias("verdict"), F.coalesce("method_verdict", F.lit(ALLOW)).alias("method_verdict"), "confidence", "because")


def op1_url_filter(spark, sf_dir):
    """Pages carry their label under their number: low quality or toxic means blocked."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("blocked")))
