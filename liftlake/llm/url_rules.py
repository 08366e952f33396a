"""URL filter: fixed domain rules first, association rules mined from labelled URLs for the rest.

*Fixed rules* name a host and a path prefix. A rule fits its host and all
subdomains if the URL's path starts with the rule's; the longest rule wins. A
URL can only be fitted by rules filed under one of its host's suffixes, so the
rules are one array per suffix and each URL looks up its suffixes.

*Association rules.* A labelled URL becomes a transaction: its tokens (labels of
the host, words of the path, parameters of the query) and its class. Spark's
FP-growth mines the frequent combinations; rules ``tokens -> block`` stay if
their support and confidence reach the parameters and no rule on fewer of the
same tokens is at least as confident. A URL is blocked when some rule's tokens
all occur in it.

*Matching* goes through an inverted index: each rule is posted once, under the
token that the fewest labelled URLs hold, so tokens that all URLs share have no
postings. URLs are reduced to their distinct token sets before the join, so a
host that holds a third of all pages is looked up once a token set.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
token, no rule and is allowed; labelled URLs with a null class are left out;
without a ``block`` label nothing is mined and all other URLs are allowed;
repeated rows get equal verdicts; an empty table gives an empty result; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import let, stored, whole_rows

BLOCK = "class=block"
ALLOW = "class=allow"

# A rule needs this many labelled URLs, this share of them, and this confidence.
MIN_ROWS = 10
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.8


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; null or without ``://``: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(let(labels, lambda a: F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda k: F.array_join(F.slice(a, k, F.size(a)), "."))))


def tokens(url: Column) -> Column:
    """Distinct tokens: ``host:`` labels of the host, ``path:`` words of the path, ``query:`` parameters with their values.

    Words of digits only are left out: they name single pages."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)

    def parts(text, gap, kind):
        words = F.filter(F.split(F.lower(text), gap, -1), lambda w: (w != "") & ~w.rlike(r"\A\p{N}+\z"))
        return F.transform(words, lambda w: F.concat(F.lit(kind), w))

    return F.array_sort(F.array_distinct(F.concat(
        parts(host_of(url), r"\.", "host:"), parts(path_of(url), r"[^\p{L}\p{N}]+", "path:"), parts(query, r"&", "query:"))))


def fixed_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest of ``rules`` (ties: by name) that fits, as struct(rule, verdict); null when none does."""
    by_host: dict[str, list[UrlRule]] = {}
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")

    def entry(r):
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict"))

    filed = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(r) for r in rs]))])
    here = F.flatten(F.filter(F.transform(suffixes(host), lambda s: F.try_element_at(filed, s)), lambda a: a.isNotNull()))
    fits = F.filter(here, lambda r: F.startswith(path, r["path"]))
    best = F.reduce(fits, F.lit(None).cast("struct<rule:string,path:string,verdict:string>"),
                    lambda a, b: F.when(a.isNull() | (F.length(b["rule"]) > F.length(a["rule"])), b).otherwise(a))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["rule"].alias("rule"), b["verdict"].alias("verdict"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, items, key, confidence, support) from ``labelled(url, block)``.

    ``items``: tokens, sorted; ``key``: the one that the fewest labelled URLs hold (ties: the smaller); support: share
    of labelled URLs with all items and the class. A rule is pruned when one on some of its items is as confident."""
    spark = labelled.sparkSession
    rows = stored(labelled.filter("block IS NOT NULL").select(tokens(F.col("url")).alias("items"), "block"), "labelled")
    total, blocked = rows.agg(F.count("*"), F.sum(F.col("block").cast("long"))).first()
    least = max(min_rows, min_support * (total or 0), 1)
    none = spark.createDataFrame([], "rule_id long, items array<string>, key string, confidence double, support double")
    if (blocked or 0) < least:
        return none
    # A token of fewer than ``least`` blocked URLs is in no rule, and one of all URLs changes no confidence: leave both out before mining.
    counts = rows.select(F.explode("items").alias("token"), "block").groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("b"))
    usable = stored(counts.filter((F.col("b") >= least) & (F.col("n") < total)).select("token", "n"), "tokens")
    baskets = rows.withColumn("row", F.monotonically_increasing_id())
    baskets = stored(baskets.select("row", "block", F.explode("items").alias("token")).join(usable.select("token"), "token")
                     .groupBy("row", "block").agg(F.collect_set("token").alias("tokens")), "baskets")
    transactions = baskets.select(F.concat("tokens", F.array(F.when(F.col("block"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items"))
    # The model's support is a share of the transactions it sees; URLs without a usable token are in none.
    seen = transactions.count()
    if seen < least:
        return none
    model = FPGrowth(minSupport=(math.ceil(least) - 0.5) / max(seen, 1), minConfidence=min_confidence).fit(transactions)
    mined = model.associationRules.filter((F.element_at("consequent", 1) == BLOCK) & ~F.array_contains("antecedent", ALLOW))
    mined = stored(mined.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * seen / total).alias("support")), "mined")
    return stored(_pruned(stored(_indexed(mined, usable), "indexed")), "rules")


def _indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """With ``rule_id`` and ``key``, the rarest item: the rule's only posting."""
    rules = rules.withColumn("rule_id", F.xxhash64("items"))
    rare = (rules.select("rule_id", F.explode("items").alias("token")).join(counts, "token")
            .groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rare")))
    return rules.join(rare, "rule_id").select("rule_id", "items", F.col("rare.token").alias("key"), "confidence", "support")


def _fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens, ...)`` beside each of the ``rules`` whose items they all hold."""
    posted = sets.select("*", F.explode("tokens").alias("key"))
    return posted.join(rules, "key").filter(F.size(F.array_except("items", "tokens")) == 0)


def _pruned(rules: DataFrame) -> DataFrame:
    """Without rules that fit another's items, on fewer items and no less confident: those fit the same URLs."""
    sets = rules.select(F.col("items").alias("tokens"), F.col("rule_id").alias("id"), F.col("confidence").alias("own"))
    fits = _fitting(sets, rules).filter((F.size("items") < F.size("tokens")) & (F.col("confidence") >= F.col("own")))
    return rules.join(fits.select(F.col("id").alias("rule_id")).distinct(), "rule_id", "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule_id, confidence): the most confident rule of each distinct token set of ``pages(tokens)`` that some rule fits."""
    return (_fitting(pages.select("tokens").distinct(), rules).groupBy("tokens").agg(F.max(F.struct("confidence", "support", "rule_id")).alias("best"))
            .select("tokens", "best.rule_id", "best.confidence"))


def judge_urls(pages: DataFrame, fixed: list[UrlRule], rules: DataFrame) -> DataFrame:
    """Each row of ``pages(url, ...)`` as ``row``, with host, path, rule, mined_rule (id), confidence and verdict."""
    rows = whole_rows(pages, F.col("url").alias("_url"))
    rows = rows.select("row", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), tokens(F.col("_url")).alias("tokens"))
    if rules.isEmpty():
        rows = rows.withColumns({"mined_rule": F.lit(None).cast("long"), "confidence": F.lit(None).cast("double")})
    else:
        matched = stored(match(rows, rules).withColumnRenamed("rule_id", "mined_rule"), "matched")
        rows = rows.join(matched, "tokens", "left")
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("row", "host", "path", F.col("fixed.rule").alias("rule"), "mined_rule", "confidence", verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of the pages whose document is labelled; the document's id is the last number of the URL's path.

    A page is to be blocked when its document is toxic or of low quality; of repeated labels the worst holds."""
    bad = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*\z", 1)
    of = pages.select("url", F.when(number != "", number).try_cast("long").alias("doc_id"))
    return of.join(bad, "doc_id").select("url", "block")
