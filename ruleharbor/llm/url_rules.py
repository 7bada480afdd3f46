"""URL filter by association rules. Native: DataFrame functions and Spark's FP-growth only.

Given rules (host suffix and path prefix, longest wins) judge the urls they fit, and their verdicts are
the labels. The url of a labelled page is a basket: its tokens (host parts, path parts, file type, names of
parameters) and its verdict; a url that many pages carry counts as often. FP-growth mines token combinations of
any length, and a rule ``tokens -> verdict`` stays if its support and confidence reach their bounds, it lifts
the verdict above its share, and no part of its tokens alone gives the verdict with the same confidence. Other
urls are matched by an inverted index: a mined rule is filed under its rarest token; a url looks up its tokens and
checks the rest of each rule found. The rule of highest confidence, then support, decides; without one, the
more frequent verdict.

Tokens that stand in exactly the same baskets are one item while rules are mined, named by the smallest: a rule with
one of them holds for the others too, and long paths that many pages share do not multiply. A url has the item if
it has any of its tokens.

Tokens are worked out once per distinct url, so a url that many pages share is one row; baskets are counted per page.
Defined cases: a null url or one without ``://`` has empty host and path and the default verdict; repeated rows and
null ids keep a row each; without labelled urls the default verdict is ``allow``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.llm.common import cut, small

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT = 0.01
CONFIDENCE = 0.8
PAGES = 10_000  # baskets of one url that are made together
VERDICT = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*fits)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` host parts with their place from the right, ``p:`` words of the path, ``t:`` file type,
    ``q:`` names of parameters, ``s:`` scheme."""
    parts = F.reverse(F.split(host, r"\."))
    hosts = F.transform(parts, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    # Numbers in a path are names of pages, not words: their first digit is kept.
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(
        F.lit("p:"), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z]+$", ""), r"([0-9])[0-9]*", "$1#")))
    kind = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(
        F.lit("q:"), F.element_at(F.split(x, "="), 1)))
    scheme = F.concat(F.lit("s:"), F.substring_index(url, "://", 1))
    return F.array_distinct(F.concat(
        hosts, steps, names, F.array(scheme), F.when(kind != "", F.array(F.concat(F.lit("t:"), kind))).otherwise(
            F.array().cast("array<string>"))))


def parsed(pages: DataFrame) -> DataFrame:
    """Distinct urls with the number of their pages (n), host, path, tokens and what the given rules say."""
    urls = pages.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    split = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    fits = given_rule(F.col("host"), F.col("path"))
    tokens = F.when(F.col("host") != "", tokens_of(F.col("url"), F.col("host"), F.col("path"))).otherwise(
        F.array().cast("array<string>"))
    return split.withColumn("given", fits).withColumn("tokens", tokens)


def items_of(labelled: DataFrame) -> DataFrame:
    """(token, item): the item that stands for the tokens of the same baskets. ``labelled``: url, tokens and n (baskets)."""
    # Baskets of a token are told by their number and two sums of hashes of their urls.
    hashes = [F.sum(F.xxhash64(F.lit(i), "url").cast("decimal(38,0)")).alias(f"sum{i}") for i in range(2)]
    told = labelled.select("url", "n", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("urls"), F.sum("n").alias("freq"), *hashes)
    same = ["urls", "sum0", "sum1"]
    return told.join(told.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "freq")


def url_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """(url, items): the items of the tokens of each url; tokens in no basket have none."""
    return urls.select("url", F.explode("tokens").alias("token")).join(small(items.select("token", "item")), "token").groupBy("url").agg(
        F.collect_set("item").alias("items"))


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame | None, str, DataFrame | None]:
    """Mined rules (items, verdict, confidence, support, rarest), the default verdict, and the item of each token.

    ``urls``: ``parsed``, n being the pages of a url.
    """
    labelled = urls.where("given is not null")
    shares = {r["verdict"]: r["n"] for r in labelled.groupBy(F.col("given.verdict").alias("verdict")).agg(
        F.sum("n").alias("n")).collect()}
    total = sum(shares.values())
    default = max(sorted(shares), key=lambda v: shares[v]) if shares else "allow"
    if not total:
        return None, default, None
    items = cut(items_of(labelled))
    once = url_items(labelled, items).join(labelled.select("url", "given.verdict", "n"), "url").select(
        F.concat("items", F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"), "n")
    # A basket per page; those of a url that many carry are dealt to all tasks.
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = once.select("items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PAGES}"))).alias("part"))
    many = F.least(F.lit(PAGES).cast("long"), F.col("n") - F.col("part") * PAGES)
    baskets = some.repartition(parts).select("items", F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("page")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    share = reduce(lambda so_far, v: so_far.when(F.col("verdict") == v, shares[v] / total), sorted(shares), F).otherwise(0.0)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(VERDICT)).select(
        F.array_sort("antecedent").alias("need"),
        F.substring_index(F.element_at("consequent", 1), VERDICT, -1).alias("verdict"), "confidence", "support").where(
        ~F.exists("need", lambda t: t.startswith(VERDICT)))
    rules = cut(rules.where(F.col("confidence") > share))
    # A rule is spare if a part of its items is a rule of the same verdict that is no less sure. Parts are filed under
    # their first item.
    parts = rules.select(F.col("need").alias("part"), "verdict", F.col("confidence").alias("part_confidence"), F.element_at("need", 1).alias("item"))
    wider = rules.select("need", "verdict", "confidence", F.explode("need").alias("item"))
    spare = wider.join(parts, ["item", "verdict"]).where(
        (F.size("part") < F.size("need")) & (F.col("part_confidence") >= F.col("confidence"))
        & (F.size(F.array_intersect("part", "need")) == F.size("part"))).select("need", "verdict").distinct()
    kept = rules.join(spare, ["need", "verdict"], "left_anti")
    counts = items.where("token = item").select("item", "freq")
    rarest = kept.withColumn("item", F.explode("need")).join(counts, "item").groupBy("need", "verdict").agg(
        F.min(F.struct("freq", "item"))["item"].alias("rarest"),
        F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return cut(rarest), default, items


def judge(pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, the given rule that fits, the verdict and the mined rule behind it."""
    urls = cut(parsed(pages))
    rules, default, items = mine(urls, support, confidence)
    verdicts = urls.select("url", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("said"))
    none = F.lit(None).cast("string")
    if rules is None:
        judged = verdicts.withColumn("mined", none).withColumn("found", none)
    else:
        looked_up = url_items(urls.where("given is null"), items).withColumn("rarest", F.explode("items")).join(
            small(rules), "rarest").where(F.size(F.array_intersect("need", "items")) == F.size("need"))
        best = looked_up.groupBy("url").agg(F.max_by(
            F.struct(F.col("verdict").alias("found"), F.concat_ws(" & ", "need").alias("mined")),
            F.struct("confidence", "support", F.size("need"), "verdict", F.concat_ws(" & ", "need"))).alias("best"))
        judged = verdicts.join(best, "url", "left").select(
            *verdicts.columns, F.col("best.found").alias("found"), F.col("best.mined").alias("mined"))
    final = judged.select("url", "host", "path", "rule", F.coalesce("said", "found", F.lit(default)).alias("verdict"), "mined")
    return pages.select("page_id", "url").join(final, "url", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"), "mined")
