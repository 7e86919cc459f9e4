"""URL filters by association rules.

A URL becomes a set of tokens: the host's labels and whole host, path parts (runs of digits as "#"), the file's ending, query keys
and key=value pairs, the fragment. Labelled pages are transactions. Tokens that the same labelled pages have are one *class*
(told apart by two 64-bit sums of page hashes and the counts), and Spark's FP-growth mines the combinations of classes that are frequent among bad pages, so
tokens that always come together make one combination and not all their subsets. A rule is a combination that implies a bad label with at least
``CONFIDENCE``, in at least ``SUPPORT`` of the labelled pages and never fewer than ``LEAST``; of two rules where one's classes include
the other's, the longer stays only if it is more confident. So a class that only bad pages have, or that all labelled pages have, is in no
longer rule, and isn't mined. A page matches a rule when it has a token of each of its classes, which is what the rules of single
tokens would match one by one. Rules match by an inverted index: each rule is filed under its rarest class, and only tokens
that are in a rule leave the scan of the pages.

A page's label is that of the document whose number is the last run of digits in its URL's path: ``labels.doc_id``, bad
where quality is 0 or toxic is 1, merged with bad winning.

Null and empty URLs have no token, match no rule and are kept; so are all pages when there is no label or no rule. Null
labels count as good. Very long URLs are tokenised whole. Rows that repeat get the same result, a row each. Ties in confidence go to the
shorter rule, and rules of equal classes are one. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, need

SUPPORT = 0.001
LEAST = 8
CONFIDENCE = 0.7
BROADCAST = 100_000


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in order; an empty array for none."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"#(.*)$", 1)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    ending = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(
        labels, F.when(host != "", F.array(F.concat(F.lit("site:"), host))).otherwise(F.array().cast("array<string>")), parts,
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(pairs, lambda x: F.concat(F.lit("key:"), F.element_at(F.split(x, "="), 1))), F.transform(pairs, lambda x: F.concat(F.lit("pair:"), x)),
        F.when(fragment != "", F.array(F.concat(F.lit("fragment:"), fragment))).otherwise(F.array().cast("array<string>")),
    )))


def document_of(url: Column) -> Column:
    """The number in the last part of the URL's path that has one; null if there is none or it is no BIGINT."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).try_cast("bigint")


def labelled(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(tokens, bad) of the pages that have a label."""
    need(labels, "doc_id", "quality", "toxic")
    bad = (F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)
    known = labels.where(labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("bigint").alias("doc"), bad.alias("bad")).groupBy("doc").agg(F.max("bad").alias("bad"))
    numbered = pages.select(document_of(pages[url_col]).alias("doc"), pages[url_col].alias("url"))
    return numbered.join(known, "doc").select(tokens(F.col("url")).alias("tokens"), "bad").where(F.size("tokens") > 0)


def _classes(rows: DataFrame, want: float) -> DataFrame:
    """(class, names, pages, bad): tokens of (page, tokens, bad) that the same pages have, at least ``want`` of them bad."""
    each = rows.select("bad", F.xxhash64("page").alias("x"), F.xxhash64("page", F.lit(1)).alias("y"), F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("bad") >= want)
    same = seen.groupBy("pages", "bad", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("names"))
    return same.select(F.xxhash64(F.element_at("names", 1)).alias("class"), "names", "pages", "bad")


def mine(transactions: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule, classes, confidence, support) of (tokens, bad); rule is the classes joined by blanks, a class its tokens joined by bars."""
    spark = transactions.sparkSession
    schema = "rule string, classes array<array<string>>, confidence double, support double"
    rows = cut(transactions.select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"))
    n, m = rows.agg(F.count("*"), F.count_if("bad")).first()
    want = max(least, support * n)
    if m < want:
        return spark.createDataFrame([], schema)
    classes = cut(_classes(rows, want))
    mixed = classes.where((F.col("bad") < F.col("pages")) & (F.col("pages") < n))
    sign = mixed.select("class", F.element_at("names", 1).alias("token"))
    held = rows.select("page", "bad", F.explode("tokens").alias("token")).join(sign, "token").groupBy("page", "bad").agg(F.sort_array(F.collect_list("class")).alias("held"))
    held = cut(held)
    bad = held.where("bad").select(F.col("held").alias("items"))
    some = bad.count()
    single = classes.select(F.array("class").alias("set"), "bad", "pages")
    every = single
    if some >= want:
        # half a page below the count that is wanted, so that no rounding of the share asks for one more
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(want) - 0.5) / some), minConfidence=1.0).fit(bad)
        sets = cut(model.freqItemsets.where(F.size("items") > 1).select(F.sort_array("items").alias("set"), F.col("freq").alias("bad")))
        filed = _filed(sets.select("set"), mixed.select("class", "pages"))
        seen = _matches(held, filed).groupBy("set").agg(F.count("*").alias("pages"))
        every = single.unionByName(sets.join(seen, "set"))
    rules = cut(every.withColumn("confidence", F.col("bad") / F.col("pages")).where(F.col("confidence") >= confidence))
    # a longer rule must be more confident than every shorter one that it includes
    long = rules.where(F.size("set") > 1).select(F.col("set").alias("long"), F.col("confidence").alias("c"), F.explode("set").alias("class"))
    short = rules.select(F.col("set").alias("short"), F.col("confidence").alias("d"), F.element_at("set", 1).alias("class"))
    beaten = long.join(short, "class").where((F.size("short") < F.size("long")) & (F.col("d") >= F.col("c")) & (F.size(F.array_except("short", "long")) == 0)).select(F.col("long").alias("set")).distinct()
    left = rules.join(beaten, "set", "left_anti").select("set", "confidence", (F.col("bad") / F.lit(n)).alias("support"))
    named = left.withColumn("class", F.explode("set")).join(classes.select("class", "names"), "class").groupBy("set", "confidence", "support").agg(F.array_sort(F.collect_list("names")).alias("classes"))
    return named.select(F.array_join(F.transform("classes", lambda x: F.array_join(x, "|")), " ").alias("rule"), "classes", "confidence", "support")


def _filed(sets: DataFrame, uses: DataFrame) -> DataFrame:
    """(set, class): sets of classes under their rarest one, the first of equals; ``uses`` has the pages of each class."""
    each = sets.select("set", F.explode("set").alias("class")).join(uses, "class", "left")
    ranked = each.groupBy("set").agg(F.min_by("class", F.struct(F.coalesce("pages", F.lit(0)), "class")).alias("class"))
    return ranked.select("set", "class")


def _matches(pages: DataFrame, filed: DataFrame) -> DataFrame:
    """(page, set) where the page (page, held) has all of the set's classes."""
    each = pages.select("page", "held", F.explode("held").alias("class"))
    return each.join(filed, "class").where(F.size(F.array_except("set", "held")) == 0).select("page", "set")


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """``id_col``, ``url``, ``rules`` (those matched, in order), ``confidence`` (the highest, 6 places, null for none) and ``keep``."""
    need(pages, id_col, url_col)
    rules = cut(mine(labelled(pages, labels, url_col), support, confidence, least))
    key = lambda names: F.xxhash64(F.element_at(names, 1))
    sets = cut(rules.select("rule", "confidence", F.sort_array(F.transform("classes", key)).alias("set")))
    used = cut(rules.select(F.explode("classes").alias("names")).select(key("names").alias("class"), F.explode("names").alias("token")).distinct())
    if used.count() <= BROADCAST:
        used = F.broadcast(used)  # counted; beyond that the join shuffles
    url = pages[url_col]
    urls = pages.where(url.isNotNull()).select(url.alias("page")).distinct()
    hit = urls.select("page", F.explode(tokens(F.col("page"))).alias("token")).join(used, "token")
    held = cut(hit.groupBy("page").agg(F.sort_array(F.collect_set("class")).alias("held")))
    uses = held.select(F.explode("held").alias("class")).groupBy("class").agg(F.count("*").alias("pages"))
    hits = _matches(held, _filed(sets.select("set"), uses)).join(sets, "set")
    best = hits.groupBy("page").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.round(F.max("confidence"), 6).alias("confidence"))
    both = pages.select(pages[id_col].alias("id"), url.alias("page")).join(best, "page", "left")
    return both.select(F.col("id").alias(id_col), F.col("page").alias("url"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), "confidence", F.col("rules").isNull().alias("keep"))
