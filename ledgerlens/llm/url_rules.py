"""URL filters: listed rules first, then association rules mined from labelled pages; DataFrame operations only.

A url becomes a set of tokens: every suffix of its host, the words of hyphenated host labels, the path segments with
digits folded, the query's keys and whether it has a fragment. Spark's FP-growth mines the token sets of labelled
pages together with their label; combinations of at most MOST tokens that reach the support and whose confidence for
blocking reaches CONFIDENCE are the rules, except those that a shorter rule of at least that confidence implies.

Matching goes through an inverted index: a rule is entered under its rarest token, distinct token sets look their
tokens up there, and what meets is tested for the rest of the rule. The most confident rule that fits decides; a url
that none fits is allowed.

Scale: pages collapse to distinct token sets before the join, a hot host is few sets, and joins have no hints.

Edge cases: a null url and one without `://` have empty host and path, no token and the verdict allow; repeated rows
are judged each; null ids are values; labels that are null or without page count for nothing, of several labels of
one page the bad one counts; without labels there are no mined rules; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, ascii_lower

#: Fixed by the contract: (rule, verdict).
LISTED = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SUPPORT = 0.002
LEAST_PAGES = 8
CONFIDENCE = 0.6
MOST = 3
BLOCK = "label:block"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a url."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, 1000), ".")))
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    words = F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    keys = F.transform(keys, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    whole = F.array_sort(F.array_distinct(F.concat(suffixes, words, segments, keys, fragment)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.coalesce(whole, F.array().cast("array<string>")))


def mined_rules(
    labelled: DataFrame, scratch: Scratch, support: float = SUPPORT, least: int = LEAST_PAGES,
    confidence: float = CONFIDENCE, most: int = MOST,
) -> DataFrame:
    """(tokens, pages, confidence) from rows (tokens, bad).

    Tokens that stand on the same labelled pages (the segments of a path that all of them share) are mined as one, the
    first in text order: a set of two of them is never a rule, because each alone is as sure. Rules are then written out with
    every one of them. So a shared path of any length is one item, not all the subsets of its segments.
    """
    rows = labelled.filter(F.size("tokens") > 0).select("tokens", "bad").withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(rows, "labelled")
    n = rows.count()
    empty = rows.select("tokens", F.lit(0).cast("long").alias("pages"), F.lit(0.0).alias("confidence")).limit(0)
    if not n:
        return empty
    share = min(1.0, max(support, least / n))
    each = rows.select("row", F.explode("tokens").alias("token"))
    alike = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("x2"),
    )
    alike = scratch.write(alike.filter(F.col("n") >= math.ceil(share * n)), "frequent")
    firsts = alike.groupBy("n", "x1", "x2").agg(F.min("token").alias("first"))
    same = scratch.write(alike.join(firsts, ["n", "x1", "x2"]).select("token", "first"), "same")
    merged = each.join(same, "token").groupBy("row").agg(F.collect_set("first").alias("items"))
    held = F.coalesce("items", F.array().cast("array<string>"))
    items = rows.select("row", "bad").join(merged, "row", "left")
    items = items.select(F.when(F.col("bad"), F.concat(held, F.array(F.lit(BLOCK)))).otherwise(held).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(items)
    sets = model.freqItemsets.filter(F.size("items") <= most + 1)
    sets = scratch.write(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    blocked = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(
        F.array_remove("items", BLOCK).alias("tokens"), F.col("freq").alias("pages")
    )
    whole = sets.select(F.col("items").alias("tokens"), F.col("freq").alias("of"))
    sure = blocked.join(whole, "tokens").withColumn("confidence", F.col("pages") / F.col("of"))
    sure = scratch.write(sure.filter(F.col("confidence") >= confidence).select("tokens", "pages", "confidence"), "sure")
    # a rule goes if a part of it is a rule that is as sure: parts are subsets of one or two tokens fewer
    parts = sure.select("tokens", "confidence", F.explode(_subsets("tokens", most)).alias("part"))
    shorter = sure.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    implied = parts.join(shorter, "part").filter("c >= confidence").select("tokens").distinct()
    found = sure.join(implied, "tokens", "left_anti").withColumnRenamed("tokens", "_of").withColumn("tokens", F.array().cast("array<string>"))
    for i in range(most):
        place = F.try_element_at("_of", F.lit(i + 1))
        one = same.select(F.col("token").alias("_token"), F.col("first").alias("_first"))
        found = found.join(one, place == F.col("_first"), "left").withColumn(
            "tokens", F.when(F.col("_token").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("_token")))
        ).drop("_token", "_first")
    return scratch.write(found.select(F.array_sort("tokens").alias("tokens"), "pages", "confidence"), "rules")


def _subsets(column: str, most: int) -> Column:
    """All proper non-empty subsets of a sorted array of at most `most` tokens."""
    t = F.col(column)
    bits = F.sequence(F.lit(1), F.greatest(F.shiftleft(F.lit(1), most) - 2, F.lit(1)))
    pick = F.transform(bits, lambda b: F.filter(t, lambda x, i: b.bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0))
    return F.array_distinct(F.filter(pick, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(t))))


def matched_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, confidence) of the token sets that a rule fits: the surest, of equals the first in text order."""
    counted = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spread = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(counted, "token")
    index = spread.groupBy("tokens", "confidence").agg(F.min(F.struct("n", "token")).alias("k")).select(
        F.col("k.token").alias("token"), F.col("tokens").alias("rule"), "confidence"
    )
    looked = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = looked.filter(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.array_join("rule", " ").alias("mined"))).alias("b")
    return fits.groupBy("tokens").agg(best).select("tokens", F.col("b.mined").alias("mined"), (-F.col("b.c")).alias("confidence"))


def judged_urls(pages: DataFrame, labels: DataFrame, rules=LISTED) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined (the tokens of the mined rule that fits), confidence."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    known = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    learned = mined_rules(rows.join(known, "page_id").select("tokens", "bad"), scratch)
    found = scratch.write(matched_sets(rows.select("tokens").distinct(), learned), "found")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.join(found, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined", "confidence"
    )
