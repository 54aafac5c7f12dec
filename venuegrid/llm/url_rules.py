"""URL filters: fixed host and path rules, then association rules mined from labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule); a rule is a host, which stands for its subdomains as well, and the
#: start of a path. The longest rule that fits wins.
Rules = Sequence[tuple[str, str]]

MIN_SUPPORT = 0.002
MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
#: Part of the way from a verdict's share of all labels to certainty that a rule has to
#: go: a bound that a verdict of any share can pass, which a lift is not.
MIN_GAIN = 0.2
LABELS = ("label=allow", "label=block")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def url_items(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, site, path segments with their
    depth, file ending, names and values of parameters, fragment. Numbers are one token."""
    text = F.coalesce(url, F.lit(""))
    host = host_of(text)
    labels = F.split(host, r"\.")
    path = F.lower(F.regexp_replace(path_of(text), "[0-9]+", "0"))
    segments = F.split(path, "/")
    query = F.lower(F.regexp_replace(F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1), "[0-9]+", "0"))
    items = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        F.array(F.concat(F.lit("ending:"), F.regexp_extract(path, r"\.([a-z0]{1,5})$", 1))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), x)),
        F.array(F.concat(F.lit("fragment:"), F.lower(F.regexp_extract(text, r"(?s)#(.*)$", 1)))),
    )
    return F.array_distinct(F.filter(items, lambda x: ~F.endswith(x, F.lit(":"))))


def _alike(baskets: DataFrame, least: int) -> DataFrame:
    """(item, rep): tokens that at least ``least`` baskets have, and the smallest token that
    stands in the very same ones. Baskets are compared by their number and two sums of
    hashes of their ids."""
    own = baskets.select("basket", F.explode("items").alias("item"))
    bits = [F.sum(F.xxhash64("basket", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"h{k}") for k in (1, 2, 3)]
    known = own.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *bits).where(F.col("n") >= least)
    first = known.groupBy("n", "h1", "h2", "h3").agg(F.min("item").alias("rep"))
    return known.join(first, ["n", "h1", "h2", "h3"]).select("item", "rep")


def _unfolded(rules: DataFrame, alike: DataFrame) -> DataFrame:
    """Every rule with each choice of tokens that stand in the same baskets."""
    choices = alike.groupBy(F.col("rep").alias("item")).agg(F.collect_list("item").alias("choice"))
    named = rules.withColumn("id", F.xxhash64("items", "verdict"))
    lists = named.select("id", F.posexplode("items").alias("at", "item")).join(choices, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "choice")))["choice"].alias("lists"))
    start = F.array(F.array().cast("array<string>"))
    each = F.aggregate("lists", start, lambda sets, choice: F.flatten(F.transform(sets, lambda some: F.transform(choice, lambda x: F.concat(some, F.array(x))))))
    wide = named.join(lists, "id").select(F.explode(each).alias("chosen"), *[c for c in rules.columns if c != "items"])
    return wide.select(F.array_sort("chosen").alias("items"), *[c for c in rules.columns if c != "items"])


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    min_gain: float | None = None,
) -> DataFrame:
    """Rules (items, verdict, support, confidence, gain) that FP-growth finds in ``labelled``
    (url, blocked boolean).

    A rule is a combination of tokens whose URLs have one verdict with at least
    ``min_confidence``, ``min_lift`` times as often as all URLs, and in ``min_support``
    of all (or ``min_count`` of them, if that is more). With ``min_gain`` the lift does
    not count; the gain, by which the confidence exceeds the verdict's share, as a part
    of what the share leaves to 1, then has to reach it, as rules of both verdicts can. A rule is pruned if
    one of its parts, a token less, is a rule with the same verdict and no less
    confidence. No labelled row gives no rule.
    """
    return _unfolded(*_mined(labelled, min_support, min_count, min_confidence, min_lift, min_gain))


def _mined(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT, min_gain: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rules of ``mine_rules`` on one token of all that stand in the same baskets, and
    (item, rep) of all tokens. Any two such tokens would double the sets that are listed;
    a set with both has a part of the same confidence, so no rule is lost."""
    verdict = F.when(F.col("blocked"), LABELS[1]).otherwise(LABELS[0])
    known = labelled.where("url IS NOT NULL AND blocked IS NOT NULL")
    baskets = written(known.select(F.monotonically_increasing_id().alias("basket"), url_items(F.col("url")).alias("items"), verdict.alias("label")), "url-baskets")
    n = baskets.count()
    support = min(1.0, max(min_support, min_count / max(n, 1)))
    alike = written(_alike(baskets, math.ceil(support * n)), "url-alike")
    reps = baskets.select("basket", "label", F.explode_outer("items").alias("item")).join(alike, "item", "left").groupBy("basket", "label").agg(F.collect_set("rep").alias("reps"))
    folded = written(reps.select(F.concat("reps", F.array("label")).alias("items")), "url-folded")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(folded).freqItemsets
    sets = written(found.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    labels = F.array(*map(F.lit, LABELS))
    label = F.array_intersect("items", labels)[0]
    joint = sets.where(F.arrays_overlap("items", labels) & (F.size("items") > 1)).select(
        F.array_except("items", labels).alias("items"), F.substring_index(label, "=", -1).alias("verdict"), F.col("freq").alias("both")
    )
    shares = sets.where((F.size("items") == 1) & F.arrays_overlap("items", labels)).select(
        F.substring_index(F.col("items")[0], "=", -1).alias("verdict"), (F.col("freq") / F.lit(max(n, 1))).alias("share")
    )
    enough = F.col("share") * min_lift if min_gain is None else F.col("share") + (1 - F.col("share")) * min_gain
    rules = written(
        joint.join(sets, "items")
        .join(shares, "verdict")
        .select("items", "verdict", F.col("both").alias("support"), (F.col("both") / F.col("freq")).alias("confidence"), "share")
        .where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= enough))
        .withColumn("gain", F.coalesce(F.try_divide(F.col("confidence") - F.col("share"), 1 - F.col("share")), F.lit(0.0)))
        .drop("share"),
        "url-rules",
    )
    parts = rules.where(F.size("items") > 1).select(
        F.col("items").alias("whole"), "verdict", F.col("confidence").alias("own"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items")
    )
    better = parts.join(rules, ["items", "verdict"]).where("confidence >= own").select(F.col("whole").alias("items"), "verdict").distinct()
    return rules.join(better, ["items", "verdict"], "left_anti"), alike


def match_rules(urls: DataFrame, rules: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """For each distinct ``url`` that some rule fits: the verdict of the rule with the
    highest gain, then confidence, support and most tokens (``block`` before ``allow``).
    Among rules of one verdict gain is confidence; by confidence alone any rule of the
    common verdict would outdo a clear one of the rare verdict.

    Tokens are looked up in an inverted index of the rules; a rule fits if as many of the
    URL's tokens point to it as it has. With ``alike`` the rules are on representatives, for
    which any of their tokens stands.
    """
    numbered = rules.withColumn("rule_id", F.xxhash64("items", "verdict"))
    index = written(
        numbered.select(F.explode("items").alias("item"), "rule_id", "verdict", "support", "confidence", "gain", F.size("items").alias("n_items")), "url-index"
    )
    items = urls.where("url IS NOT NULL").select("url").distinct().select("url", F.explode(url_items(F.col("url"))).alias("item"))
    if alike is not None:
        items = items.join(alike, "item").select("url", F.col("rep").alias("item")).distinct()
    fits = (
        items.join(index, "item")
        .groupBy("url", "rule_id", "verdict", "support", "confidence", "gain", "n_items")
        .agg(F.count(F.lit(1)).alias("found"))
        .where("found = n_items")
    )
    return fits.groupBy("url").agg(F.max(F.struct("gain", "confidence", "support", "n_items", "verdict")).alias("best")).select("url", F.col("best.verdict").alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Rules, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict and whether the verdict was mined.

    ``labels`` (page_id, blocked) teach the association rules, which judge the URLs that
    no fixed rule fits; what no rule fits at all is allowed. Rules of both verdicts are
    mined, by ``min_gain`` unless ``min_lift`` is given. Null URLs and those without
    ``://`` have an empty host and path and are allowed unless mined rules fit; rows with
    equal ids are judged each for itself; an empty table gives no rows.
    """
    own = pages.select("page_id", "url")
    taught = own.where("page_id IS NOT NULL").join(labels.select("page_id", "blocked"), "page_id").select("url", "blocked")
    if "min_lift" not in mining:
        mining = {"min_gain": MIN_GAIN, **mining}
    mined_rules, alike = _mined(taught, **mining)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = own.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    based = split.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    mined = match_rules(based.where("fixed IS NULL"), mined_rules, alike)
    return based.join(mined, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"),
        (F.col("fixed").isNull() & F.col("mined").isNotNull()).alias("by_mined_rule"),
    )
