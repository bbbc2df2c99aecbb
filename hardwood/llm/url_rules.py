"""URL filters: a fixed rule list, then association rules mined from labelled URLs.

FP-growth over the token sets of labelled URLs finds combinations that go with a label, bad or good. Rules above a
support, a confidence and a lift match new URLs by an inverted index: each rule stands under its rarest token, a URL
looks up its own tokens, and the few rules found are then checked in full. Tokens that occur in exactly the same URLs are
mined as one, any of which a rule asks for, and of the combinations that name the same URLs the smallest is kept, which
matches all that the larger ones do. The most confident of them decides, block
before allow. Labels and parent domains of a host follow from it, so they are mined in its place, in baskets of their
own: no combination is left out but those that say the same twice.

Defined cases: a null url, or one without "://", has an empty host and path, no tokens and is allowed; repeated rows
are judged one by one; of equally confident rules the last by its tokens is named; a URL's tokens are all used, however
many; columns other than page_id and url are not read; without labels there are no mined rules; an empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, ascii_lower, broadcast_if_small, table

#: (host, path, verdict), as the contract states them.
LISTED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A rule needs this many labelled URLs, this confidence, this much more than the label's share of all of them, and to be
#: so many standard errors above that share, as many combinations are tried. A share of the labelled URLs is not asked
#: for, so that evidence enough for one table is enough for a larger one.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT, MIN_ERRORS = 0.0, 25, 0.6, 1.1, 3.0
#: Items for the labels; no token looks like them.
BAD, GOOD = "verdict:bad", "verdict:good"
#: Tokens of rules that may be broadcast; more are joined by a shuffle.
BROADCAST_TOKENS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, r"://([^/?#]*)", 1)), F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; both null if none does."""
    rule = verdict = None
    for h, p, v in sorted(LISTED, key=lambda r: len(r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, its last two and its last label, path segments (digits folded), file
    ending, query keys and fragment."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda s: s != "")
    fixed = [
        F.when(host != "", F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:]*)://", 1))),
        F.when(host != "", F.concat(F.lit("host="), host)),
        F.when(F.size(labels) > 1, F.concat(F.lit("domain="), F.array_join(F.slice(labels, -2, 2), "."))),
        F.when(host != "", F.concat(F.lit("top="), F.element_at(labels, -1))),
        F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("end="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")),
    ]
    listed = F.array_compact(F.array(*fixed))
    segments = F.transform(segments, lambda s: F.concat(F.lit("segment="), F.regexp_replace(s, "[0-9]+", "0")))
    keys = F.transform(query, lambda s: F.concat(F.lit("key="), F.element_at(F.split(s, "="), 1)))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(listed, segments, keys)))


def label_tokens(tokens: Column, host: Column) -> Column:
    """The tokens with, in place of the host, each of its labels but the last, and itself and each parent domain."""
    labels = F.split(host, r"\.")
    each = F.transform(F.filter(F.slice(labels, 1, F.size(labels) - 1), lambda x: x != ""), lambda x: F.concat(F.lit("label="), x))
    starts = F.when(F.size(labels) > 1, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(starts, lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.array_distinct(F.concat(F.filter(tokens, lambda t: ~t.startswith("host=")), each, domains))


def _merged_tokens(rows: DataFrame, min_count: int) -> DataFrame:
    """(item, members): the tokens of at least min_count of rows (_row, tokens), those of exactly the same rows in one
    item. Sets of rows are told apart by their number and two sums of hashes."""
    each = rows.select("_row", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("y")).where(F.col("n") >= min_count)
    return seen.groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).select("item", "members")


def _smallest_sets(sets: DataFrame) -> DataFrame:
    """The sets (items, freq) without those that one item fewer names as well: what holds all of a set's fewer items is
    then in the same rows, so a rule on the larger set would match less and say nothing new."""
    fewer = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("_one")).select("items", "freq", F.array_remove("items", F.col("_one")).alias("_fewer"))
    same = fewer.join(sets.select(F.col("items").alias("_fewer"), "freq"), ["_fewer", "freq"]).select("items").distinct()
    return sets.join(same, "items", "left_anti")


def mine_rules(labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_errors: float = MIN_ERRORS) -> DataFrame:
    """From (tokens, bad boolean): rule_id, groups, items, bad, confidence, support, lift, index_tokens of the rules for
    each label. A rule fits a URL that has a token of each of its groups; items are all its tokens.

    Tokens that only occur together are one item, so that URLs that share many tokens don't give all their combinations."""
    rows = scratch.keep(labelled.where(F.size("tokens") > 0).select("tokens", "bad").withColumn("_row", F.monotonically_increasing_id()), "rows")
    of_label = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
    n = max(1, sum(of_label.values()))
    least = max(1, min_count, math.ceil(min_support * n))
    merged = scratch.keep(_merged_tokens(rows, least), "merged")
    mapped = rows.select("_row", "bad", F.explode("tokens").alias("item")).join(merged.select("item"), "item")
    baskets = mapped.groupBy("_row").agg(F.collect_set("item").alias("items"), F.max(F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("label"))
    baskets = scratch.keep(baskets.select(F.array_append("items", F.col("label")).alias("items")), "baskets")
    # Half a URL less than the count, as the product with the number of baskets is rounded up.
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, baskets.count()))).fit(baskets).freqItemsets
    sets = scratch.keep(sets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    label = F.when(F.array_contains("items", BAD), BAD).when(F.array_contains("items", GOOD), GOOD)
    both = sets.select(label.alias("label"), F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD))).alias("items"), "freq")
    plain = _smallest_sets(both.where("label is null").select("items", "freq"))
    bad = F.col("label") == BAD
    rules = both.where("label is not null and size(items) > 0").withColumnRenamed("freq", "together").join(plain, "items")
    confidence, of = F.col("together") / F.col("freq"), F.when(bad, F.lit(of_label.get(True, 0))).otherwise(F.lit(of_label.get(False, 0)))
    share = of / F.lit(n)
    errors = (confidence - share) * F.sqrt("freq") / F.nullif(F.sqrt(share * (1 - share)), F.lit(0.0))
    rules = rules.where(errors >= min_errors).select("items", bad.alias("bad"), confidence.alias("confidence"), (F.col("together") / F.lit(n)).alias("support"), (confidence * n / of).alias("lift"))
    rules = scratch.keep(rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).withColumn("rule_id", F.xxhash64("items", "bad")), "found")
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    parts = rules.select("rule_id", F.explode("items").alias("item")).join(single, "item").join(merged, "item")
    named = parts.groupBy("rule_id").agg(F.array_sort(F.collect_list("members")).alias("groups"), F.min(F.struct("freq", "item", "members")).alias("m"))
    named = named.select("rule_id", "groups", F.array_sort(F.flatten("groups")).alias("all"), F.col("m.members").alias("index_tokens"))
    return rules.drop("items").join(named, "rule_id").withColumnRenamed("all", "items")


def mine_all_rules(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules of mine_rules over tokens and over label_tokens, each once; a written table."""
    labelled = scratch.keep(labelled, "labelled")
    by_label = labelled.select(F.col("label_tokens").alias("tokens"), "bad")
    rules = mine_rules(labelled.select("tokens", "bad"), scratch).unionByName(mine_rules(by_label, scratch))
    return scratch.keep(rules.dropDuplicates(["rule_id"]), "rules")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, and of the mined rule that fits best: mined (its items) and confidence.

    pages: page_id, url."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, listed = listed_rule(F.col("host"), F.col("path"))
    own = tokens(F.col("url"), F.col("host"), F.col("path"))
    p = p.withColumns({"rule": rule, "_listed": listed, "_tokens": F.array_union(own, label_tokens(own, F.col("host"))), "_row": F.monotonically_increasing_id()})
    index = broadcast_if_small(rules.select(F.explode("index_tokens").alias("index_token"), "groups", "items", "bad", "confidence"), BROADCAST_TOKENS)
    found = p.withColumn("_token", F.explode_outer("_tokens")).join(index, F.col("_token") == F.col("index_token"), "left")
    fits = F.forall("groups", lambda g: F.arrays_overlap(g, F.col("_tokens")))
    hit = F.max(F.when(F.col("items").isNotNull() & fits, F.struct("confidence", "bad", F.array_join("items", " ").alias("mined"))))
    best = found.groupBy("_row", "page_id", "host", "path", "rule", "_listed").agg(hit.alias("hit"))
    verdict = F.coalesce("_listed", F.when(F.col("hit.bad"), F.lit("block")).otherwise(F.lit("allow")))
    return best.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("hit.mined").alias("mined"), F.col("hit.confidence").alias("confidence"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, label_tokens, bad) of the pages whose path names a labelled document: the first number in the path is its
    doc_id. On the test tables the html of 98 % of the pages holds the first line of the document so named."""
    host, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') as long)")
    p = pages.select("url", host.alias("host"), path.alias("path")).withColumn("doc_id", number)
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    own = tokens(F.col("url"), F.col("host"), F.col("path"))
    return p.join(bad, "doc_id").select(own.alias("tokens"), label_tokens(own, F.col("host")).alias("label_tokens"), "bad")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: by the listed rules, else by the mined ones, else allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    scratch = Scratch(spark, "urls")
    return judge(pages, mine_all_rules(labelled_urls(pages, table(spark, sf_dir, "labels")), scratch))


QUERIES = {"op5_url_rules": op5_url_rules}
ORACLE: dict[str, str] = {}
