"""URL filters: given rules first, then association rules mined by FP-growth. DataFrame and SQL functions only.

Method.  A url becomes a set of tokens: its scheme, the dot-suffixes of its host,
its path segments (digits folded to #), its query keys and whether it has a fragment.
Urls of labelled pages (page_id = doc_id), together with an item that marks a bad
label (toxic 1 or quality 0), are the baskets that Spark's FP-growth mines.  A url of many
frequent tokens is mined in parts: its tokens are cut into groups of GROUP, and every
MOST_ANTECEDENT groups make a basket, so that itemsets cannot grow as a power of a url's
tokens and yet every MOST_ANTECEDENT tokens of it share a basket.  What FP-growth finds
there is a set of candidates that lacks none, whose urls and bad urls are then counted
over all tokens.  Rules from up to MOST_ANTECEDENT tokens to the mark stay if support and
confidence reach their bounds and no rule over a part of their tokens is at least as
confident.  The rules form an inverted index under their rarest token: a url looks up its tokens and
a rule matches if all its tokens are there.  A matched url is blocked.

Given rules (host/path) decide before that: a rule fits its host and all subdomains
if the url's path starts with the rule's path, and the longest rule wins.

Scale.  Matching runs once per distinct url and joins back, so copies of a url cost
one match; the urls that make up one row in HOT or more (HOT of them at most) get theirs
by broadcast, so that no copy of them is gathered in one task.  Tokens meet the rule index
under one of SALTS salts, by which common tokens are spread; both sides are shuffled.

Defined results: null url, or one without "://", has empty host and path, no rule,
no tokens and verdict allow; null or repeated page_ids are ordinary rows; empty
pages or labels give empty results or no mined rules; several labels of one id are
combined (bad if any is bad); labels beyond pages count for nothing; of rules that tie in
confidence the last by code point is named; urls of any length are matched with all their
tokens; columns other than the id and the url, whatever their names, are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT = 0.005
LEAST_HITS = 5  # a rule rests on at least so many bad urls, however few labels there are
CONFIDENCE = 0.6
MOST_ANTECEDENT = 3
GROUP = 4
HOT = 1000
SALTS = 16
MOST_BROADCAST = 20_000  # candidate rules; beyond that they meet the urls by shuffle
MARK = "!bad"


def fold(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest given rule that fits, as struct(rule, action); null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    whens = None
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        on, _, under = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + under)
        out = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        whens = F.when(fits, out) if whens is None else whens.when(fits, out)
    return whens


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url; empty without "://"."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.split(s, "=")[0]))
    scheme = F.concat(F.lit("s:"), fold(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    fragment = F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(F.array(scheme), suffixes, segments, keys, fragment)))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """((row, bad, t): the sorted frequent tokens of every labelled url; (token, n) of those tokens)."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    # labels and what is kept of the urls grow with the input, and the planner would go by their compressed size: never broadcast
    seen = pages.select("page_id", "url").join(bad.hint("merge"), "page_id")
    seen = materialize(seen.select(F.monotonically_increasing_id().alias("row"), "bad", tokens(F.col("url")).alias("tokens")))
    least = F.greatest(F.lit(seen.count() * support), F.lit(LEAST_HITS))
    flat = seen.select("row", F.explode("tokens").alias("token"))
    often = materialize(flat.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    kept = flat.join(often.select("token"), "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("t"))
    none = F.array().cast("array<string>")
    return materialize(seen.select("row", "bad").join(kept.hint("merge"), "row", "left").select("row", "bad", F.coalesce("t", none).alias("t"))), often


def baskets(held: DataFrame) -> DataFrame:
    """(items): every MOST_ANTECEDENT groups of a url's tokens, with MARK on bad urls; a url of few tokens is one basket."""
    groups = F.greatest(F.lit(1), F.ceil(F.size("t") / F.lit(GROUP))).cast("int")
    cut = held.select("bad", F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.slice("t", i * GROUP + 1, GROUP)).alias("g"))
    last = F.size("g") - 1
    some = cut.where(last < MOST_ANTECEDENT).select("bad", F.flatten("g").alias("t"))
    many = cut.where(last >= MOST_ANTECEDENT).withColumn("a", F.explode(F.sequence(F.lit(0), last - 2))).withColumn("b", F.explode(F.sequence(F.col("a") + 1, last - 1)))
    many = many.withColumn("c", F.explode(F.sequence(F.col("b") + 1, last))).select("bad", F.concat(F.get("g", "a"), F.get("g", "b"), F.get("g", "c")).alias("t"))
    mark = F.when(F.col("bad") == 1, F.array(F.lit(MARK))).otherwise(F.array().cast("array<string>"))
    return some.union(many).select(F.concat("t", mark).alias("items"))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_ANTECEDENT) -> DataFrame:
    """(rule, tokens, freq, hits, confidence): the association rules that block; tokens are sorted."""
    held, often = labelled(pages, labels, support)
    least = max(LEAST_HITS, math.ceil(held.count() * support))
    dealt = materialize(baskets(held))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, dealt.count())), minConfidence=confidence).fit(dealt)
    marked = model.freqItemsets.where((F.size("items") <= most + 1) & F.array_contains("items", MARK))
    asked = materialize(marked.select(F.array_sort(F.array_remove("items", MARK)).alias("tokens")).where(F.size("tokens") > 0))
    # each candidate is counted over the urls that hold its rarest token
    lead = asked.select("tokens", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    lead = materialize(lead)
    # the urls' tokens are never the side to broadcast
    lead = F.broadcast(lead) if lead.count() <= MOST_BROADCAST else lead.hint("merge")
    met = held.select("bad", "t", F.explode("t").alias("token")).join(lead, "token").where(F.size(F.array_except("tokens", "t")) == 0)
    rules = met.groupBy("tokens").agg(F.count(F.lit(1)).alias("freq"), F.sum("bad").alias("hits"))
    rules = materialize(rules.withColumn("confidence", F.col("hits") / F.col("freq")).where((F.col("confidence") >= confidence) & (F.col("hits") >= least)))
    # a rule goes if a rule over a part of its tokens is at least as confident: parts are listed by dropping tokens
    part = rules.select("tokens", "confidence", F.explode("tokens").alias("gone")).select(
        "tokens", "confidence", F.array_remove("tokens", F.col("gone")).alias("part")
    )
    parts = part
    for _ in range(most - 2):
        part = part.where(F.size("part") > 1).select("tokens", "confidence", "part", F.explode("part").alias("gone")).select(
            "tokens", "confidence", F.array_remove("part", F.col("gone")).alias("part")
        )
        parts = parts.union(part)
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    beaten = parts.join(known, "part").where(F.col("c") >= F.col("confidence")).select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti").select(F.array_join("tokens", " ").alias("rule"), "tokens", "freq", "hits", "confidence")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, copies, mined_rule, confidence) of every distinct url that is not null, with its most confident rule, if any."""
    seen = materialize(urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("copies")))
    used = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    share = used.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = used.join(share, "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    have = seen.select("url", tokens(F.col("url")).alias("have")).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    # the planner would go by the size of the written urls, which is far below that of their tokens: never broadcast
    hit = have.select("url", "have", "salt", F.explode("have").alias("token")).join(index.hint("merge"), ["token", "salt"])
    hit = hit.where(F.size(F.array_except("tokens", "have")) == 0)
    best = hit.groupBy("url").agg(F.max(F.struct("confidence", "rule")).alias("b"))
    return seen.join(best.hint("merge"), "url", "left").select("url", "copies", F.col("b.rule").alias("mined_rule"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of every row of pages."""
    urls = pages.select("page_id", "url")
    found = materialize(match(urls, mine(pages, labels, support, confidence)))
    total = urls.count()
    hot = found.where(F.col("copies") * HOT >= total).select("url", F.lit(True).alias("hot"), F.col("mined_rule").alias("r"), F.col("confidence").alias("c"))
    out = urls.join(F.broadcast(hot), "url", "left")  # HOT rows at most
    given = out.where(F.col("hot")).select("page_id", "url", F.col("r").alias("mined_rule"), F.col("c").alias("confidence"))
    rest = out.where(F.col("hot").isNull()).select("page_id", "url")
    # blocked urls grow with the pages and are far larger in memory than in the file the planner would go by: never broadcast
    blocked = found.where(F.col("mined_rule").isNotNull() & (F.col("copies") * HOT < total)).drop("copies").hint("merge")
    none = rest.where(F.col("url").isNull()).select("page_id", "url", F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    out = given.unionByName(rest.where(F.col("url").isNotNull()).join(blocked, "url", "left")).unionByName(none)
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.action", learned).alias("verdict"), "mined_rule", "confidence")
