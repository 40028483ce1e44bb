"""URL filters: explicit host and path rules, then association rules mined by FP-growth.

URL tokens (host labels and their parts, path words, extensions, query keys)
and a label make up a transaction.  Spark's FP-growth finds the token sets
that imply the label; rules are pruned by support, by confidence, by lift
(confidence against the label's share of all rows), by how far chance could
lift them, and by a more general rule of no less confidence.  A rule is indexed under its rarest token
only; a URL meets the rules of its tokens in one equi-join, where the rest of
each rule is tested.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least share and number of rows of a token set, least confidence, lift, and standard deviations above the label's share of a rule.
SUPPORT, LEAST, CONFIDENCE, LIFT, DEVIATIONS = 0.01, 10, 0.0, 1.1, 2.0
#: Groups of tokens among which FP-growth deals its trees.
GROUPS = 32
#: Rules that may be broadcast; more are joined by a shuffle.
BROADCAST_RULES = 10_000
MARK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, rest, 1), _UPPER, _LOWER), F.regexp_extract(known, rest, 2)


def tokens(url: Column) -> Column:
    """The different tokens of a url, as an array; empty if the url is null or has no ``://``."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(host, r"[.\-_]"), lambda x: F.concat(F.lit("w:"), x))
    words = F.transform(F.split(F.regexp_replace(F.lower(path), r"\d+", "#"), r"[/.\-_]"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    return F.array_distinct(F.filter(F.concat(labels, parts, words, keys), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT, deviations: float = DEVIATIONS, url_col: str = "url", label_col: str = "blocked") -> DataFrame:
    """``rule, tokens, rarest, confidence``: the pruned rules that imply the label.

    ``labelled`` has a url and a boolean each row; rows without either are
    left out, repeated rows count as often as they occur, a very long url is
    cut into tokens like any other.  A rule needs ``support`` of all rows and
    ``least`` of them with the label, ``confidence``, and ``lift`` times the
    label's share of all rows; its confidence must lie ``deviations`` standard
    errors of its rows above that share.  Without rows, or without labels, there is no rule.
    """
    spark = labelled.sparkSession
    rows = labelled.select(tokens(F.col(f"`{url_col}`")).alias("t"), F.col(f"`{label_col}`").alias("y")).where("y is not null and size(t) > 0")
    rows = materialize(rows.select(F.when(F.col("y"), F.concat("t", F.array(F.lit(MARK)))).otherwise(F.col("t")).alias("items")), "transactions")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("items", MARK)).alias("y")).first()
    if not got["y"]:
        return spark.createDataFrame([], "rule long, tokens array<string>, rarest string, confidence double")
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / got["n"])), numPartitions=GROUPS)
    sets = materialize(growth.fit(rows.repartition(GROUPS)).freqItemsets, "itemsets")
    both = sets.where(F.array_contains("items", MARK) & (F.size("items") > 1)).select(F.array_sort(F.array_except("items", F.array(F.lit(MARK)))).alias("tokens"), F.col("freq").alias("hits"))
    alone = sets.where(~F.array_contains("items", MARK)).select(F.array_sort("items").alias("key"), "freq")
    single = alone.where(F.size("key") == 1).select(F.col("key")[0].alias("token"), F.col("freq").alias("n"))
    base = got["y"] / got["n"]
    chance = deviations * (base * (1 - base)) ** 0.5
    rules = both.join(alone, F.col("tokens") == F.col("key")).where(F.col("hits") >= F.lit(max(confidence, lift * base)) * F.col("freq"))
    rules = rules.where(F.col("hits") >= F.lit(base) * F.col("freq") + F.lit(chance) * F.sqrt("freq"))
    rules = rules.select(F.xxhash64(F.array_join("tokens", " ")).alias("rule"), "tokens", (F.col("hits") / F.col("freq")).alias("confidence"))
    # a rule goes if a subset of its tokens is a rule of no less confidence; both hold the subset's first token
    one = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    general = rules.select(F.col("tokens").alias("sub"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("first"))
    worse = one.join(general, (F.col("token") == F.col("first")) & (F.col("c") >= F.col("confidence")) & (F.size("sub") < F.size("tokens")) & (F.size(F.array_except("sub", "tokens")) == 0)).select("rule").distinct()
    kept = rules.join(worse, "rule", "left_anti")
    rare = kept.select("rule", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("rarest"))
    return materialize(kept.join(rare, "rule").select("rule", "tokens", "rarest", "confidence"), "rules")


def fired(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url, confidence``: each different url that a mined rule matches, with the best rule's confidence."""
    rows = urls.select(F.col(f"`{url_col}`").alias("url")).where("url is not null").distinct().withColumn("t", tokens(F.col("url")))
    rules = rules.select("tokens", "rarest", "confidence")
    rules = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    met = rows.select("url", "t", F.explode("t").alias("token")).join(rules, F.col("token") == F.col("rarest"))
    return met.where(F.size(F.array_except("tokens", "t")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def explicit(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of ``(verdict, host/path)`` that fits; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones later: they win
        top, slash, rest = name.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every row.

    An explicit rule decides if one fits; else a url that a mined rule matches
    is blocked and any other allowed.  A null url, or one without ``://``, has
    an empty host and path and is allowed.  Repeated rows give repeated rows,
    a null id is kept, an empty table gives an empty result; other columns are
    ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    # a stored side, so that a url with very many pages can be split between tasks
    hits = materialize(fired(rows, mined).select(F.col("url").alias("_u"), "confidence"), "fired")
    rows = rows.join(hits, F.col("url") == F.col("_u"), "left").select("page_id", host.alias("host"), path.alias("path"), "confidence")
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "confidence")
