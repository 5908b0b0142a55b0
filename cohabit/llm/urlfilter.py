"""URL filters (operator 3): a temporal list join.

A block list changes over time: each dated entry adds a rule (a host suffix or a path prefix) or
removes it.  A path prefix ends at a whole segment and holds on subdomains too.  Entries become validity intervals (``lead`` over each rule's dates), and an
as-of join gives every capture the rules that were active when it was fetched.

Captures are reduced to distinct (candidate rule, fetch day) pairs first, so a host that holds a third of
all captures asks the list once for each day.  Intervals and pairs meet in an equi-join on the
rule with the dates as residual; the captures, by a 128-bit hash of their candidates and day, then look up their pairs.

Defined results: an entry is active from its own date (inclusive) to its rule's next entry
(exclusive); of several entries of one rule and date the removal wins; null URLs, null times and
URLs without a host match nothing; null rules, dates or actions are no entries;
rules are compared with their host in lower case and without a slash at the end (paths keep their case); repeated captures are
each judged; an empty list blocks nothing.  An input column ``blocked_by`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, without, written


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))


def rules_of(url: Column) -> Column:
    """Every rule that could cover a URL: its host's suffixes of two labels or more, alone and with each prefix of its path in whole segments."""
    labels, segments = F.split(host(url), r"\."), F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^?#]*)", 1), "/")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    ends = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda k: F.get(segments, k - 1) != "")
    paths = F.concat(F.array(F.lit("")), F.transform(ends, lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/")))
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))
    return F.when(host(url) != "", F.array_distinct(found))


def plain_rule(rule: Column) -> Column:
    """A list's rule as ``rules_of`` spells it: host in lower case, no blanks around it, no slash at its end."""
    bare = F.trim(rule)
    return F.concat(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1), r"/+$", ""))


def intervals(entries: DataFrame, rule: str = "rule", date: str = "listed_on", action: str = "action") -> DataFrame:
    """(rule, valid_from, valid_to) of every added rule; valid_to is null while the rule stands."""
    clean = entries.where(F.col(rule).isNotNull() & F.col(date).isNotNull() & F.col(action).isin("add", "remove"))
    daily = clean.groupBy(plain_rule(F.col(rule)).alias("rule"), F.col(date).cast("date").alias("valid_from")).agg(F.max(action).alias("action"))
    dates = Window.partitionBy("rule").orderBy("valid_from")
    return daily.withColumn("valid_to", F.lead("valid_from").over(dates)).where("action = 'add'").select("rule", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Adds ``blocked_by``, the sorted rules active at fetch time, to every capture."""
    captures, out = without(captures, "blocked_by"), "blocked_by"
    keys = [free_name(captures, x) for x in ("_site", "_check")]
    day, rules = F.col(f"`{fetched}`").cast("date"), rules_of(F.col(f"`{url}`"))
    # 128 bits stand for the candidates and the day, so that no join carries arrays
    hashes = [F.when(rules.isNotNull() & day.isNotNull(), F.xxhash64(F.lit(salt), rules, day)) for salt in keys]
    plain = captures.withColumns(dict(zip(keys, hashes, strict=True)))
    site = captures.select(*[h.alias(k) for h, k in zip(hashes, ("site", "check"), strict=True)], day.alias("day"), rules.alias("rules")).where("site is not null").groupBy("site", "check").agg(F.first("day").alias("day"), F.first("rules").alias("rules"))
    pairs = written(site.select("site", "check", "day", F.explode("rules").alias("rule")), "asked-pairs")
    asked = pairs.select("rule", "day").distinct()
    # lists and questions both grow, so neither side is broadcast
    valid = intervals(entries).hint("merge")
    active = asked.join(valid, "rule").where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))).select("rule", "day")
    verdict = pairs.join(written(active.distinct(), "active-rules").hint("merge"), ["rule", "day"]).groupBy("site", "check").agg(F.array_sort(F.collect_set("rule")).alias(out))
    verdict = written(verdict, "verdicts", pairs).toDF(*keys, out).hint("merge")
    return plain.join(verdict, keys, "left").select(*[F.col(f"`{c}`") for c in captures.columns], F.coalesce(out, F.array().cast("array<string>")).alias(out))
