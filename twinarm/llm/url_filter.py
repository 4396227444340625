"""URL filter by host reputation, an empirical-Bayes estimate, with explicit rules before it.

Outcomes of labelled pages are counted by host. A host belongs to a registered domain, a domain to a
suffix. On each level the share of bad pages of a group is beta-binomial around the estimate of the rest
of the group above, with a spread that the method of moments finds from all groups of that level; a
group's posterior is the prior of the groups below it. So a host with many labelled pages is judged by
them, one with few by its domain, an unseen one by its domain, suffix or the whole table. A host is
blocked if its posterior share of bad pages lies above ``LIMIT`` by ``SURE`` standard deviations.

Pages are counted by partial aggregates, and everything after that works on hosts.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.llm.storage import stage

#: A host is blocked where its share of bad pages surely exceeds this.
LIMIT = 0.5
#: Posterior standard deviations between the mean and the bound.
SURE = 1.645
#: Bounds of the spread (correlation of two pages of a group) that the moments may give; a prior is worth
#: two pages at least, so that no host is blocked for a single one.
SPREAD = (0.0001, 1 / 3)
#: Suffixes of more than one label, under which names are registered; the caller's list. All other
#: suffixes are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
            "com.br", "co.in", "co.kr", "co.za", "com.cn", "com.mx", "com.tr", "com.tw")
#: Hosts whose verdicts are sent to every executor; more are joined by a shuffle.
SMALL_HOSTS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``allow`` or ``block`` a host with all its subdomains below a path."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
    there up to ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def ruled(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Text of the longest rule that fits, or null. ``rules`` are a caller's list of some hundreds at most."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
            for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def families(host: Column, suffixes: Iterable[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port. Numeric addresses are domains of
    their own, in no suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    name = F.regexp_replace(name, r"\.+\z", "")
    address = name.rlike(r"\A[0-9.]+\z|\A\[")
    long = F.substring_index(name, ".", -2).isin(*suffixes)
    suffix = F.when(address, "").when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, suffix


def outcomes(labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``key, bad`` of every id that is labelled and not in two ways: bad is of low quality or toxic."""
    bad = F.when(F.col(toxic_col) == 1, 1).when(F.col(good_col).isin(0, 1), 1 - F.col(good_col))
    return (labels.select(F.col(id_col).cast("long").alias("key"), bad.cast("int").alias("bad")).where("key is not null and bad is not null")
            .groupBy("key").agg(F.min("bad").alias("bad"), F.max("bad").alias("most")).where("bad = most").drop("most"))


def _posterior(groups: DataFrame) -> DataFrame:
    """``groups`` (with ``n``, ``bad``, and ``pa``, ``pb`` of the group above) with the posterior's ``a`` and
    ``b``. A group's own pages are taken out of the group above first, so they count once; a prior is
    never surer than that rest. The spread is one number from one aggregate over all groups."""
    rest = F.col("pa") + F.col("pb") - F.col("n")
    named = groups.withColumn("m", (F.col("pa") - F.col("bad")) / rest).withColumn("rest", rest).drop("pa", "pb")
    n, bad, m = F.col("n"), F.col("bad"), F.col("m")
    extra = F.sum((bad - n * m) ** 2 - n * m * (1 - m))
    room = F.sum(n * (n - 1) * m * (1 - m))
    found = named.agg(F.when(room > 0, extra / room)).first()[0]
    spread = min(max(found if found is not None else SPREAD[0], SPREAD[0]), SPREAD[1])
    weight = F.least(F.lit(1 / spread - 1), F.col("rest"))
    return named.withColumn("a", weight * m + bad).withColumn("b", weight * (1 - m) + n - bad).drop("m", "rest")


def reputations(hosts: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """``host, domain, suffix, n, bad, a, b, low`` from ``host, n, bad`` (one row a host; a host without
    labelled pages has n = 0): its beta posterior and the lower bound of its share of bad pages.

    Without any labelled page the share is one half at the top and no bound exceeds ``LIMIT``.
    """
    domain, suffix = families(F.col("host"), suffixes)
    named = stage(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = named.agg(F.sum("n"), F.sum("bad")).first()
    n, bad = total[0] or 0, total[1] or 0

    def level(keys: list[str]) -> DataFrame:
        return named.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def above(groups: DataFrame, keys: list[str]) -> DataFrame:
        return _posterior(stage(groups)).select(*keys, F.col("a").alias("pa"), F.col("b").alias("pb"))

    by_suffix = above(level(["suffix"]).withColumn("pa", F.lit(bad + 1.0)).withColumn("pb", F.lit(n - bad + 1.0)), ["suffix"])
    by_domain = above(level(["suffix", "domain"]).join(by_suffix, "suffix"), ["suffix", "domain"])
    judged = _posterior(stage(named.join(by_domain, ["suffix", "domain"])))
    whole = F.col("a") + F.col("b")
    low = F.col("a") / whole - F.lit(SURE) * F.sqrt(F.col("a") * F.col("b") / (whole * whole * (whole + 1)))
    return judged.select("host", "domain", "suffix", "n", "bad", "a", "b", low.alias("low"))


def verdicts(pages: DataFrame, labelled: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url",
             suffixes: Iterable[str] = SUFFIXES, limit: float = LIMIT, small_hosts: int = SMALL_HOSTS) -> DataFrame:
    """``id, host, path, rule, verdict, low`` of every row of ``pages``.

    ``labelled`` holds ``key, bad`` (0 or 1), one row an id. The verdict is the action of the longest
    fitting rule, else the method's. A null or broken url has an empty host, which is judged like any
    other host; a null id has no label; every row counts, repeated ones too.
    """
    rules = list(rules)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    # A hot host is one row after the partial aggregates; ids meet labels before anything is grouped.
    counted = (rows.join(labelled.select(F.col("key").alias("id"), "bad"), "id").groupBy("host")
               .agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    hosts = stage(rows.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")).unionByName(counted)
                  .groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    known = stage(reputations(hosts, suffixes).select("host", "low"))
    few = known.limit(small_hosts + 1).count() <= small_hosts
    rule = ruled(F.col("host"), F.col("path"), rules)
    actions = [F.when(F.col("rule") == r.text, F.lit(r.action)) for r in rules]
    method = F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(F.broadcast(known) if few else known, "host").withColumn("rule", rule)
            .select("id", "host", "path", "rule", F.coalesce(*actions, method).alias("verdict"), "low"))
