"""URL allow and block lists as a trie over reversed host labels, then path segments.

A rule ends at a node of host labels and whole path segments, with a rest that its last, partial segment
must start with. A URL walks down its labels from the top domain, and at each host node down its path
segments; of all rules passed the longest match wins, whether it allows or blocks.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path (with its first slash), verdict


def host_of(url: Column) -> Column:
    """From the first :// to the next slash, question mark, hash or the end, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, a hash or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nested dicts; a node's rules stand under None as {rest of the last segment: (rule, verdict)}."""

    def __init__(self, rules: Iterable[Rule]):
        self.top: dict = {}
        for host, path, verdict in rules:
            node = self.top
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[rest] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict of the longest match: the deepest host first, then the longest path."""
        node, best, segments = self.top, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            here, found = node.get("/"), None
            for segment in segments:
                if here is None:
                    break
                fits = [(len(rest), own) for rest, own in here.get(None, {}).items() if segment.startswith(rest)]
                found = max(fits)[1] if fits else found
                here = here.get(segment)
            best = found or best
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", most_rules: int = 1_000_000) -> DataFrame:
    """``pages`` (page_id and url; other columns are left out) with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's, character by character.
    The longest match wins; of two rules with one host and path, the one that comes later. Where no rule fits,
    rule is null and verdict is ``default``. A null url, or one without ://, has an empty host and path.
    Repeated rows give repeated results; no rules or an empty table are no special case.

    The trie is broadcast up to most_rules; beyond, hosts' suffixes and paths' prefixes are joined with a table of rules.
    """
    located = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if len(rules) > most_rules:
        return _judge_by_join(located, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return located.withColumn("found", walk("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")


def _judge_by_join(located: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by equality of host suffix and of the path's prefix, for the lengths that rules' paths have."""
    spark = located.sparkSession
    ordered = [(host, path, verdict, i) for i, (host, path, verdict) in enumerate(rules)]
    table = spark.createDataFrame(ordered, "rule_host string, rule_path string, rule_verdict string, place int")
    table = table.groupBy("rule_host", "rule_path").agg(F.max_by("rule_verdict", "place").alias("rule_verdict"))
    lengths = F.array(*[F.lit(x) for x in sorted({len(path) for _, path, _, in rules})])
    labels = F.split("host", r"\.")
    places = located.select("host", "path").distinct()
    keys = places.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    keys = keys.withColumn("prefix_length", F.explode(F.filter(lengths, lambda x: x <= F.length("path")))).withColumn("prefix", F.expr("left(path, prefix_length)"))
    hits = keys.join(table, (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length("rule_host"), F.length("rule_path")))
    out = located.join(hits.groupBy("host", "path").agg(best.alias("found")), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
