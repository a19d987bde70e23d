"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's.
Every URL is expanded into expressions: a host suffix of whole labels joined to a path prefix, for just those (labels, length) shapes that some
rule has. An expression's SHA-256 is its digest; its first hex digits are the short prefix on which expressions meet the rules in an equi-join.
What meets is confirmed by the whole digest, so a shared prefix alone decides nothing. Of the rules that fit, the longest (host and path
together) wins, then the one with the longer host; of equal rules a block wins. Without a rule the verdict is `allow`.

Rows that share host and path are judged once. The rules travel as fixed-width rows (prefix, digest, verdict), so up to
BROADCAST_RULES of them, counted beforehand, are broadcast; more are shuffled by the prefix, where adaptive execution splits a prefix that very many
URLs have. The rule's text is read off the URL that it fits. Only the distinct shapes come to the driver: no more than the labels
times the length of the longest rule.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: what then follows up to `?`, `#` or the end. Ports and user names
belong to the host. A null URL, or one without `://`, has empty host and path, which no rule fits. Rules with a null or empty host or a verdict other than
allow and block are left out; a null path counts as empty. Repeated rows and null ids are rows like any other; URLs are taken whole; an empty table gives
no rows, and without rules all is allowed. The input row comes back whole in the struct `page`, so its columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000   # rows of about 60 bytes
PREFIX = 8                  # hex digits of the short prefix: 32 bits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffix(host: Column, labels: Column) -> Column:
    return F.array_join(F.slice(F.split(host, r"\.", -1), -labels, labels), ".")


def prepared(rules: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """prefix, digest, verdict, labels and length of each distinct rule of (host, path, verdict)."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    good = rules.where((F.length("host") > 0) & F.col("verdict").isin("allow", "block"))
    keyed = good.select(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256).alias("hex"), F.size(F.split(host, r"\.", -1)).alias("labels"),
                        F.length(path).alias("length"), "verdict")
    once = keyed.groupBy("hex", "labels", "length").agg(F.max("verdict").alias("verdict"))
    return once.select(F.substring("hex", 1, prefix).alias("prefix"), F.unhex("hex").alias("digest"), "labels", "length", "verdict")


def expressions(targets: DataFrame, shapes: list[tuple[int, int]], prefix: int = PREFIX) -> DataFrame:
    """host, path, labels, length, prefix and digest of each expression of (host, path) that has one of `shapes`."""
    kinds = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in shapes]).cast("array<struct<labels:int,length:int>>")
    able = F.filter(kinds, lambda s: (s["labels"] <= F.size(F.split("host", r"\.", -1))) & (s["length"] <= F.length("path")))
    each = targets.select("host", "path", F.explode(able).alias("s"))
    text = F.concat(_suffix(F.col("host"), F.col("s.labels")), F.lit("\n"), F.expr("substring(path, 1, s.length)"))
    hexed = each.select("host", "path", "s.labels", "s.length", F.sha2(text.cast("binary"), 256).alias("hex"))
    return hexed.select("host", "path", "labels", "length", F.substring("hex", 1, prefix).alias("prefix"), F.unhex("hex").alias("digest"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", prefix: int = PREFIX) -> DataFrame:
    """page (the input row), host, path, rule (null if none fits) and verdict of every row of pages."""
    host, path = host_and_path(url)
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"))
    known = prepared(rules, prefix)
    shapes = sorted(tuple(r) for r in known.select("labels", "length").distinct().collect())
    facts = known.select("prefix", "digest", "verdict")
    facts = F.broadcast(facts) if facts.count() <= BROADCAST_RULES else facts
    met = expressions(rows.select("host", "path").distinct(), shapes, prefix).join(facts, ["prefix", "digest"])
    order = F.struct((F.length(_suffix(F.col("host"), F.col("labels"))) + F.col("length")).alias("size"), "labels", "length", "verdict")
    found = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    rule = F.concat(_suffix(F.col("host"), F.col("best.labels")), F.expr("substring(path, 1, best.length)"))
    return rows.join(found, ["host", "path"], "left").select("page", "host", "path", F.when(F.col("best").isNotNull(), rule).alias("rule"),
                                                            F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
