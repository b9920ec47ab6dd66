"""URL rules by Bloom filter cascades, with DataFrame functions only.

A rule is a host and a path prefix, written as one string (``net/``); it fits
the host and all its subdomains where the url's path starts with the prefix.
Every url has a few candidate rules: each suffix of its host with each path
prefix of a length that some rule has. A cascade says exactly which candidates
are listed: level 0 encodes the listed rules, level 1 the other candidates of
the whole table that pass level 0, level 2 the listed rules that pass level 1,
and so on until none is left. As the levels cover every candidate in the
table, the answer is exact, and a url is judged without a join.

Size. Level 0 is sized so that about as many candidates pass it as there are
rules; all levels together are of the order of the rule list, and grow with
the logarithm of the table only. ``most_bits`` bounds a level; a longer rule
list raises.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Array of structs (key, host_length) of the rules that could fit."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    prefixes = F.filter(F.array(*[F.struct(F.lit(x).alias("size"), F.substring(path, 1, x).alias("text"))
                                  for x in lengths]), lambda p: F.length(p["text"]) == p["size"])
    both = F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(
        F.concat(h, p["text"]).alias("key"), F.length(h).alias("host_length"))))
    return F.when(F.length(host) > 0, F.flatten(both)).otherwise(
        F.array().cast("array<struct<key:string,host_length:int>>"))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    probes: int
    data: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits))
                for i in range(self.probes)]

    def passes(self, key: Column) -> Column:
        table, ok = F.lit(self.data), F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(table, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))),
                          16, 10).cast("int")
            bit = F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int"))
            ok = ok & (bit.bitwiseAND(1) == 1)
        return ok


def _level(keys: DataFrame, number: int, bits: int, probes: int, most_bits: int) -> Level:
    bits = max(64, 64 * math.ceil(bits / 64))
    if bits > most_bits:
        raise ValueError(f"level {number} needs {bits} bits; the bound is {most_bits}")
    empty = Level(number, bits, probes, b"")
    rows = (keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
            .groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                          F.col("at").bitwiseAND(63).cast("int"))).alias("set"))
            .collect())  # bits / 64 rows at most
    data = bytearray(bits // 8)
    for r in rows:
        data[8 * r["word"]:8 * r["word"] + 8] = (r["set"] & ((1 << 64) - 1)).to_bytes(8, "little")
    return Level(number, bits, probes, bytes(data))


def cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> list[Level]:
    """Levels for ``listed`` (key) that are exact on ``universe`` (key,
    distinct)."""
    listed = listed.distinct()
    r, s = listed.count(), universe.count()
    if not r:
        return []
    rate = min(0.5, math.sqrt(0.5) * r / max(s, 1))
    probes = max(1, round(math.log2(1 / rate)))
    levels = [_level(listed, 0, math.ceil(r * probes / math.log(2)), probes, most_bits)]
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    while True:
        # the keys of the other kind that the last level lets through
        odd = len(levels) % 2 == 1
        wrong = materialize((outside if odd else inside).filter(levels[-1].passes(F.col("key"))), "cascade")
        n = wrong.count()
        if not n:
            return levels
        inside, outside = (inside, wrong) if odd else (wrong, outside)
        levels.append(_level(wrong, len(levels), math.ceil(n / math.log(2)), 1, most_bits))


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the cascade's universe."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(level.passes(key), answer).otherwise(F.lit(level.number % 2 == 1))
    return answer


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow",
               most_bits: int = MOST_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The longest fitting rule (host and path together; of equally long ones
    that with the longer host) gives the verdict, else ``default`` and a null
    rule. A null url, or one without ``://``, has an empty host and path and
    fits no rule. Rows that repeat a page_id are judged one by one; an empty
    table gives no rows; other columns are not used.
    """
    spark = pages.sparkSession
    if len({r.key for r in rules}) < len(rules) or any(r.path and r.path[0] != "/" or not r.host or "/" in r.host for r in rules):
        raise ValueError("rules must be distinct, with a host and a path that starts with /")
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    if not lengths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    found = split.withColumn("candidates", candidates(F.col("host"), F.col("path"), lengths))
    universe = materialize(found.select(F.explode("candidates.key").alias("key")).distinct(), "url-keys")

    def fitting(verdict: str) -> Column:
        keys = [(r.key,) for r in rules if r.verdict == verdict]
        levels = cascade(spark.createDataFrame(keys, "key string"), universe, most_bits)
        return F.transform(
            F.filter("candidates", lambda c: is_listed(levels, c["key"])),
            lambda c: F.struct(F.length(c["key"]).alias("size"), c["host_length"],
                               c["key"].alias("rule"), F.lit(verdict).alias("verdict")))

    hits = [fitting(v) for v in sorted({r.verdict for r in rules})]
    best = found.withColumn("best", F.array_max(F.concat(*hits)))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
