"""URL filters: rules on hosts and paths, and exact membership of hosts by a cascade of Bloom filters.

Rules come first, the longest that fits. Where none fits, the host decides: it is blocked if it is listed. The list
is kept as a cascade of Bloom filters over the corpus's complete universe of hosts: the first encodes the listed
hosts, the second those other hosts that the first lets through, the third those listed that the second lets
through, and so on until none is. The first filter that a host fails tells exactly whether it is listed, and pages
need no join. All steps are DataFrame operations; filters are built from bitmaps that tasks combine.

The filters go to the tasks as literals, at most LIMIT bytes together. Where the list needs more, the same verdicts
come from a join of pages with the list on the host.

Cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed unless the empty host
is listed; repeated rows are judged one by one; no rules and no hosts are fine; other columns are not used.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written

#: Bytes that all filters of a cascade may take as literals.
LIMIT = 16 << 20
BITS_PER_KEY = 10
HASHES = 6
#: Levels after which a cascade gives up; each lets through about one key in a hundred.
LEVELS = 30

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """rule and verdict of the longest rule that fits, as a struct; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _bit(key: str, level: int, i: int, bits: int) -> Column:
    """The i-th bit of a key in the filter of a level."""
    return F.pmod(F.xxhash64(F.lit(level * HASHES + i), F.col(key)), F.lit(bits)).cast("long")


class BloomCascade(NamedTuple):
    """Filters, first to last, as bits; exact for the keys of the universe that it was built over."""

    filters: tuple[bytes, ...]

    def holds(self, key: str) -> Column:
        """Whether a key is listed."""
        out = F.lit(len(self.filters) % 2 == 1)
        for level in reversed(range(len(self.filters))):
            out = F.when(passes(self.filters[level], key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def passes(bits: bytes, key: str, level: int) -> Column:
    """Whether all bits of a key are set."""
    held, out = F.lit(bytearray(bits)), F.lit(True)
    for i in range(HASHES):
        at = _bit(key, level, i, 8 * len(bits))
        byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (F.call_function("getbit", byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    return out


def _filter(keys: DataFrame, count: int, level: int) -> bytes:
    """Bloom filter of the column key, in whole parts of 4096 bytes."""
    parts = max(1, -(-count * BITS_PER_KEY // 32768))
    own = keys.select(F.explode(F.array(*(_bit("key", level, i, parts * 32768) for i in range(HASHES)))).alias("bit"))
    rows = own.groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits")).collect()
    out = bytearray(parts * 4096)
    for r in rows:
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(out)


def bloom_cascade(universe: DataFrame, limit: int = LIMIT) -> BloomCascade | None:
    """Cascade of the distinct keys of a universe (columns key, listed); None if it needs more than limit bytes."""
    inside, outside = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    filters: list[bytes] = []
    for level in range(LEVELS):
        count = inside.count()
        if not count:
            return BloomCascade(tuple(filters))
        if sum(map(len, filters)) + count * BITS_PER_KEY // 8 > limit:
            return None
        filters.append(_filter(inside, count, level))
        through = written(outside.where(passes(filters[-1], "key", level)), "through")
        inside, outside = through, inside
    raise RuntimeError("the cascade did not end")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; listed: column host, the hosts to block where no rule fits."""
    ruled = _ruled(pages, rules)
    listed = listed.select(F.col("host").alias("key")).where("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    hosts = ruled.groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("one")).drop("one")
    universe = written(hosts.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    cascade = bloom_cascade(universe, limit)
    if cascade is None:
        known = ruled.join(universe.where("listed").select(F.col("key").alias("host"), "listed"), "host", "left")
        block = F.col("listed").isNotNull()
    else:
        known, block = ruled, cascade.holds("host")
    method = F.when(block, "block").otherwise("allow")
    return known.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", method).alias("verdict"))


def _ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = url_parts("url")
    return pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path")).withColumn("found", matched_rule(rules))


def hosts_blocked_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """host: those of which the rules block more pages than they allow."""
    side = F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", -1).otherwise(0)
    return _ruled(pages, rules).groupBy("host").agg(F.sum(side).alias("n")).where("n > 0").select("host")
