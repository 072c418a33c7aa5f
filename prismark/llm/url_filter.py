"""URL filters: host rules, and exact lists by a cascade of Bloom filters.

A cascade answers exactly for every key of a known universe. Level 1 holds the listed keys. Level 2 holds the other keys of
the universe that level 1 reports by mistake, level 3 the listed ones that level 2 reports by mistake, and so on until none
is. A key's answer is the parity of the first level that does not report it. Tests are expressions over the levels' bits,
which Spark fetches as scalar subqueries: no join, no Python.

A list is dealt by the keys' hashes over as many cascades as keep each level's bits below a bound; rows ask the cascade of
their key's shard, so a task holds the levels of one shard however long the list is.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import ascii_lower, materialise

HASHES = 5
#: Bits for each key of a level; 5 hashes then err on about one key in 40.
BITS_PER_KEY = 8
#: Listed keys of a shard, some: its first level then has 1 << 27 bits, 16 MB. The later ones, of keys reported by mistake, are smaller unless far fewer keys are listed than not; these are split as well.
SHARD_KEYS = 1 << 23
#: Other keys of a shard: one in 40 of them is reported by mistake and so in the second level.
SHARD_OTHERS = 40 * SHARD_KEYS


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or where there is no ://."""
    after = F.substring_index(_after_scheme(url), "/", 1)
    for stop in "?#":
        after = F.substring_index(after, stop, 1)
    return F.when(F.instr(url, "://") > 0, ascii_lower(after)).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or where there is no ://."""
    after = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(after, "/")
    return F.when((F.instr(url, "://") > 0) & (at > 0), after.substr(at, F.length(after))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A rule like example.org/es/: fits the host and its subdomains, on paths that start with its path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def rule_for(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = r.fits(host, path)
        name = F.when(fits, F.lit(r.text)) if name is None else name.when(fits, F.lit(r.text))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _places(key: Column, level: int, n_bits: int) -> list[Column]:
    """The bits of a key at a level: double hashing from two 64-bit hashes."""
    h1, h2 = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    # Masks keep sums in range: n_bits is a power of two.
    low = lambda x: x.bitwiseAND(F.lit(n_bits - 1))
    return [low(low(h1) + F.lit(i) * low(h2.bitwiseOR(F.lit(1)))) for i in range(HASHES)]


@dataclass
class Level:
    """One Bloom filter: its number of bits, and a frame of one row with the bits as an array of longs."""

    n_bits: int
    bits: DataFrame

    def reports(self, key: Column, level: int) -> Column:
        words = self.bits.scalar()
        yes = F.lit(True)
        for p in _places(key, level, self.n_bits):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            yes = yes & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return yes


def _bits_for(n: int) -> int:
    return max(64, 1 << (BITS_PER_KEY * n - 1).bit_length())


def _level(keys: DataFrame, n: int, level: int) -> Level:
    n_bits = _bits_for(n)
    bit = keys.select(F.explode(F.array(*_places(F.col("key"), level, n_bits))).alias("p"))
    set_bits = bit.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("x"))
    every = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    words = set_bits.unionByName(every).groupBy("w").agg(F.bit_or("x").alias("x"))
    # The one array has n_bits / 64 longs, MAX_BITS / 64 at most.
    array = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda e: e["x"]).alias("bits"))
    return Level(n_bits, materialise(array, f"level{level}"))


@dataclass
class Cascade:
    """Exact membership for the universe's keys."""

    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed; null keys are not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].reports(key, i), F.lit(i % 2 == 1)).otherwise(answer)
        return F.coalesce(F.when(key.isNotNull(), answer), F.lit(False))


def build_cascade(inside: DataFrame, outside: DataFrame, n: int, max_levels: int = 40) -> Cascade:
    """The levels for n distinct listed keys and the universe's other keys (column key of each)."""
    levels: list[Level] = []
    while n:
        if len(levels) == max_levels:
            raise ValueError(f"{n} keys are left after {max_levels} levels")
        levels.append(_level(inside, n, len(levels)))
        wrong = materialise(outside.where(levels[-1].reports(F.col("key"), len(levels) - 1)), f"reported{len(levels)}")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), F.coalesce(F.col(key), F.lit(""))), F.lit(shards))


def with_listed(rows: DataFrame, key: str, universe: DataFrame, listed: DataFrame, name: str = "listed") -> DataFrame:
    """rows with a boolean `name`: whether its key is listed. universe: (key) with every key of rows; listed: (key), any keys.

    Null keys are not listed. The list is joined with the universe once, to build the cascades; rows are not joined. Each
    shard reads the rows' keys once.
    """
    keys = universe.where("key is not null").select("key").distinct()
    listed = listed.where("key is not null").select("key").distinct().withColumn("listed", F.lit(True))
    keys = materialise(keys.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    n = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    shards = max(1, -(-n.get(True, 0) // SHARD_KEYS), -(-n.get(False, 0) // SHARD_OTHERS))
    parts = []
    for s in range(shards):
        mine = keys.where(_shard("key", shards) == s) if shards > 1 else keys
        inside, outside = mine.where("listed").select("key"), mine.where("not listed").select("key")
        cascade = build_cascade(inside, outside, inside.count())
        part = rows.where(_shard(key, shards) == s) if shards > 1 else rows
        parts.append(part.withColumn(name, cascade.lists(F.col(key))))
    return functools.reduce(DataFrame.unionByName, parts)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, listed.

    The longest rule that fits decides; without one, hosts among `listed` (column host, in lower case) are blocked and others
    allowed; all hosts of pages are the cascade's universe. A null url or one without :// has empty host and path, and so no
    rule. Null ids stay; repeated rows give repeated results; other columns are not read.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    out = with_listed(rows, "host", rows.select(F.col("host").alias("key")), listed.select(F.col("host").alias("key"))).withColumn("rule", rule)
    return out.select(id_col, "host", "path", "rule", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
