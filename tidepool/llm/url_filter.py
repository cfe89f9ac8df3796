"""URL rules and lists, told by cascades of Bloom filters; DataFrame functions only.

A cascade is exact for the keys it was built over. Level 1 holds the listed keys. Some keys of the corpus that are not
listed pass it: level 2 holds those. Some listed keys pass level 2: level 3 holds those, and so on until a level has nothing to
hold. A key is listed if the first level that it does not pass is even (or none is left, after an odd one). Level 1 is so wide that
about as many unlisted keys pass it as there are listed ones; the size of all levels therefore follows the list and the logarithm of
the corpus's number of keys, and is checked: MOST_WORDS, 8 MB for each level, is enough for some millions of hosts. Membership of a page's keys
needs no join: each filter is one array literal of the plan. Building does join the list with the universe, both as tables.

The universe is all distinct keys the corpus has in the shapes that the lists use. A shape is (labels of the host, characters of the
path), so a page has as many keys as there are shapes, however long its host or path.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialize

#: Words of 64 bits that a level may have.
MOST_WORDS = 1 << 20
#: Bits of a key in its word.
HASHES = 6


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass
class Level:
    """A blocked Bloom filter: a key's bits are all in one word, so that a test reads one word."""

    words: list[int]
    seed: int = 0

    def passes(self, key: Column) -> Column:
        word, mask = place(key, len(self.words), self.seed)
        # one constant once the plan is optimised, however many words
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.element_at(words, word + 1).bitwiseAND(mask) == mask


def place(key: Column, words: int, seed: int) -> tuple[Column, Column]:
    """The key's word, and its bits there."""
    bits = F.xxhash64(key, F.lit(2 * seed + 2))
    one = F.lit(1).cast("long")
    mask = one.bitwiseAND(F.lit(0))
    for k in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(words)).cast("int"), mask


def false_rate(keys_per_word: float) -> float:
    """The share of other keys that pass."""
    out, p = 0.0, math.exp(-keys_per_word)
    for n in range(1, int(keys_per_word * 4) + 40):
        p *= keys_per_word / n
        out += p * (1 - (1 - 1 / 64) ** (HASHES * n)) ** HASHES
    return out


def level_over(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the n keys of a DataFrame; its words, not the keys, come to the driver."""
    words = max(1, n // 8)
    while false_rate(n / words) > rate:
        words *= 2
    if words > MOST_WORDS:
        raise ValueError(f"a filter of {words} words; lists of this length need more than literals")
    word, mask = place(F.col("key"), words, seed)
    rows = keys.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    out = [0] * words
    for w, m in rows:
        out[w] = m
    return Level(out, seed)


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> "Cascade":
        """universe, listed: key. Listed keys that the universe lacks need no filter."""
        inside = materialize(listed.select("key").where("key IS NOT NULL").distinct().join(universe, "key", "left_semi"), "url-list")
        n = inside.count()
        if not n:
            return cls([])
        all_keys = universe.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(0.5, n * math.sqrt(0.5) / max(1, all_keys))
        outside = universe.join(inside, "key", "left_anti")
        levels = [level_over(inside, n, rate, 0)]
        # keys that passed all levels so far, by turns of the two sides
        sides = [outside, inside]
        while True:
            side = sides[(len(levels) + 1) % 2]
            for level in levels:
                side = side.where(level.passes(F.col("key")))
            n = side.count()
            if not n:
                return cls(levels)
            if len(levels) == 30:
                raise RuntimeError("the cascade does not end")
            levels.append(level_over(side, n, 0.2, len(levels)))

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return host, path


def key_of(shape: tuple[int, int]) -> Column:
    """The page's key in a shape; null where its host or path is too short."""
    labels, chars = shape
    long_enough = (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= chars) & (F.col("host") != "")
    return F.when(long_enough, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))


def as_keys(df: DataFrame, listed: Sequence[str] | DataFrame) -> DataFrame:
    """key: of a list, or of a table's column host."""
    if isinstance(listed, DataFrame):
        return listed.select(F.col("host").cast("string").alias("key"))
    return df.sparkSession.createDataFrame([(k,) for k in listed], "key string")


def judge_urls(df: DataFrame, rules: Sequence[Rule], blocklist: Sequence[str] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    The longest rule that fits gives the verdict; a rule fits its host and all subdomains, where the path starts with its path. Without
    a rule, a page is blocked if its host or a domain above it is in the blocklist (hosts, or a table of any size with a column host). Rules
    are few, as they are written by hand; hosts of any number of labels may be listed. Null urls and urls without `://`: empty host and path,
    no rule, allowed. Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    if len({r.key for r in rules}) < len(rules):
        raise ValueError("two rules for one host and path")
    host, path = parsed(F.col("url"))
    pages = df.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    shapes = sorted({r.shape for r in rules}, key=lambda s: (-s[0], -s[1]))
    hosts = as_keys(df, blocklist)
    # as many numbers as hosts have labels
    list_shapes = sorted((r.n, 0) for r in hosts.where("key IS NOT NULL").select(F.size(F.split("key", r"\.")).alias("n")).distinct().collect())
    key_columns = [key_of(s) for s in dict.fromkeys([*shapes, *list_shapes])]
    universe = pages.select(F.explode(F.array_compact(F.array(*key_columns))).alias("key")).distinct() if key_columns else pages.select(F.col("host").alias("key")).limit(0)
    universe = materialize(universe, "url-keys")
    verdicts = sorted({r.verdict for r in rules})
    cascades = {v: Cascade.build(universe, as_keys(df, [r.key for r in rules if r.verdict == v])) for v in verdicts}
    listed = Cascade.build(universe, hosts)

    named = pages.select("*", *[key_of(s).alias(f"_k{i}") for i, s in enumerate(shapes)], *[key_of(s).alias(f"_d{i}") for i, s in enumerate(list_shapes)])
    none = F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    found = []
    for i in range(len(shapes)):
        key = F.col(f"_k{i}")
        for v in verdicts:
            found.append(F.when(key.isNotNull() & cascades[v].holds(key), F.struct(F.length(key).alias("n"), key.alias("key"), F.lit(v).alias("verdict"))))
    blocked = F.lit(False)
    for i in range(len(list_shapes)):
        blocked = blocked | F.coalesce(listed.holds(F.col(f"_d{i}")) & F.col(f"_d{i}").isNotNull(), F.lit(False))
    best = F.array_max(F.array(none, *found))
    return named.select("page_id", "host", "path", best.alias("_best"), blocked.alias("_blocked")).select(
        "page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce(F.col("_best.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict")
    )
