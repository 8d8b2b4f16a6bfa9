"""URL filters by a Bloom filter cascade over the corpus's own key universe.

A key is a host suffix on label bounds. The first level of the cascade encodes the listed hosts; each further level encodes
the keys that pass all levels so far but shouldn't, taken from all distinct keys that the corpus can ask for, until none is
left. The cascade is then exact for every key of the corpus, so that no join is needed to judge an url: the number of the
first level that rejects a key tells if it is listed. Nothing else knows the list where urls are judged.

Levels are made by distributed bit_or aggregation; what is gathered and sent to executors is the filters' words, whose size
follows the listed keys that occur (about 16 bits each), not the corpus. Where a level would pass MAX_FILTER_BITS, all urls
are judged by a join of their distinct keys with the list instead, to the same result.

A few rules (host and path prefix, longest wins) come before the list; they are compared one by one.

Defined cases: null urls and urls without "://" have an empty host and path, fit no rule and are allowed; a rule may have an
empty path; of rules that fit the longest host and path wins; null and empty listed hosts count for nothing; repeated rows
each get their own row. Keys are told apart by 128-bit hashes.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared
from tracewright.llm.words import mix

BITS_PER_KEY, HASHES, MAX_FILTER_BITS = 12, 3, 1 << 31
_LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  #: "allow" or "block"


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))
#: The registered query's list of hosts, one a line, blocked with all their subdomains where no rule fits.
BLOCKED_FILE = os.path.join(os.path.dirname(__file__), "blocked_hosts.txt")


def blocked_hosts(spark: SparkSession, path: str = BLOCKED_FILE) -> DataFrame:
    """The list as a table (column host). Read here: a package's files needn't lie where executors can read."""
    with open(path, encoding="utf-8") as f:
        hosts = [h.strip() for h in f if h.strip() and not h.startswith("#")]
    return spark.createDataFrame([(h,) for h in hosts], "host string")


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def rule_of(host: str, path: str, rules: Iterable[Rule]) -> Rule | None:
    """The longest rule that fits the host or a parent of it and the start of the path."""
    fit = (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def hashed(keys: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every key."""
    both = [xxhash.xxh3_128_intdigest(k) for k in keys]
    return np.array([x >> 64 for x in both], dtype=np.uint64), np.array([x & (1 << 64) - 1 for x in both], dtype=np.uint64)


class Level(NamedTuple):
    bits: np.ndarray  #: uint64 words
    size: int
    seed: int

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = mix(hashes + np.uint64(self.seed + 1) * np.uint64(0x9E3779B97F4A7C15))
            step = mix(a) | np.uint64(1)
            return np.stack([(a + np.uint64(k) * step) >> np.uint64(7) for k in range(HASHES)]) % np.uint64(self.size)

    def has(self, hashes: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for p in self.positions(hashes) if more is None else self.positions2(hashes, more):
            found &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


    def positions2(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Positions that depend on all 128 bits."""
        return self.positions(h ^ mix(g + np.uint64(self.seed)))


def first_rejecting(levels: list[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Index of the first level that rejects each key; the number of levels where none does."""
    at = np.full(len(h), len(levels), dtype=np.int64)
    live = np.arange(len(h))
    for i, level in enumerate(levels):
        ok = level.has(h[live], g[live])
        at[live[~ok]] = i
        live = live[ok]
    return at


def listed(levels: list[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe: levels 1, 3, ... hold keys that aren't listed, so a first rejection there means listed.

    A key that all levels pass is in the last one's own set: listed where that is an even level.
    """
    return first_rejecting(levels, h, g) % 2 == 1


_KEY = "h long, g long"


def _level(keys: DataFrame, seed: int) -> Level | None:
    """A filter of the distinct keys (columns h, g), put together by bit_or on the executors; None beyond MAX_FILTER_BITS."""
    size = max(64, 1 << math.ceil(math.log2(max(1, keys.count() * BITS_PER_KEY))))
    if size > MAX_FILTER_BITS:
        return None
    empty = Level(np.zeros(size // 64, dtype=np.uint64), size, seed)

    def words(batches):
        for b in batches:
            p = empty.positions2(*(c.to_numpy().view(np.uint64) for c in b.columns)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    got = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most size / 64 rows
    empty.bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return empty


def build_cascade(universe: DataFrame, listed_keys: DataFrame) -> list[Level] | None:
    """Levels over the universe's distinct keys (columns h, g); listed_keys outside it are left out. None beyond MAX_FILTER_BITS.

    Even levels hold listed keys that pass so far, odd ones the false positives. The universe is read once per level, less
    each time; only filters reach the driver. Levels shrink by their false positives' share, so there is no bound on them.
    """
    folder = shared.work_folder(universe.sparkSession)
    yes = shared.staged(listed_keys.distinct().join(universe, ["h", "g"], "left_semi"), folder, "level-1")
    no = shared.staged(universe.join(listed_keys, ["h", "g"], "left_anti"), folder, "level0")
    levels: list[Level] = []
    while True:
        level = _level(yes, len(levels))
        if level is None:
            return None
        levels.append(level)

        def passing(batches, level=level):
            for b in batches:
                yield b.filter(pa.array(level.has(*(c.to_numpy().view(np.uint64) for c in b.columns))))

        left = shared.staged(no.mapInArrow(passing, _KEY), folder, f"level{len(levels)}")
        if left.isEmpty():
            return levels
        yes, no = left, yes


def key_hashes(table: DataFrame, keys_of: Callable[[str | None], Iterable[str]]) -> DataFrame:
    """Distinct hashes (h, g) of the keys of a table's only column."""

    def hashes(batches):
        for b in batches:
            seen = {k for v in b.column(0).to_pylist() for k in keys_of(v)}
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in hashed(seen)], names=["h", "g"])

    return table.mapInArrow(hashes, _KEY).distinct()


_PARTS = "page_id long, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, blocked: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of every url: of the rule that fits, else block where the host or a parent of it is in blocked (column host).

    The cascade alone tells if a host is listed. The result has one row per input row and needs no join.
    """
    spark = pages.sparkSession
    rules = tuple(rules)
    blocked = blocked_hosts(spark) if blocked is None else blocked
    chosen = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    asked = key_hashes(chosen.select("url"), lambda u: suffixes(host_and_path(u)[0]))
    folder = shared.work_folder(spark)
    universe = shared.staged(asked, folder, "universe")
    wanted = key_hashes(blocked.select(F.col("host").cast("string")), lambda h: [h.translate(_LOWER)] if h else [])
    levels = build_cascade(universe, wanted)
    sent = None if levels is None else spark.sparkContext.broadcast([tuple(x) for x in levels])

    def rows(batches):
        cascade = sent and [Level(*x) for x in sent.value]
        for b in batches:
            parts = [host_and_path(u) for u in b.column(1).to_pylist()]
            rule = [rule_of(h, p, rules) for h, p in parts]
            keys = [suffixes(h) for h, _ in parts]
            first = np.cumsum([0] + [len(ks) for ks in keys])
            h, g = hashed(k for ks in keys for k in ks)
            out = [
                b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([r and r.host + r.path for r in rule], pa.string()), pa.array([r and r.verdict for r in rule], pa.string()),
            ]
            if cascade is None:
                out += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.view(np.int64))) for x in (h, g)]
            else:
                hits = np.concatenate([[0], np.cumsum(listed(cascade, h, g))])
                out.append(pa.array(hits[first[1:]] > hits[first[:-1]]))
            yield pa.RecordBatch.from_arrays(out, names=names)

    if sent is not None:
        names = [*_NAMES, "listed"]
        found = chosen.mapInArrow(rows, _PARTS + ", listed boolean")
    else:
        names = [*_NAMES, "hs", "gs"]
        each = shared.staged(chosen.mapInArrow(rows, _PARTS + ", hs array<long>, gs array<long>").withColumn("row", F.monotonically_increasing_id()), folder, "asked")
        keys = each.select("row", F.explode(F.arrays_zip("hs", "gs")).alias("k")).select("row", F.col("k.hs").alias("h"), F.col("k.gs").alias("g"))
        hit = keys.join(wanted, ["h", "g"], "left_semi").select("row").distinct().withColumn("listed", F.lit(True))
        found = each.drop("hs", "gs").join(hit, "row", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


_NAMES = ("page_id", "host", "path", "rule", "verdict")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "pages"))


def _fits(host: str, path: str) -> str:
    return f"((parts.host = '{host}' OR ends_with(parts.host, '.{host}')) AND starts_with(path, '{path}'))"


with open(BLOCKED_FILE, encoding="utf-8") as _f:
    _LISTED = ", ".join(f"('{h.strip()}')" for h in _f if h.strip() and not h.startswith("#"))

OP5_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), blocked AS (
  SELECT * FROM (VALUES {_LISTED}) AS t(name)
), hit AS (
  SELECT DISTINCT host FROM (SELECT DISTINCT host FROM parts) AS h JOIN blocked ON host = name OR ends_with(host, '.' || name)
), ruled AS (
  SELECT parts.*, hit.host IS NOT NULL AS listed,
         CASE {" ".join(f"WHEN {_fits(r.host, r.path)} THEN '{r.host}{r.path}'" for r in sorted(RULES, key=lambda r: -len(r.host + r.path)))} END AS rule
  FROM parts LEFT JOIN hit ON parts.host = hit.host
)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in RULES)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
