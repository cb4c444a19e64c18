"""Cache policies over access logs. One log is sequential, so runs are parallel over configurations, not within one."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("lru", "lfu", "gdsf", "slru")
#: Share of the capacity that SLRU protects, and the range it is held to.
PROTECTED, PROTECTED_RANGE = 0.8, (0.05, 0.95)
#: Accesses of a block in which reuse distances are counted, and blocks at most.
BLOCK, MOST_BLOCKS = 200_000, 1000


@dataclass
class Entry:
    size: int
    cost: float
    hits: int = 1
    used: int = 0
    value: float = 0.0
    protected: bool = False
    version: int = 0


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    bytes_fetched: int = 0
    fetch_seconds: float = 0.0

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


@dataclass
class Cache:
    """A cache of (layer, expert) keys under one of POLICIES.

    The victim is the entry that comes first by (segment, score, key): by last use (lru; slru within a segment, probation
    first), by hits (lfu), or by clock + hits * cost / size, where the clock is the largest value evicted (gdsf). Victims
    come from heaps whose outdated entries are skipped, so an access costs a logarithm, not a scan.
    """

    capacity: int
    policy: str = "gdsf"
    protected_share: float = PROTECTED
    entries: dict = field(default_factory=dict)
    pinned: set = field(default_factory=set)
    stats: Stats = field(default_factory=Stats)
    used: int = 0
    clock: int = 0
    floor: float = 0.0
    protected_used: int = 0
    heap: list = field(default_factory=list)
    safe: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        self.protected_share = min(max(self.protected_share, PROTECTED_RANGE[0]), PROTECTED_RANGE[1])

    def __contains__(self, key) -> bool:
        return key in self.entries

    def __len__(self) -> int:
        return len(self.entries)

    def _score(self, e: Entry) -> float:
        return {"lru": e.used, "slru": e.used, "lfu": e.hits, "gdsf": e.value}[self.policy]

    def _touch(self, key, e: Entry) -> None:
        e.version += 1
        e.value = self.floor + e.hits * e.cost / max(e.size, 1)
        heapq.heappush(self.safe if e.protected else self.heap, (self._score(e), key, e.version, e))

    def _pop(self, heap: list):
        kept = []
        found = None
        while heap:
            item = heapq.heappop(heap)
            _, key, version, e = item
            if self.entries.get(key) is not e or e.version != version:
                continue
            if key in self.pinned:
                kept.append(item)
                continue
            found = key
            break
        for item in kept:
            heapq.heappush(heap, item)
        return found

    def _make_room(self, size: int) -> bool:
        while self.used + size > self.capacity:
            key = self._pop(self.heap)
            if key is None:
                key = self._pop(self.safe)
            if key is None:
                return False
            e = self.entries.pop(key)
            if self.policy == "gdsf":
                self.floor = max(self.floor, e.value)
            self.used -= e.size
            self.protected_used -= e.size if e.protected else 0
            self.stats.evictions += 1
        return True

    def _insert(self, key, size: int, cost: float) -> None:
        e = self.entries[key] = Entry(size, cost, used=self.clock)
        self.used += size
        self._touch(key, e)

    def _demote(self) -> None:
        limit = self.protected_share * self.capacity
        while self.protected_used > limit:
            top = None
            while self.safe:
                _, key, version, e = self.safe[0]
                if self.entries.get(key) is e and e.version == version and e.protected:
                    top = key, e
                    break
                heapq.heappop(self.safe)
            if top is None:
                return
            heapq.heappop(self.safe)
            key, e = top
            e.protected = False
            self.protected_used -= e.size
            self._touch(key, e)

    def access(self, key, size: int, cost: float) -> bool:
        """A use of the key; True for a hit. What doesn't fit is served and not kept."""
        self.clock += 1
        e = self.entries.get(key)
        if e is not None:
            self.stats.hits += 1
            e.hits += 1
            e.used = self.clock
            if self.policy == "slru" and not e.protected:
                e.protected = True
                self.protected_used += e.size
            self._touch(key, e)
            if self.policy == "slru":
                self._demote()
            return True
        self.stats.misses += 1
        self.stats.bytes_fetched += size
        self.stats.fetch_seconds += cost
        if size <= self.capacity and self._make_room(size):
            self._insert(key, size, cost)
        return False

    def prefetch(self, key, size: int, cost: float) -> bool:
        """Puts the key in without counting a hit or a miss; True if it was put in."""
        if key in self.entries or size > self.capacity or not self._make_room(size):
            return False
        self.clock += 1
        self._insert(key, size, cost)
        return True

    def pin(self, key, size: int, cost: float = 0.0) -> bool:
        """Holds the key, putting it in if need be; False if there is no room for it."""
        if key not in self.entries:
            if size > self.capacity or not self._make_room(size):
                return False
            self._insert(key, size, cost)
        self.pinned.add(key)
        return True

    def unpin(self, key) -> None:
        self.pinned.discard(key)


RESULT = "policy string, capacity long, protected_share double, hits long, misses long, evictions long, bytes_fetched long, fetch_seconds double, hit_rate double"


def simulate(log: DataFrame, configs: DataFrame, count_from: int = 0) -> DataFrame:
    """Runs every configuration (policy, capacity, protected_share) over a log (seq, key, bytes, cost).

    Results count accesses from seq count_from on, after the ones before have warmed the cache. Each configuration is a
    task of its own, which streams the log in order in Arrow batches: a log of one cache can't be split by key, because
    all keys share its capacity.
    """
    paired = _pair(log, configs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache, head, before = None, None, None, Stats()

        def result() -> pd.DataFrame:
            s = cache.stats
            hits, misses = s.hits - before.hits, s.misses - before.misses
            return pd.DataFrame([{**head, "hits": hits, "misses": misses, "evictions": s.evictions - before.evictions,
                "bytes_fetched": s.bytes_fetched - before.bytes_fetched, "fetch_seconds": s.fetch_seconds - before.fetch_seconds,
                "hit_rate": hits / (hits + misses) if hits + misses else 0.0}])

        for pdf in frames:
            for config, policy, capacity, share, seq, key, size, cost in zip(*[pdf[c] for c in ("config", "policy", "capacity", "protected_share", "seq", "key", "bytes", "cost")], strict=True):
                if config != now:
                    if now is not None:
                        yield result()
                    now, head, before = config, {"policy": policy, "capacity": capacity, "protected_share": share}, Stats()
                    cache = Cache(int(capacity), policy, float(share))
                if seq == count_from:
                    before = Stats(**vars(cache.stats))
                cache.access(key, int(size), float(cost))
        if now is not None:
            yield result()

    return paired.mapInPandas(run, RESULT)


def _pair(log: DataFrame, configs: DataFrame) -> DataFrame:
    """Every configuration with the whole log, in order: a partition per configuration."""
    listed = [r.asDict() for r in configs.collect()]  # a row per configuration that the caller asks for
    spark = log.sparkSession
    rows = [(i, c["policy"], int(c["capacity"]), float(c.get("protected_share") or PROTECTED)) for i, c in enumerate(listed)]
    grid = spark.createDataFrame(rows, "config int, policy string, capacity long, protected_share double")
    every = log.select(F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("config"), "seq", "key", "bytes", "cost")
    return every.join(F.broadcast(grid), "config").repartition(len(rows), "config").sortWithinPartitions("config", "seq")


def smaller_after(values: np.ndarray) -> np.ndarray:
    """How many later values are smaller, for each: halves of ever wider stretches are merged, all stretches at once."""
    n = len(values)
    out, at = np.zeros(n, np.int64), np.arange(n)
    order, width = np.argsort(values, kind="stable"), 1
    while width < n:
        pair = at // (2 * width)
        by = order[np.argsort(pair[order], kind="stable")]
        right = (at[by] // width) % 2 == 1
        seen = np.cumsum(right)
        first = np.flatnonzero(np.concatenate([[True], pair[by][1:] != pair[by][:-1]]))
        before = (seen - right)[first][pair[by]]
        out[by] += np.where(right, 0, seen - before)
        width *= 2
    return out


def reuse_distance(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, key, prev_seq, distance): distinct keys since the key's last use; null at its first. log: seq (0, 1, ...), key.

    Between a use and the one before it stand all accesses but those whose own next use comes before, too: intervals that
    lie inside. With seq cut into blocks, the inside ones that start in the same block are counted in one task per
    block, those that only end in the same block in another, and all others from the numbers of intervals by first and last
    block, a table of blocks squared. Blocks grow so that there are MOST_BLOCKS at most.
    """
    n = log.agg(F.max("seq")).head()[0]
    size = max(block, -(-((n or 0) + 1) // MOST_BLOCKS))
    prev = log.select("seq", "key", F.lag("seq").over(Window.partitionBy("key").orderBy("seq")).alias("prev_seq"))
    spans = prev.where("prev_seq IS NOT NULL").select("seq", "prev_seq", F.expr(f"prev_seq div {size}").alias("first"), F.expr(f"seq div {size}").alias("last"))

    def starting(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("prev_seq")
        return pdf.assign(inside=smaller_after(pdf["seq"].to_numpy()))

    def ending(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ascending=False)
        return pdf.assign(inside=pdf["inside"] + smaller_after(-pdf["first"].to_numpy()))

    schema = "seq long, prev_seq long, first long, last long, inside long"
    near = spans.groupBy("first").applyInPandas(starting, schema).groupBy("last").applyInPandas(ending, schema)
    cells = spans.groupBy("first", "last").agg(F.count(F.lit(1)).alias("n"))  # MOST_BLOCKS squared rows at most
    a, b = cells.select("first", "last").alias("a"), cells.alias("b")
    wide = a.where(F.col("a.last") > F.col("a.first") + 1).join(F.broadcast(b), (F.col("b.first") > F.col("a.first")) & (F.col("b.last") < F.col("a.last")))
    far = wide.groupBy("a.first", "a.last").agg(F.sum("b.n").alias("far"))
    counted = near.join(F.broadcast(far), ["first", "last"], "left")
    distance = F.col("seq") - F.col("prev_seq") - 1 - F.col("inside") - F.coalesce("far", F.lit(0))
    return prev.join(counted.select("seq", distance.alias("distance")), "seq", "left")


def lru_hits(log: DataFrame, slots: list[int]) -> DataFrame:
    """(slots, hits, misses, hit_rate) of LRU with room for that many equal entries, from reuse distances."""
    d = reuse_distance(log)
    cells = [F.struct(F.lit(s).alias("slots"), F.count(F.when(F.col("distance") < s, 1)).alias("hits"), F.count(F.lit(1)).alias("n")) for s in slots]
    return d.agg(F.array(*cells).alias("c")).select(F.inline("c")).select("slots", "hits", (F.col("n") - F.col("hits")).alias("misses"), (F.col("hits") / F.col("n")).alias("hit_rate"))


def offline_optimum(log: DataFrame, slots: list[int]) -> DataFrame:
    """(slots, hit_rate): the share of accesses that go to the most used keys, which a fixed set of entries serves at best."""
    counts = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # The few best keys are taken from partial orders, so no key table is sorted as a whole.
    out = None
    total = counts.agg(F.sum("n").alias("total"))
    for s in slots:
        top = counts.orderBy(F.desc("n"), "key").limit(s).agg(F.sum("n").alias("top"))
        one = top.join(F.broadcast(total)).select(F.lit(s).alias("slots"), (F.coalesce("top", F.lit(0)) / F.col("total")).alias("hit_rate"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
