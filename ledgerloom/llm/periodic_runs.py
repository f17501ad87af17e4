"""Periodic runs of words: a harmonic grid of (period, place) pairs and prefix hashes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let, small_parts, words_of

#: Pairs of (period, grid point) that are searched at a time.
PAIRS = 1 << 20
#: Odd base of the prefix hashes, which are polynomials modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1

RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, runs array<{RUN_TYPE}>, text string"
RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


@dataclass(frozen=True)
class RunRule:
    """A stretch counts from ``least`` words and ``times`` periods on."""

    least: int = 24
    times: int = 3

    def shortest(self, period):
        return np.maximum(self.least, self.times * period)

    def step(self, period):
        """Distance of grid points: so many places in a row match their word a period on,
        at least, in any run of that period, so that one of them is a grid point."""
        return self.shortest(period) - period


class PrefixHashes:
    """Hashes of all prefixes of the words of one or more texts, for equality of stretches."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        self.power = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), BASE, np.uint64), out=self.power[1:])
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mixed * self.power[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, to_a: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Are the words from ``a`` to ``to_a`` those one period on?"""
        here = (self.sums[to_a] - self.sums[a]) * self.power[period]
        return here == self.sums[to_a + period] - self.sums[a + period]

    def extents(self, at: np.ndarray, period: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest [low, high) around each ``at`` in which words equal those a period
        on, by binary search over all pairs at once; within [first, end - period)."""
        low, most = np.zeros_like(at), end - period - at
        while (open_ := low < most).any():
            mid = (low + most + 1) >> 1
            same = self.equal(at, at + mid, period)
            low, most = np.where(same & open_, mid, low), np.where(same | ~open_, most, mid - 1)
        high = at + low
        low, most = np.zeros_like(at), at - first
        while (open_ := low < most).any():
            mid = (low + most + 1) >> 1
            same = self.equal(at - mid, at, period)
            low, most = np.where(same & open_, mid, low), np.where(same | ~open_, most, mid - 1)
        return at - low, high


def grid(bounds: np.ndarray, rule: RunRule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, first, end) of all pairs, in parts of about ``PAIRS``.

    A text of n words has n / step(p) grid points of each period p up to n / 3: about
    n ln n together.
    """
    firsts, ends, periods = [], [], []
    for first, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = end - first
        if n >= rule.least:
            p = np.arange(1, n // rule.times + 1)
            periods.append(p)
            firsts.append(np.full(len(p), first))
            ends.append(np.full(len(p), end))
    if not periods:
        return
    period, first, end = np.concatenate(periods), np.concatenate(firsts), np.concatenate(ends)
    step = rule.step(period)
    many = -(-(end - first - period) // step)
    before = np.cumsum(many) - many
    cuts = [*np.flatnonzero(np.diff(before // PAIRS, prepend=-1)), len(many)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        row = np.repeat(np.arange(a, b), many[a:b])
        turn = np.arange(before[a], before[a] + len(row)) - before[row]
        yield first[row] + turn * step[row], period[row], first[row], end[row]


def verified(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    return bool(np.array_equal(ids[start : end - period], ids[start + period : end]))


def exact_extent(ids: np.ndarray, at: int, period: int, first: int, end: int) -> tuple[int, int]:
    """What ``extents`` finds, from the words themselves."""
    high, low = at, at
    while high < end - period and ids[high] == ids[high + period]:
        high += 1
    while low > first and ids[low - 1] == ids[low - 1 + period]:
        low -= 1
    return low, high


def find_runs(ids: np.ndarray, bounds: np.ndarray, rule: RunRule = RunRule()) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of all texts, sorted; ``bounds`` are the texts'
    ends in ``ids``, with 0 before.

    Pairs whose own words differ lie in no run.  Stretches that the hashes find are
    verified by their words; where a hash misled, the words decide.  A stretch has one
    period: if it also has a larger one of its runs, that is a multiple of the smallest,
    as it is at least their sum long.
    """
    hashes = PrefixHashes(ids)
    found: set[tuple[int, int, int]] = set()
    seeds: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for at, period, first, end in grid(bounds, rule):
        hit = ids[at] == ids[at + period]
        at, period, first, end = at[hit], period[hit], first[hit], end[hit]
        low, high = hashes.extents(at, period, first, end)
        long = high + period - low >= rule.shortest(period)
        stretches = np.stack([low[long], (high + period)[long], period[long]], axis=1)
        unique, index = np.unique(stretches, axis=0, return_index=True)
        origin = np.flatnonzero(long)[index]
        for stretch, k in zip(map(tuple, unique.tolist()), origin.tolist(), strict=True):
            seeds.setdefault(stretch, (int(at[k]), int(first[k]), int(end[k])))
    smallest: dict[tuple[int, int], int] = {}
    for (start, stop, period), (at, first, end) in sorted(seeds.items()):
        known = smallest.get((start, stop))
        if known is not None and period % known == 0:
            continue
        if not verified(ids, start, stop, period):
            low, high = exact_extent(ids, at, period, first, end)
            start, stop = low, high + period
            if stop - start < rule.shortest(period):
                continue
        smallest[start, stop] = min(period, smallest.get((start, stop), period))
    found.update((start, stop, period) for (start, stop), period in smallest.items())
    return sorted(found)


def collapsed(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        steps[start + period] += 1
        steps[end] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def runs_of_texts(texts: Sequence[list[bytes]], rule: RunRule) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of each text's runs, by start, then period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    bounds = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, int(bounds[-1]))
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(ids, bounds, rule)
    of_text = np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1
    for k, (start, end, period) in zip(of_text.tolist(), runs, strict=True):
        own[k].append((start - int(bounds[k]), end - int(bounds[k]), period))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in own]


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule()) -> DataFrame:
    """doc_id, runs and the text without its repeats, for every document.

    ``runs`` has (start, length, period) in words by start, then period; ``text`` has the
    words that no run holds after its first period, joined by one space.  Words are what
    ASCII white space separates; null, empty and blank texts have none, so no run and an
    empty text.  Documents are independent: whole texts are read in the task that scans
    them, a few MB (or one text) at a time, and nothing is shuffled.  Repeated rows give
    a row each, an empty table none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            found = runs_of_texts(texts, rule)
            runs = [[{"start": s, "length": e - s, "period": p} for s, e, p in own] for own in found]
            left = [b" ".join(collapsed(words, own)).decode() for words, own in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, RUNS), pa.array(left, pa.string())], names=["doc_id", "runs", "text"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def repeated_parts(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth id by hash repeats a part to its end.

    Such texts keep their words, joined by one space.  A null id and a text without words
    repeat nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        rest = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), rest), " "))

    text = F.when(h % 10 == 0, let(words_of(F.col("text")), repeat)).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the largest exact length / period (the first of equals),
    and hashes of all runs and of the text that is left."""
    fuller = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUN_TYPE), lambda best, r: F.when(fuller(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    with_best = found.withColumn("best", best)
    return with_best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
