"""Line dedup: a sharded minimal perfect hash over the corpus's distinct lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CHARS, materialize, small_parts

#: Distinct lines that a shard of the index holds, about.
SHARD_KEYS = 1 << 15
#: Probes of one shard that a task answers at a time, about.
PROBES = 1 << 20

SHARD_SCHEMA = "shard bigint, words array<int>, bits binary, fingerprints binary, counts binary, width int"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about three bits a key.

    On each level keys are dealt over twice as many places as are left; those alone on
    theirs stay there as a set bit, the others go on to the next level.  A key's number
    is the number of set bits before its own.
    """

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        self.words, self.bits = words, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-2 * len(keys) // 64)
            place = (mixed(keys, len(levels)) % np.uint64(64 * size)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[place]]
        return cls(np.array([len(x) for x in levels], np.int32), np.concatenate([np.empty(0, np.uint64), *levels]))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, from 0 without a gap; -1 where no level has the key's bit.

        Other keys may get a number too: fingerprints tell them apart.
        """
        out, rest, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.words.tolist()):
            place = (mixed(keys[rest], level) % np.uint64(64 * size)).astype(np.int64)
            word, bit = base + (place >> 6), (place & 63).astype(np.uint64)
            here = self.bits[word]
            set_ = (here >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[set_]] = (self.before[word] + below)[set_]
            rest, base = rest[~set_], base + size
            if not len(rest):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Shard:
    """Counts of one shard's lines, by the perfect hash of their 64-bit hashes."""

    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Shard:
        hash_ = PerfectHash.of(keys)
        at = hash_.numbers(keys)
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max(initial=0) <= np.iinfo(t).max)
        prints, compact = np.empty(len(keys), np.uint32), np.empty(len(keys), width)
        prints[at], compact[at] = fingerprints(keys), counts
        return cls(hash_, prints, compact)

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key; 0 for one that the index hasn't."""
        at = self.hash.numbers(keys)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == fingerprints(keys[known])
        out = np.zeros(len(keys), np.int64)
        out[known] = self.counts[at[known]]
        return out

    def stored(self, shard: int) -> pa.Table:
        row = {
            "shard": shard,
            "words": self.hash.words.tolist(),
            "bits": self.hash.bits.tobytes(),
            "fingerprints": self.fingerprints.tobytes(),
            "counts": self.counts.tobytes(),
            "width": self.counts.itemsize,
        }
        types = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.table([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    @classmethod
    def read(cls, row: dict) -> Shard:
        hash_ = PerfectHash(np.array(row["words"], np.int32), np.frombuffer(row["bits"], np.uint64))
        counts = np.frombuffer(row["counts"], np.dtype(f"<u{row['width']}"))
        return cls(hash_, np.frombuffer(row["fingerprints"], np.uint32), counts)


@dataclass(frozen=True)
class LineRule:
    """Lines whose key has ``least_points`` code points and is in ``least_docs`` documents go.

    A key is the line without the white space at its ends, A-Z in lower case.
    """

    least_docs: int = 10
    least_points: int = 1

    def keys(self, lines: list[bytes]) -> list[bytes]:
        spaces = SPACE_CHARS.encode()
        return [line.strip(spaces).lower() for line in lines]

    def counts(self, key: bytes) -> bool:
        return len(key) >= self.least_points and (self.least_points <= 1 or len(key.decode()) >= self.least_points)

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        """Hashes of the keys that count, in order; 64 bits name a line."""
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys if self.counts(k)], np.uint64)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents as written blocks of a few MB (or of one text): block, doc_ids, texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            ends = pa.array([0, batch.num_rows], pa.int32())
            whole = [pa.ListArray.from_arrays(ends, column) for column in batch.columns]
            yield pa.RecordBatch.from_arrays(whole, names=["doc_ids", "texts"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut_up = narrow.mapInArrow(cut, "doc_ids array<bigint>, texts array<string>")
    return materialize(cut_up.withColumn("block", F.monotonically_increasing_id()), "line-blocks")


def block_lines(blocks: DataFrame, rule: LineRule) -> DataFrame:
    """block, its distinct line hashes, and how many of its documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = batch.column(1)[row].as_py()
                each = [np.unique(rule.hashes(rule.keys(lines_of(t)))) for t in texts]
                hashes, uses = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([hashes.view(np.int64)]), pa.array([uses.astype(np.int32)])],
                    names=["block", "hashes", "uses"],
                )

    found = blocks.select("block", "texts").mapInArrow(run, "block bigint, hashes array<bigint>, uses array<int>")
    return materialize(found, "line-hashes")


def line_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Shards of the index, a row each, and the bits of a hash that name its shard.

    Lines are counted by hash, with sums in each task first, so that the commonest line
    is a row a task.  Hashes are even, so shards are too.
    """
    each = lines.select(F.explode(F.arrays_zip("hashes", "uses")).alias("e"))
    counts = materialize(
        each.groupBy(F.col("e.hashes").alias("hash")).agg(F.sum("e.uses").alias("n_docs")), "line-counts"
    )
    bits = max(0, (-(-counts.count() // shard_keys) - 1).bit_length())
    shard = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("hash").to_numpy().view(np.uint64)
        return Shard.of(keys, table.column("n_docs").to_numpy()).stored(table.column("shard")[0].as_py())

    dealt = counts.withColumn("shard", shard.cast("long")).groupBy("shard")
    return materialize(dealt.applyInArrow(build, SHARD_SCHEMA), "line-index"), bits


def common_hashes(lines: DataFrame, index: DataFrame, bits: int, least_docs: int, probes: int = PROBES) -> DataFrame:
    """block and those of its hashes that are in ``least_docs`` documents.

    A block asks each shard once for all of its hashes there, so a line that all documents
    have is one probe a block.  Shards with many probes are read by several tasks.
    """
    asked = lines.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    salts = max(1, -(-asked // (probes << bits)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = hashes.values.to_numpy().view(np.uint64)
                shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
                names, first = np.unique(shard, return_index=True)
                ends = pa.array([*first, len(keys)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.astype(np.int64)),
                        pa.array(np.full(len(names), block % salts)),
                        pa.array(np.full(len(names), block)),
                        pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))),
                    ],
                    names=["shard", "salt", "block", "hashes"],
                )

    def answer(asking: pa.Table, shards: pa.Table) -> pa.Table:
        shard = Shard.read(shards.to_pylist()[0])
        lists = asking.column("hashes").combine_chunks()
        keys, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
        common = shard.counts_of(keys) >= least_docs
        blocks = np.repeat(asking.column("block").to_numpy(), sizes)
        return pa.table({"block": blocks[common], "hash": keys[common].view(np.int64)})

    dealt = lines.select("block", "hashes").mapInArrow(split, "shard bigint, salt bigint, block bigint, hashes array<bigint>")
    shared = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = dealt.groupBy("shard", "salt").cogroup(shared.groupBy("shard", "salt")).applyInArrow(answer, "block bigint, hash bigint")
    return found.groupBy("block").agg(F.collect_list("hash").alias("common"))


def drop_common_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for every document.

    Lines are what \\n separates; a null or empty text is one empty line.  A line whose key
    (see ``LineRule``) is in ``least_docs`` rows or more loses all its places in every
    document; the others stay as they are, joined by \\n.  Rows are documents of their own,
    repeated ones and those without an id too; an empty table gives no rows, and only
    doc_id and text are read.

    Documents are written once as blocks.  All distinct lines are counted and indexed by
    a minimal perfect hash in shards of bounded size, each with an array of fingerprints and
    one of counts.  Blocks probe the shards by 64-bit hashes; line texts are never
    shuffled or joined, and no table passes the driver.  A block gets back the hashes of
    its common lines, never more than it has.
    """
    blocks = blocks_of(docs)
    lines = block_lines(blocks, rule)
    index, bits = line_index(lines)
    common = common_hashes(lines, index, bits, rule.least_docs)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, texts, common = (batch.column(k)[row].as_py() for k in range(3))
                gone = {h & (1 << 64) - 1 for h in common or ()}
                n_lines, n_dropped, left = [], [], []
                for text in texts:
                    lines = lines_of(text)
                    goes = [rule.counts(k) and xxhash.xxh3_64_intdigest(k) in gone for k in rule.keys(lines)]
                    n_lines.append(len(lines))
                    n_dropped.append(sum(goes))
                    left.append(b"\n".join([x for x, go in zip(lines, goes, strict=True) if not go]).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "text"],
                )

    whole = blocks.join(common, "block", "left").select("doc_ids", "texts", "common")
    return whole.mapInArrow(drop, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")


def line_digests(dropped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the texts that are left."""
    digest: Column = F.sha2(F.col("text").cast("binary"), 256)
    return dropped.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))
