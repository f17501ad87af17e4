"""N-gram Jaccard join through a token-group matrix, exact for every pair of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import broadcast_within, materialize, row_mark, small_parts, wrapped
from ledgerloom.llm.graph import components


@dataclass(frozen=True)
class Similarity:
    """Jaccard of word shingles: ``percent`` of the union, on ``words`` words."""

    words: int = 5
    percent: int = 80

    @property
    def low(self) -> int:
        """Tokens below this value are low: the ones counted over all classes first.

        Tokens are hashes, so it sets a share of each set.  A class is done once it has
        more tokens of its own than it may miss; the share is half as large again as
        that, so that a class without a partner is done in all likelihood.
        """
        share = min(1.0, 1.5 * (100 - self.percent) / 100 + 0.02)
        return -(1 << 63) + int(share * ((1 << 64) - 1))

    def needed(self, n: Column) -> Column:
        """Least overlap of a set of size ``n`` with any similar one."""
        return F.floor((n * self.percent + 99) / 100).cast("long")

    def similar(self, overlap: Column, n: Column, m: Column) -> Column:
        return 100 * overlap >= self.percent * (n + m - overlap)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A-Z are lower-cased; words are what ASCII white space separates.  Fewer than k
    words are one shingle; no words none.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    span = min(k, len(words))
    mixed = np.full(n, np.uint64(0x9E3779B97F4A7C15 + span), np.uint64)
    for j in range(span):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _long_lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def set_digest(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def row_key(text: Column) -> list[Column]:
    """128 bits of a text; with the id they tell rows apart that differ in either."""
    return [F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_i")]


def set_rows(docs: DataFrame, like: Similarity, keyed: bool = False) -> DataFrame:
    """doc_id, n, digest of the set, and its low tokens; ``keyed`` adds the row's key."""
    k, low_end = like.words, like.low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            sizes, digests, low = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, k)
                sizes.append(len(tokens))
                digests.append(set_digest(tokens))
                low.append(tokens[: int(np.searchsorted(tokens, low_end))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _long_lists(low), *batch.columns[2:]],
                names=["doc_id", "n", "digest", "low", *more],
            )

    more = ["_h", "_i"] if keyed else []
    key = row_key(F.col("text")) if keyed else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key).mapInArrow(
        run, ", ".join(["doc_id bigint, n bigint, digest binary, low array<bigint>", *(f"{c} bigint" for c in more)])
    )


def full_sets(texts: DataFrame, like: Similarity) -> DataFrame:
    """digest and all tokens of each text."""
    k = like.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 0):
            sets = [shingle_set(t, k) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in sets], pa.binary()), _long_lists(sets)], names=["digest", "tokens"]
            )

    return texts.select("text").mapInArrow(run, "digest binary, tokens array<bigint>")


class GroupJoin:
    """One run of the join over ``docs``; tables are written to the shared folder.

    1. Texts become sets; equal sets form a class, so copies are never paired.
    2. Document frequencies of the low tokens order them: rare ones first.  A class
       whose prefix holds only tokens of its own has no partner and is done.  For
       those that remain the same is done with the frequencies of all their tokens
       among themselves.  Tokens of one class alone are then only counted.
    3. Classes are partitioned into groups: in a few rounds leaders that share a
       minimum hash are compared with the one of them that has the smallest part of
       its own (in a cluster of edited copies, the nearest to their origin) and join
       it if similar.
    4. The token-group matrix has a row for each index-prefix token of each group's
       union, however many members hold it.  A class probes it for partners that are
       no larger than itself; sizes, then its overlap with the group's whole union,
       bound what any member can reach; only groups that pass are opened and
       compared exactly.
    5. Groups and links give components.
    """

    def __init__(self, docs: DataFrame, like: Similarity, rounds: int = 3, keyed: bool = False):
        self.docs, self.like, self.rounds = docs, like, rounds
        self.rows = materialize(set_rows(docs, like, keyed).withColumn("uid", F.monotonically_increasing_id()), "join-sets")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(digest, cls, doc_id) of each distinct non-empty set, and the rows that stand for them.

        A class is named after its first row; the rows of copies leave by an anti
        join, so the sets themselves aren't shuffled.
        """
        narrow = self.rows.where("n > 0").select("digest", "uid", "doc_id")
        named = materialize(
            narrow.groupBy("digest").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("doc_id")), "join-classes"
        )
        copies = materialize(
            narrow.join(named.select("digest", "cls"), "digest").where("uid <> cls").select("uid"), "join-copies"
        )
        few = broadcast_within(copies, copies.count(), 16)
        return named, self.rows.where("n > 0").join(few, "uid", "left_anti")

    def sifted(self, firsts: DataFrame) -> DataFrame:
        """cls, doc_id, digest, n of the classes that the low tokens leave open.

        A token that one class has is counted for it straight from the sums by token,
        so tokens are shuffled once and never joined back.
        """
        tokens = firsts.select(F.col("uid").alias("cls"), F.explode("low").alias("token"))
        single = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("cls")).where("df = 1")
        counted = single.groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
        narrow = firsts.select(F.col("uid").alias("cls"), "doc_id", "digest", "n")
        left = F.col("n") - self.like.needed(F.col("n")) + 1 - F.coalesce("own", F.lit(0))
        return materialize(
            narrow.join(counted, "cls", "left").where(left > 0).select("cls", "doc_id", "digest", "n"), "join-sifted"
        )

    def sets_of(self, chosen: DataFrame) -> DataFrame:
        """cls, n, tokens of the chosen classes, from their texts."""
        n = chosen.count()
        ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
        # a class's smallest id may belong to a copy: its text has the same set
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
            broadcast_within(ids, n, 16), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
        )
        sets = full_sets(texts, self.like).join(broadcast_within(chosen.select("cls", "n", "digest"), n, 64), "digest")
        return materialize(sets.select("cls", "n", "tokens"), "join-full")

    def reduced(self, sets: DataFrame) -> DataFrame:
        """Classes that their full sets leave open: cls, n, own, tokens.

        ``tokens`` are those that another remaining class has too, in the global
        order (frequency, token); ``own`` counts the others, which come first in the
        order and can be in no overlap.
        """
        each = sets.select("cls", F.explode("tokens").alias("token"))
        frequent = materialize(
            each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-full-frequencies"
        )
        known = broadcast_within(frequent, frequent.count(), 40)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
        # repeated rows of one id and text give a token twice
        met = each.join(known, "token").groupBy("cls").agg(F.array_distinct(ordered).alias("tokens"))
        sizes = sets.select("cls", "n").distinct()
        own = F.col("n") - F.size("tokens")
        return materialize(
            sizes.join(met, "cls")
            .withColumn("own", own)
            .where(F.col("n") - self.like.needed(F.col("n")) + 1 > F.col("own"))
            .select("cls", "n", "own", "tokens"),
            "join-reduced",
        )

    def _prefix(self, length: Column) -> Column:
        """The shared tokens within the first ``length`` of the order."""
        return F.slice("tokens", 1, F.greatest(length - F.col("own"), F.lit(0)).cast("int"))

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar."""
        left = sets.select(F.col("cls").alias("a"), F.col("n").alias("_n"), F.col("tokens").alias("_s"))
        right = sets.select(F.col("cls").alias("b"), F.col("n").alias("_m"), F.col("tokens").alias("_t"))
        both = pairs.join(left, "a").join(right, "b")
        overlap = F.size(F.array_intersect("_s", "_t"))
        return both.where(self.like.similar(overlap, F.col("_n"), F.col("_m"))).select(*pairs.columns)

    def groups(self, sets: DataFrame) -> DataFrame:
        """(cls, grp, n, own): every remaining class with its group's leader."""
        leaders = sets
        moves = []
        for r in range(self.rounds):
            mark = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(r))))
            marked = materialize(leaders.select("cls", "n", "own", mark.alias("mark")), "join-marks")
            central = F.struct((F.col("own") / F.col("n")).alias("part"), "cls")
            pivots = marked.groupBy("mark").agg(F.min(central).alias("_p"), F.count(F.lit(1)).alias("size")).where("size > 1")
            pairs = marked.join(pivots.select("mark", F.col("_p.cls").alias("a")), "mark").where("cls <> a")
            joined = materialize(self._verified(pairs.select("a", F.col("cls").alias("b")), leaders), "join-joined")
            if joined.isEmpty():
                continue
            moves.append(joined)
            leaders = materialize(leaders.join(joined.select(F.col("b").alias("cls")), "cls", "left_anti"), "join-leaders")
        member = sets.select("cls", "n", "own", F.col("cls").alias("grp"))
        for joined in moves:
            step = joined.select(F.col("b").alias("grp"), F.col("a").alias("_to"))
            member = member.join(step, "grp", "left").select("cls", "n", "own", F.coalesce("_to", "grp").alias("grp"))
        return materialize(member, "join-groups")

    def _reaches(self, n: Column, own: Column, m: Column) -> Column:
        """Can a set of ``n`` with ``own`` unshared tokens be similar to one of ``m``?"""
        t = self.like.percent
        return (100 * m >= t * n) & (100 * n >= t * m) & ((100 + t) * (n - own) >= t * (n + m))

    def links(self, member: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of groups (a, b) that hold a similar pair of classes.

        Of a similar pair the larger set probes: its first n - needed + 1 tokens meet
        the first m - 2 * percent / (100 + percent) * m + 1 of the other.
        """
        t, n = self.like.percent, F.col("n")
        grouped = sets.join(member.select("cls", "grp"), "cls")
        least = F.ceil(2 * t * n / (100 + t))
        index = grouped.select("grp", "n", F.explode(self._prefix(n - least + 1)).alias("token"))
        probe = grouped.select("cls", "grp", "n", "own", F.explode(self._prefix(n - self.like.needed(n) + 1)).alias("token"))
        matrix = index.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high")).select(
            "token", F.col("grp").alias("other"), "low", "high"
        )
        nearest = F.greatest(F.col("low"), F.ceil(n * t / 100))
        fits = (F.col("low") <= n) & (nearest <= F.col("high")) & self._reaches(n, F.col("own"), nearest)
        met = probe.join(matrix, "token").where((F.col("grp") != F.col("other")) & fits)
        candidates = materialize(
            met.groupBy("cls", "other").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("grp").alias("grp")),
            "join-candidates",
        )
        if candidates.isEmpty():
            return candidates.select(F.col("grp").alias("a"), F.col("other").alias("b"))
        sizes = member.groupBy(F.col("grp").alias("other")).agg(F.count(F.lit(1)).alias("members"))
        sized = candidates.join(sizes, "other")
        qualified = self._within_bound(sized.where("members > 1").drop("members"), member, sets)
        open_ = sized.where("members = 1").drop("members").unionByName(qualified)
        inside = member.select(F.col("grp").alias("other"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("own").alias("m_own"))
        pairs = open_.join(inside, "other").where(
            (F.col("m") <= n) & self._reaches(n, F.col("own"), F.col("m")) & self._reaches(F.col("m"), F.col("m_own"), n)
        )
        found = self._verified(pairs.select(F.col("cls").alias("a"), "b", "grp", "other"), sets)
        return found.select(F.col("grp").alias("a"), F.col("other").alias("b")).distinct()

    def _within_bound(self, several: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidates whose overlap with the group's token union could suffice."""
        wanted = several.select(F.col("other").alias("grp")).distinct()
        # written out: with no sum between it and the join, Spark can split a hot group's rows
        union = materialize(
            member.select("cls", "grp")
            .join(wanted, "grp", "left_semi")
            .join(sets.select("cls", "tokens"), "cls")
            .select(F.col("grp").alias("other"), F.explode("tokens").alias("token"))
            .distinct(),
            "join-unions",
        )
        columns = ["cls", "n", "own", "grp", "other"]
        asked = several.join(sets.select("cls", "tokens"), "cls").select(*columns, F.explode("tokens").alias("token"))
        overlap = asked.join(union, ["other", "token"]).groupBy(*columns).agg(F.count(F.lit(1)).alias("o"))
        return overlap.where(F.col("o") >= self.like.needed(F.col("n"))).select(*columns)

    def grouped(self) -> DataFrame:
        """(digest, doc_id, grp) of each distinct non-empty set, with its component."""
        named, firsts = self.classes()
        sets = self.reduced(self.sets_of(self.sifted(firsts)))
        member = self.groups(sets)
        links = materialize(self.links(member, sets), "join-links")
        if not links.isEmpty():
            roots = components(links, "a", "b").select(F.col("node").alias("grp"), "root")
            member = member.join(roots, "grp", "left").select("cls", F.coalesce("root", "grp").alias("grp"))
        grouped = named.join(member.select("cls", "grp"), "cls", "left")
        return materialize(grouped.select("digest", "doc_id", F.coalesce("grp", "cls").alias("grp")), "join-named")

    def report(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of the documents."""
        grouped = self.grouped()
        smallest = grouped.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
        by_digest = grouped.join(smallest, "grp").select("digest", "component_id")
        narrow = self.rows.select("doc_id", "n", "digest")
        found = narrow.where("n > 0").join(by_digest, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = narrow.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return found.unionByName(alone)

    def verdict(self) -> tuple[DataFrame, DataFrame]:
        """Row keys that go, and those that stay but stand for several rows.

        The first key of a component by (id, null last, key) stays.  A key is equal
        text under an equal id, so its rows share a component.  Rows without words are
        in neither table.
        """
        key = ["doc_id", "_h", "_i"]
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), *key)
        keys = materialize(
            self.rows.where("n > 0").groupBy("digest", *key).agg(F.count(F.lit(1)).alias("copies")), "join-keys"
        )
        firsts = keys.groupBy("digest").agg(F.min(order).alias("first"))
        grouped = self.grouped().select("digest", "grp").join(firsts, "digest")
        best = grouped.groupBy("grp").agg(F.min("first").alias("best"))
        by_digest = grouped.join(best, "grp").select("digest", "best")
        judged = materialize(
            keys.join(by_digest, "digest").select(*key, "copies", (order == F.col("best")).alias("stays")), "join-judged"
        )
        return judged.where("not stays").select(*key), judged.where("stays and copies > 1").select(*key)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    Documents link when their shingle sets' Jaccard is ``percent`` or more; every
    link between different sets is found.  Null, empty and blank texts have no
    shingles and form components of their own.  Repeated rows are copies.  The
    smallest id of a component ignores null ids.  Extra columns are not read.
    """
    return GroupJoin(docs, Similarity(words, percent)).report()


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id, null last.

    All columns are kept, whatever their names.  The verdict is on (id, text), so rows
    that share an id or have none are told apart by their texts; of rows equal in both
    the one with the smallest hash over all its columns stays.  Null, empty and blank
    texts stay.  Only keys meet the texts, behind a size check.
    """
    goes, several = GroupJoin(docs, Similarity(words, percent), keyed=True).verdict()
    h, i = row_key(docs["text"])
    whole = wrapped(docs, _h=h, _i=i, _id=docs["doc_id"].cast("long"), _mark=row_mark(docs))

    def met(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        named = keys.select(F.col("_h").alias("_kh"), F.col("_i").alias("_ki"), F.col("doc_id").alias("_kid"))
        few = broadcast_within(named, keys.count(), 48)
        return df.join(few, (F.col("_h") == F.col("_kh")) & (F.col("_i") == F.col("_ki")) & F.col("_id").eqNullSafe(F.col("_kid")), how)

    left = met(whole, goes, "left_anti")
    if several.isEmpty():
        return left.select("row.*")
    one = met(whole, several, "left_semi").groupBy("_h", "_i", "_id").agg(F.min_by("row", "_mark").alias("row"))
    return met(left, several, "left_anti").select("row").unionByName(one.select("row")).select("row.*")
