"""Spelling variants: words one letter apart, found through wildcard groups without pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import materialize, small_parts

#: Letters of the words: a maximal run of them is a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Bytes of distinct words that a task counts before it hands them on.
TASK_BYTES = 32 << 20
ENTRY_BYTES = 160
#: Words up to this length are named by themselves, longer ones by a hash of their
#: letters, so that a word's keys take space in proportion to its length.
PLAIN_POINTS = 64
#: Modulus and base of that hash.
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835

#: A word as typed in a document: (doc_id, word) -> word.
Typed = Callable[[int | None, str], str]


def planted_typos(doc_id: int | None, word: str) -> str:
    """The contract's misspellings: by hash, one letter of a document's word is missing.

    A null id counts as an empty one.
    """
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_points: int = 6, least_uses: int = 5, typed: Typed | None = None) -> DataFrame:
    """(word, n): words of ``least_points`` letters with ``least_uses`` or more in all texts.

    A-Z are lower-cased, other letters stay.  ``typed`` gives a document's own spelling,
    which is never longer than the word.  Counts are summed in each task first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{least_points},}}").findall
        total: Counter = Counter()
        held = 0

        def hand_on() -> pa.RecordBatch:
            words = pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())
            total.clear()
            return pa.RecordBatch.from_arrays(list(words), names=["word", "n"])

        for batch in small_parts(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(find((text or "").encode().lower().decode())).items():
                    own = word if typed is None else typed(doc_id, word)
                    if len(own) >= least_points:
                        if own not in total:
                            held += ENTRY_BYTES + 2 * len(own)
                        total[own] += n
                if held >= TASK_BYTES:
                    yield hand_on()
                    held = 0
        yield hand_on()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_uses)


class LetterHashes:
    """Hashes of a word's prefixes and suffixes, each by one step from the one before."""

    def __init__(self, word: str):
        points = [ord(c) + 1 for c in word]
        self.length = len(points)
        self.prefix, self.suffix, self.power = [0], [0], [1]
        for c in points:
            self.prefix.append((self.prefix[-1] * BASE + c) % PRIME)
        for c in reversed(points):
            self.suffix.append((self.suffix[-1] + c * self.power[-1]) % PRIME)
            self.power.append(self.power[-1] * BASE % PRIME)
        self.suffix.reverse()

    def without(self, at: int) -> int:
        """Hash of the word without its letter ``at``, as a word's own would be."""
        return (self.prefix[at] * self.power[self.length - 1 - at] + self.suffix[at + 1]) % PRIME


def named(value: int) -> str:
    return f"\x00{value:032x}"


def word_name(word: str) -> str:
    return word if len(word) <= PLAIN_POINTS else named(LetterHashes(word).prefix[-1])


def wildcards(word: str) -> tuple[list[str], list[str]]:
    """What stands before and after each place of a word."""
    if len(word) <= PLAIN_POINTS:
        return [word[:i] for i in range(len(word))], [word[i + 1 :] for i in range(len(word))]
    h = LetterHashes(word)
    return [named(h.prefix[i]) for i in range(len(word))], [named(h.suffix[i + 1]) for i in range(len(word))]


def deletions(word: str) -> list[str]:
    """Names of the distinct words that one deletion gives.

    Letters of a run of equal ones give the same word, so only its first is left out.
    """
    places = [i for i in range(len(word)) if i == 0 or word[i] != word[i - 1]]
    if len(word) <= PLAIN_POINTS + 1:
        return [word[:i] + word[i + 1 :] for i in places]
    h = LetterHashes(word)
    return [named(h.without(i)) for i in places]


def _exploded(words: DataFrame, keys: Callable[[str], tuple[list, ...]], names: str) -> DataFrame:
    """id, n and a row for each of the word's keys; the word itself stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 2, 1 << 16):
            found = [keys(w) for w in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            columns = [pa.array([x for f in found for x in f[k]]) for k in range(len(found[0]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "n", *fields]
            )

    fields = [c.split()[0] for c in names.split(", ")]
    return words.select("id", "n", "word").mapInArrow(run, f"id bigint, n bigint, {names}")


def _better(n: Column, id_: Column) -> Column:
    """Smallest for the word of largest n, then the first in code-point order."""
    return F.struct((-n).alias("less"), id_.alias("id"))


def replaced(words: DataFrame) -> DataFrame:
    """(id, near, best): words that differ in one letter, counted by group.

    Words that agree but for one place share its (position, prefix, suffix) group.  A
    group has at most as many words as there are letters.  Its size and its two top
    words tell each member how many others it meets there and the best of them.
    """
    group = _exploded(words, lambda w: (list(range(len(w))), *wildcards(w)), "position bigint, prefix string, suffix string")
    whole = (
        Window.partitionBy("position", "prefix", "suffix")
        .orderBy(F.desc("n"), "id")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    top = _better(F.col("n"), F.col("id"))
    summed = group.select(
        "id",
        F.count(F.lit(1)).over(whole).alias("size"),
        F.nth_value(top, 1).over(whole).alias("first"),
        F.nth_value(top, 2).over(whole).alias("second"),
    )
    best = F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    return summed.where("size > 1").select("id", (F.col("size") - 1).alias("near"), best.alias("best"))


def inserted_or_deleted(words: DataFrame) -> DataFrame:
    """(id, near, best): words that one letter more or less gives.

    Deletions meet the vocabulary.  The longer word gets the shorter ones that exist; the
    shorter gets the number of the longer ones and their best, summed before the join.
    """
    shorter = _exploded(words, lambda w: (deletions(w),), "name string")
    known = _exploded(words, lambda w: ([word_name(w)],), "name string")
    known = known.select("name", F.col("id").alias("short"), F.col("n").alias("short_n"))
    one = F.count(F.lit(1)).alias("near")
    down = shorter.join(known, "name").groupBy("id").agg(one, F.min(_better(F.col("short_n"), F.col("short"))).alias("best"))
    longer = shorter.groupBy("name").agg(one, F.min(_better(F.col("n"), F.col("id"))).alias("best"))
    return down.unionByName(longer.join(known, "name").select(F.col("short").alias("id"), "near", "best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root): for each word with a form, the last word of its chain.

    A form has several times the uses of its word, so chains are short; each round
    doubles the steps taken.
    """
    roots = materialize(forms.where("form is not null").select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        step = roots.join(on, F.col("root") == F.col("mid"), "left").select(
            "id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")
        )
        new = materialize(step, "spelling-roots")
        roots = new.select("id", "root")
        if new.where("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n); words are distinct.

    Two words are near if one letter replaced, inserted or deleted gives the other.  The
    form is the near word of largest n (of equals the first in code-point order) if its n
    is ``times`` the word's or more, else null; the root is where forms end, from the word
    on.  Words get ids in their own order, which stand for them in all groups and joins,
    so that words of any length cost in proportion to it.  An empty table gives no rows.
    """
    ordered = words.select("word", F.col("n").cast("long").alias("n")).orderBy("word")
    words = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = replaced(words).unionByName(inserted_or_deleted(words))
    summed = near.groupBy("id").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    best_n = -F.col("best.less")
    takes = best_n >= times * F.col("n")
    forms = materialize(
        words.select("id", "n").join(summed, "id", "left").select(
            "id",
            F.when(takes, F.col("best.id")).alias("form"),
            F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, best_n).cast("long").alias("form_n"),
        ),
        "spelling-forms",
    )
    rooted = forms.join(followed(forms), "id", "left").join(words, "id")
    name = lambda of: words.select(F.col("id").alias(f"_{of}"), F.col("word").alias(of))
    named_ = rooted.withColumnsRenamed({"form": "_form", "root": "_root"})
    spelled = named_.join(name("form"), "_form", "left").join(name("root"), "_root", "left")
    return spelled.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(
    docs: DataFrame, least_points: int = 6, least_uses: int = 5, times: int = 5, typed: Typed | None = None
) -> DataFrame:
    """``spelling_variants`` of the words of all whole texts.

    Null, empty and blank texts have no words; rows are read each, repeated ones and those
    without an id too, and an empty table gives no rows.  Other columns are not read.
    """
    return spelling_variants(word_counts(docs, least_points, least_uses, typed), times)
