"""Token counts: pieces once per distinct pre-token, joined to documents' frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import head_threshold, materialize, small_parts
from ledgerloom.llm.tokenizing import Vocabulary, default_vocabulary, library, special_strings

#: Most pre-tokens in the head, whose counts every task gets, and their bytes as objects.
HEAD_ROWS = 200_000
HEAD_BYTES = 32 << 20
#: Bytes of distinct pre-tokens that a task gathers before it hands them on.
TASK_BYTES = 32 << 20
#: Bytes of an entry of a dict besides the pre-token's own.
ENTRY_BYTES = 160
#: Pre-tokens that the library counts in one call.
COUNT_ROWS = 5_000


class PreTokenizer:
    """Pre-tokens of whole texts by the vocabulary's pattern, around its special tokens."""

    def __init__(self, vocabulary: Vocabulary):
        import public_tokenizers as public
        import regex

        self.find = regex.compile(public.PATTERN).findall
        self.plain = special_strings(vocabulary)
        self.specials = regex.compile("|".join(map(regex.escape, self.plain)) or r"(?!)")

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of the text by frequency, and its special tokens."""
        if not any(s in text for s in self.plain):
            return Counter(self.find(text)), 0
        parts = self.specials.split(text)
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.find(part))
        return counts, len(parts) - 1


def distinct_pretokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(pretoken, n_uses) over all documents; merged in each task before the shuffle.

    ``n_uses`` counts each document that has the pre-token once.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokenizer(vocabulary)
        uses: Counter = Counter()
        held = 0

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], names=["pretoken", "n_uses"]
            )
            uses.clear()
            return out

        for batch in small_parts(batches, 0):
            for text in batch.column(0).to_pylist():
                found = cutter.frequencies(text or "")[0].keys()
                held += sum(ENTRY_BYTES + 4 * len(t) for t in found if t not in uses)
                uses.update(found)
                if held >= TASK_BYTES:
                    yield hand_on()
                    held = 0
        yield hand_on()

    gathered = docs.select("text").mapInArrow(gather, "pretoken string, n_uses bigint")
    return gathered.groupBy("pretoken").agg(F.sum("n_uses").alias("n_uses"))


def count_pieces(pretokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds n_pieces, the library's count of ids for the pre-token alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, COUNT_ROWS):
                batch = whole.slice(at, COUNT_ROWS)
                found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
                sizes = [len(x.ids) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int32())], names=["pretoken", "n_uses", "n_pieces"]
                )

    return pretokens.mapInArrow(count, "pretoken string, n_uses bigint, n_pieces int")


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary | None = None, limit: int = 512, head_rows: int = HEAD_ROWS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit``) for every document.

    Pre-tokens that many documents share form the head: a table of bounded size,
    which every task holds, so their part of a document's sum never leaves the task.
    All others meet their counts in a shuffle join by pre-token; none of these is in
    many documents, so no key is hot.  Ids are never made for documents.  A special
    token's string in a text counts as one token, as the library has it.  Null texts
    are empty (0 bytes, 0 tokens).  Repeated rows are counted each; an empty table
    gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    table = materialize(count_pieces(distinct_pretokens(docs, vocabulary), vocabulary), "counts-pretokens")
    in_memory = 4 * F.length("pretoken") + F.lit(ENTRY_BYTES)
    threshold = max(head_threshold(table, head_rows), head_threshold(table, HEAD_BYTES, in_memory))
    head_table = table.where(F.col("n_uses") >= threshold).select("pretoken", "n_pieces").toArrow()
    head = spark.sparkContext.broadcast(
        dict(zip(head_table.column(0).to_pylist(), head_table.column(1).to_pylist(), strict=True))
    )

    def sum_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = PreTokenizer(vocabulary), head.value
        for batch in small_parts(batches, 2):
            rows, ids, size, tokens, many = [], [], [], [], []
            for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = text or ""
                counts, total = cutter.frequencies(text)
                rare = []
                for token, times in counts.items():
                    pieces = known.get(token)
                    if pieces is None:
                        rare.append(token)
                    else:
                        total += pieces * times
                rows.extend([row] * (len(rare) + 1))
                ids.append(doc_id)
                ids.extend([None] * len(rare))
                size.append(len(text.encode()))
                size.extend([None] * len(rare))
                tokens.append(None)
                tokens.extend(rare)
                many.append(total)
                many.extend(counts[t] for t in rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(tokens, pa.string()),
                    pa.array(many, pa.int64()),
                ],
                names=["row", "doc_id", "n_bytes", "pretoken", "times"],
            )

    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        sum_head, "row bigint, doc_id bigint, n_bytes bigint, pretoken string, times bigint"
    )
    # a document's own row has a key of its own, so that none of the join's tasks gets them all
    key = F.coalesce("pretoken", F.concat(F.lit("\x00"), F.col("row").cast("string")))
    tail = table.where(F.col("n_uses") < threshold).select(F.col("pretoken").alias("_tail"), "n_pieces")
    met = parts.withColumn("_key", key).join(tail, F.col("_key") == F.col("_tail"), "left")
    # only a document's own row has no pre-token; any other without a count is an error
    missing = F.raise_error(F.concat(F.lit("no count for pre-token "), F.col("pretoken")))
    pieces = F.when(F.col("pretoken").isNull(), F.lit(1)).when(F.col("n_pieces").isNull(), missing).otherwise(F.col("n_pieces"))
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("times") * pieces).alias("n_tokens")
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
