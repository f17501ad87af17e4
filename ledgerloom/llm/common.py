"""Helpers shared by the corpus operators: shared tables, words, dense numbering."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words in every contract of this package.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

#: Largest build side that may be broadcast; beyond it every caller shuffles.
BROADCAST_BYTES = 32 << 20

#: Text that a Python worker holds as objects at a time.
PART_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) a temporary
    folder is made and set as the session's own; on a cluster that is an error, as
    each machine would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; deleted when the driver's JVM ends, or with
    the ``tables_made`` that it belongs to."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop_path)
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """Gathers the paths that ``new_path`` gives meanwhile."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield paths
    finally:
        _open_scopes.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no result to come reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only if ``rows * bytes_per_row`` is within the bound."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def wrapped(df: DataFrame, columns: Sequence[str] | None = None, **more: Column) -> DataFrame:
    """``row``, a struct of all columns (or of ``columns``), beside the columns ``more``.

    Joins on ``more`` then meet no column name of the caller's table;
    ``select("row.*")`` gives the table back.
    """
    row = F.struct(*[df[f"`{c}`"] for c in (df.columns if columns is None else columns)])
    return df.select(row.alias("row"), *[v.alias(k) for k, v in more.items()])


def row_mark(df: DataFrame) -> Column:
    """Hash over all columns that can be hashed: it orders rows that are else alike."""
    usable = [df[f"`{c}`"] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*usable) if usable else F.lit(0).cast("long")


def dense_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    largest: int | None = None,
    rows_per_bucket: int = 5_000,
) -> DataFrame:
    """Number the rows of each group from 0 without a gap, however large the group.

    Rows are dealt by (group, hash of all ``order`` columns), numbered inside that
    bucket, and shifted by the rows in the group's earlier buckets.  Only bucket
    counts are summed along a group, so no task holds one.  ``df`` is read twice:
    pass a narrow, materialized table.  The last ``order`` column must tell rows
    apart (a stored row number), so that equal rows spread over buckets too.  The
    number of buckets follows ``largest``, the rows of the largest group (all rows
    if not given).
    """
    n_buckets = max(1, -(-(df.count() if largest is None else largest) // rows_per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    keys = [*group, "_bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return (
        inside.join(offsets, same)
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_start", *[f"_o_{k}" for k in keys])
    )


def head_threshold(table: DataFrame, most: int, size: Column | None = None) -> int:
    """Smallest power of two such that rows with as many ``n_uses`` are at most ``most``,
    or sum up to it in ``size``."""
    of_row = F.lit(1) if size is None else size
    exponents = table.groupBy(F.floor(F.log2("n_uses")).cast("int").alias("e")).agg(F.sum(of_row).alias("size")).collect()
    total, threshold = 0, 1 << 62
    for row in sorted(exponents, key=lambda r: -r["e"]):
        total += row["size"]
        if total > most:
            break
        threshold = 1 << row["e"]
    return threshold


def small_parts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has ``most`` bytes in its text column, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            limit = most + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, across its tasks."""
    module = sys.modules.setdefault("_ledgerloom_worker", types.ModuleType("_ledgerloom_worker"))
    return module.__dict__.setdefault(name, {})


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label (0 or 1) of the ids that may be learned from.

    Held-out ids, null ids and other values are left out; an id that is labelled both
    ways teaches nothing.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    ends = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    return ends.where("label = _most").select("doc_id", "label")


def sampled_labels(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids of each label, in the order of a hash of the id: a larger
    table gives another sample of the same size, small enough to be broadcast."""
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    return materialize(parts[0].unionByName(parts[1]), "sample-ids")
