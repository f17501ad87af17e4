"""File sources: collection by folder and suffix, documents, model output, approvals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text

IMAGES = ("jpg", "jpeg", "png", "heic", "pdf")


@dataclass(frozen=True)
class Route:
    """Files of one subfolder: which suffixes are taken, and by which handler."""

    subfolder: str
    handler: str
    suffixes: tuple[str, ...]


#: The known subfolders.
ROUTES = (
    Route("registers", "images", IMAGES),
    Route("cards", "images", IMAGES),
    Route("consents", "images", IMAGES),
    Route("payments", "images", IMAGES),
    Route("lessons", "docx", ("docx",)),
)


def routing_table(spark: SparkSession, routes: tuple[Route, ...] = ROUTES) -> DataFrame:
    rows = [(r.subfolder, s, r.handler) for r in routes for s in r.suffixes]
    return spark.createDataFrame(rows, "subfolder string, suffix string, handler string")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of every file below ``folder``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    )


def route_files(files: DataFrame, routes: tuple[Route, ...] = ROUTES) -> DataFrame:
    """Files with subfolder, suffix, handler, and a reason where none takes them.

    The routing table is a literal of a few rows, so the join is a broadcast.
    """
    spark = files.sparkSession
    known = F.array(*[F.lit(r.subfolder) for r in routes])
    parts = F.split("path", "/")
    sub = F.get(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.array_contains(known, p)), F.lit(0))
    named = files.withColumn("subfolder", sub).withColumn("suffix", text.suffix(F.col("path")))
    joined = named.join(F.broadcast(routing_table(spark, routes)), ["subfolder", "suffix"], "left")
    reason = F.when(F.col("handler").isNotNull(), F.lit(None).cast("string")).when(
        F.col("subfolder").isNull(), "unknown folder"
    ).otherwise(F.concat(F.lit("unsupported file type ."), "suffix"))
    return joined.withColumn("skip_reason", reason)


def absent_folders(routed: DataFrame, routes: tuple[Route, ...] = ROUTES) -> DataFrame:
    """Known subfolders that hold no file."""
    expected = routed.sparkSession.createDataFrame([(r.subfolder,) for r in routes], "subfolder string")
    return expected.join(routed.select("subfolder"), "subfolder", "left_anti")


def image_requests(spark: SparkSession, folder: str) -> DataFrame:
    """path, media_type, base64 data of every image below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(text.suffix(F.col("path")).isin(*IMAGES)).select(
        "path", text.media_type(F.col("path")).alias("media_type"), F.base64("content").alias("data")
    )


DOCX_SCHEMA = "source_file string, pos int, kind string, text string, table_no int, row_no int, cells array<string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass(frozen=True)
class DocxItem:
    """A paragraph, a row of a numbered table, or what says that the file can't be read."""

    kind: str
    text: str | None = None
    table_no: int | None = None
    row_no: int | None = None
    cells: list[str] | None = None


def _own_text(cell: ElementTree.Element) -> str:
    """Text of a cell's own paragraphs; a table inside it is a table of its own."""
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.findall(f"{_W}p"))
    return " ".join(" ".join(lines).split())


def _number(properties: ElementTree.Element | None, name: str) -> int:
    found = None if properties is None else properties.find(f"{_W}{name}")
    return 0 if found is None else int(found.get(f"{_W}val", "0"))


def _grid(table: ElementTree.Element) -> Iterator[list[str]]:
    """The table's rows on its grid: a cell that spans columns fills each of them, one that
    goes on from the row above has its text, and skipped columns are empty.  Rows that
    are too short are filled up, so that all have the same columns."""
    rows: list[list[str]] = []
    for row in table.findall(f"{_W}tr"):
        line = [""] * _number(row.find(f"{_W}trPr"), "gridBefore")
        for cell in row.findall(f"{_W}tc"):
            properties = cell.find(f"{_W}tcPr")
            span = max(1, _number(properties, "gridSpan"))
            merge = None if properties is None else properties.find(f"{_W}vMerge")
            goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue" and rows
            above = rows[-1][len(line)] if goes_on and len(line) < len(rows[-1]) else None
            line += [_own_text(cell) if above is None else above] * span
        rows.append(line)
    widest = max(map(len, rows), default=0)
    for line in rows:
        yield line + [""] * (widest - len(line))


def _docx_items(content: bytes) -> Iterator[DocxItem]:
    """Paragraphs and table rows of an OOXML document in order; tables are numbered, and
    those inside a cell follow the table that holds them."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_W}body")
    table_no = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            yield DocxItem("paragraph", "".join(t.text or "" for t in node.iter(f"{_W}t")))
        elif node.tag == f"{_W}tbl":
            for table in node.iter(f"{_W}tbl"):
                for k, cells in enumerate(_grid(table)):
                    yield DocxItem("table", None, table_no, k + 1, cells)
                table_no += 1


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and table rows of all documents below ``folder``, one task a few files.

    A file that is no document gives one row of kind 'unreadable', whose text says why.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    items = list(_docx_items(content))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    items = [DocxItem("unreadable", f"{type(e).__name__}: {e}"[:500])]
                rows += [(path, pos, x.kind, x.text, x.table_no, x.row_no, x.cells) for pos, x in enumerate(items)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["source_file", "pos", "kind", "text", "table_no", "row_no", "cells"],
            )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInArrow(parse, DOCX_SCHEMA)


def docx_lines(items: DataFrame) -> DataFrame:
    """source_file, pos, line of the paragraphs."""
    return items.where("kind = 'paragraph'").select("source_file", "pos", F.col("text").alias("line"))


def docx_tables(items: DataFrame) -> DataFrame:
    """Data rows of each table with the table's header, the row numbered 1, and its number in the file."""
    rows = items.where("kind = 'table'")
    head = rows.where("row_no = 1").select("source_file", "table_no", F.col("cells").alias("header"))
    return rows.where("row_no > 1").join(head, ["source_file", "table_no"]).select(
        "source_file", "table_no", "header", "row_no", "cells"
    )


def read_batch_output(spark: SparkSession, glob: str) -> DataFrame:
    """custom_id, content of model batch output: JSON lines, blank ones skipped.

    Text parts of an answer are joined; other parts are left out.
    """
    lines = spark.read.text(glob).where(F.length(F.trim("value")) > 0)
    kind = "recordId string, custom_id string, modelOutput struct<content: array<struct<type: string, text: string>>, stop_reason: string>"
    parsed = lines.select(F.from_json("value", kind).alias("j"))
    said = F.transform(F.filter("j.modelOutput.content", lambda c: c["type"] == "text"), lambda c: c["text"])
    return parsed.select(
        F.coalesce("j.custom_id", "j.recordId").alias("custom_id"), F.array_join(said, "").alias("content"),
        F.col("j.modelOutput.stop_reason").alias("stop_reason"),
    )


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    """record_id of an approvals file: CSV with that header, or one id a line."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    if lines.where(F.lower(F.trim("value")).rlike(r"(^|,)record_id(,|$)")).isEmpty():
        return lines.select(F.trim("value").alias("record_id"))
    return spark.read.option("header", True).csv(path).select(F.trim("record_id").alias("record_id"))


def read_jdbc(spark: SparkSession, url: str, relation: str, key: str | None = None, parts: int = 8, **options) -> DataFrame:
    """A database table; with a numeric key it is read by ``parts`` tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", relation)
    for name, value in options.items():
        reader = reader.option(name, value)
    if key is None:
        return reader.load()
    low, high = reader.load().agg(F.min(key), F.max(key)).first()
    bounds = {"partitionColumn": key, "lowerBound": low or 0, "upperBound": high or 1, "numPartitions": parts}
    for name, value in bounds.items():
        reader = reader.option(name, value)
    return reader.load()
