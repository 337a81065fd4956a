"""Writers: quoted CSV, JSON, Markdown files, and append stores."""

from __future__ import annotations

import html
import io
import json as json_text
import textwrap
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import durable

from .readers import csv as read_csv
from .readers import exists

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: The parts of a Word file.
DOCX_PARTS = {
    "[Content_Types].xml": _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/document.xml": _HEAD + '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
}


def _lines(out: DataFrame) -> DataFrame:
    """Rows as CSV lines; each partition begins with a byte order mark and the header."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in out.columns]
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in out.columns)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
                first = False
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    return out.select(F.concat_ws(",", *quoted).alias("value")).mapInArrow(begin, "value string")


def csv(df: DataFrame, path: str, columns: list[str], check: bool = False, mark: bool = False) -> None:
    """Every field quoted, quotes doubled, only ``columns``; Spark commits the files at once.

    ``check`` reads the files back and compares the number of rows.  ``mark``
    begins each file with a byte order mark, as spreadsheets want it.  An
    empty input writes nothing.
    """
    out = df.select(*columns)
    if out.isEmpty():
        return
    if mark:
        _lines(out).write.mode("overwrite").option("lineSep", "\n").text(path)
    else:
        out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").csv(path)
    if check:
        written, read = out.count(), read_csv(df.sparkSession, path, out.schema).count()
        if written != read:
            raise OSError(f"{path}: {written} rows written, {read} read back")


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Rows of a JSON array; one file is written by one task.
ARRAY_ROWS = 1_000_000


def json_array(df: DataFrame, path: str, most: int = ARRAY_ROWS) -> None:
    """One JSON array with an indent of 2, other scripts as they are.

    One task writes it row by row, so it is for reports: a table of more than
    ``most`` rows is refused before anything is written, JSON lines hold it.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"an array of more than {most} rows would be written by one task; write JSON lines")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ""
        rows = (r for b in batches for r in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        for r in rows:
            text = textwrap.indent(json_text.dumps(json_text.loads(r), ensure_ascii=False, indent=2), "  ")
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([held + ","])], ["value"])
            held = text
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"])], ["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
    out = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1) if df.isEmpty() else rows.mapInArrow(lines, "value string")
    out.write.mode("overwrite").option("lineSep", "\n").text(path)


@F.pandas_udf(T.BinaryType())
def docx(texts: pd.Series) -> pd.Series:
    """A Word file of each text, a paragraph a line."""

    def file(text: object) -> bytes:
        lines = (text if isinstance(text, str) else "").split("\n")
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(x, quote=False)}</w:t></w:r></w:p>' for x in lines)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in DOCX_PARTS.items():
                z.writestr(name, content.format(body=body))
        return out.getvalue()

    return texts.map(file)


def markdown_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """One folder of text files for each value of ``name``."""
    df.select(F.col(name), F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).option("lineSep", "\n\n").text(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the JSON-lines store does not hold; returns those rows.

    The rows are written to a table of their own beside the store first, so
    what is returned is what was appended.
    """
    spark = df.sparkSession
    fresh = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df
    fresh = durable(fresh.dropDuplicates([key]))
    fresh.write.mode("append").json(path)
    return fresh


def run_name(prefix: str, at: datetime) -> str:
    return f"{prefix}_{at:%Y%m%d_%H%M}.csv"
