"""CSV export of ranked records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from docketry.config import ASSESSMENT_COLUMNS, RECORD_FIELDS

BOM = "﻿"
CSV_OPTIONS = {
    "header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def public_columns(df: DataFrame) -> DataFrame:
    """The eleven public columns in their fixed order, whatever else the input has."""
    named = [df[name].alias(public) for public, name, _ in RECORD_FIELDS]
    return df.select(*named, *[df[c] for c in ASSESSMENT_COLUMNS if c in df.columns])


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write ranked records as UTF-8 with a byte order mark, CRLF and minimal quoting.

    ``single_file`` gathers the export in one task, for a report a person opens; for large exports
    pass ``False`` and get one file, with its own header, per partition in ranked order.
    """
    out = public_columns(df)
    first = out.columns[0]
    out = out.withColumnRenamed(first, BOM + first)
    (out.coalesce(1) if single_file else out).write.options(**CSV_OPTIONS).mode("error").csv(path)


def write_csv_file(df: DataFrame, folder: str, name: str) -> str:
    """Write ranked records as the one file ``folder/name`` and return its path.

    The file is written beside its place and then renamed, so a reader never sees half of it.
    ``folder`` may be on any file system the session knows; an existing file is not overwritten.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, parts = path_of(f"{folder}/{name}"), path_of(f"{folder}/.{name}-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{folder}/{name} exists already.")
    write_csv(df, parts.toString())
    (written,) = [f.getPath() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")]
    if not files.rename(written, target):
        raise OSError(f"{folder}/{name} couldn't be written.")
    files.delete(parts, True)
    return f"{folder}/{name}"


def read_csv(spark, path: str) -> DataFrame:
    """Read an export back; every column is text, and an empty field is empty text."""
    df = spark.read.options(header="true", escape='"', lineSep="\r\n", nullValue="\0", emptyValue="").csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns]).na.fill("")
