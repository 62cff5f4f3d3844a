"""XML responses: record rows (a Python table function) and response metadata (built-in XPath)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from docketry.config import RECORD_FIELDS
from docketry.functions.text import squeeze

RECORD_TAGS = ("PatentUtilityInfo", "item")
RECORD_SCHEMA = "pos int, " + ", ".join(f"{name} string" for _, name, _ in RECORD_FIELDS)


class MalformedResponse(ValueError):
    """The body is no XML document."""


def _bare(tag: object) -> str:
    """Tag name without name space; comments and instructions have none."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse_tree(body: str | bytes) -> ET.Element:
    """The document's root. Entity declarations are refused: they can blow up a small input."""
    if (b"<!ENTITY" in body) if isinstance(body, bytes) else ("<!ENTITY" in body):
        raise MalformedResponse("The response declares XML entities.")
    try:
        return ET.fromstring(body)
    except ET.ParseError as exc:
        raise MalformedResponse("The response is not valid XML.") from exc


def records_of(root: ET.Element) -> Iterator[tuple]:
    """Records of a document: all nodes of the first record tag, then all of the second.

    A field is the first node below (or the record node itself) with one of its tags, in document
    order, even if that node is empty; its text is all text below it with white space squeezed.
    Records with neither title nor application number are left out. ``pos`` counts those returned.
    """
    wanted = {tag: i for i, (_, _, tags) in enumerate(RECORD_FIELDS) for tag in tags}
    by_tag: dict[str, list[ET.Element]] = {tag: [] for tag in RECORD_TAGS}
    for node in root.iter():
        if (name := _bare(node.tag)) in by_tag:
            by_tag[name].append(node)
    pos = 0
    for tag in RECORD_TAGS:
        for record in by_tag[tag]:
            values: list[str | None] = [None] * len(RECORD_FIELDS)
            for node in record.iter():
                i = wanted.get(_bare(node.tag))
                if i is not None and values[i] is None:
                    values[i] = " ".join("".join(node.itertext()).split())
            row = tuple(v or "" for v in values)
            if row[0] or row[1]:
                yield (pos, *row)
                pos += 1


@udtf(returnType=RECORD_SCHEMA)
class ParseRecords:
    """``parse_records(body)``: the record rows of one XML body; null or blank gives none."""

    def eval(self, body: str):
        if body and body.strip():
            yield from records_of(parse_tree(body))


def parse_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """Record rows of every response, its other columns kept, in a lateral join without a shuffle."""
    spark = responses.sparkSession
    spark.udtf.register("docketry_parse_records", ParseRecords)
    kept = [f"r.`{c}`" for c in responses.columns if c != body]
    fields = ["p.pos", *[f"p.{name}" for _, name, _ in RECORD_FIELDS]]
    return spark.sql(
        f"SELECT {', '.join(kept + fields)} FROM {{responses}} r, LATERAL docketry_parse_records(r.`{body}`) p",
        responses=responses,
    )


def metadata_columns(body: Column) -> dict[str, Column]:
    """Result code, message, success mark and node counts of a body, inside the JVM."""
    def first(name: str) -> Column:
        return squeeze(F.xpath_string(body, F.lit(f"(//*[local-name()='{name}'])[1]")))

    def count(name: str) -> Column:
        return F.xpath_int(body, F.lit(f"count(//*[local-name()='{name}'])"))

    return {
        "resultCode": first("resultCode"),
        "resultMsg": first("resultMsg"),
        "successYN": first("successYN"),
        "n_info": count("PatentUtilityInfo"),
        "n_item": count("item"),
    }


def response_metadata(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per response with its metadata; malformed bodies fail the query."""
    return responses.withColumns(metadata_columns(F.col(body))).drop(body)


def first_record_tags(body: str | bytes) -> list[str]:
    """Diagnostics: child tags of the first record node, in the record order."""
    root = parse_tree(body)
    for tag in RECORD_TAGS:
        for node in root.iter():
            if _bare(node.tag) == tag:
                return [_bare(child.tag) for child in node]
    return []


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of saved responses, one document per file; ``file`` tells which."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )
    return parse_records(files)
