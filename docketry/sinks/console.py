"""Text for people: a numbered listing and diagnostics of a response."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docketry.functions.text import mask_text
from docketry.sources.xml_records import RECORD_TAGS, first_record_tags, parse_tree
from docketry.operators.ranking import top

PREVIEW_BYTES = 1200


def heading(word: str, technology: str, count: int) -> list[str]:
    """What was searched, what it is scored against, and how many records came, best first."""
    return [f"Search: {word}", f"Scored against: {technology}", f"Records: {count}, highest score first"]


# Fields of a response that tell its result.
RESULT_FIELDS = ("resultCode", "resultMsg", "successYN")


def listing(scored: DataFrame, n: int = 20, order: str = "ord") -> list[str]:
    """Lines for the first ``n`` records (at most 1,000); only these rows reach the driver."""
    rows = top(scored, min(n, 1000), order).collect()
    return [
        f"{i}. {r.title} | {r.application_number} | {r.applicant} | relevance_score={r.relevance_score} | "
        f"{r.review_priority} | matched_concepts={r.matched_concepts} | {r.score_reason}"
        for i, r in enumerate(rows, 1)
    ]


def diagnostics(status: int, body: bytes, secret: str = "") -> list[str]:
    """HTTP status, result fields, node counts, tags of the first record and a masked preview of a response."""
    root = parse_tree(body)
    texts: dict[str, str] = {}
    counts = dict.fromkeys(RECORD_TAGS, 0)
    for node in root.iter():
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        texts.setdefault(name, " ".join("".join(node.itertext()).split()))
        if name in counts:
            counts[name] += 1
    lines = [f"HTTP status: {status}", *[f"{f}: {texts.get(f, '')}" for f in RESULT_FIELDS]]
    lines += [f"<{tag}> nodes: {n}" for tag, n in counts.items()]
    lines += ["Tags of the first record: " + ", ".join(first_record_tags(body)), "Start of the response:", preview(body, secret)]
    return [f"[DEBUG] {mask_text(line, secret)}" for line in lines]


def preview(body: bytes, secret: str = "") -> str:
    """The start of a response body with secrets masked."""
    return mask_text(body[:PREVIEW_BYTES].decode("utf-8-sig", errors="replace"), secret)
