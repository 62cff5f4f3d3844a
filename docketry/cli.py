"""``python -m docketry.cli WORD --technology PHRASE``: search, score, rank, export."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from docketry.functions.text import mask_text
from docketry.operators.ranking import ranked
from docketry.operators.scoring import score_records
from docketry.session import local_session
from docketry.sinks.console import diagnostics, heading, listing
from docketry.sinks.csv import write_csv_file
from docketry.sources.rest import KEY_VARIABLE, MAX_COUNT, search
from docketry.sources.xml_records import RECORD_SCHEMA, parse_tree, records_of


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Search records, score them against a technology, write a CSV.")
    parser.add_argument("word")
    parser.add_argument("--technology", required=True)
    parser.add_argument("--count", type=int, default=MAX_COUNT)
    parser.add_argument("--folder", help="read saved responses from this folder instead of the network")
    parser.add_argument("--output", default="outputs")
    parser.add_argument("--debug", action="store_true", help="print what the response holds")
    args = parser.parse_args(argv)
    secret = os.environ.get(KEY_VARIABLE, "")
    try:
        if not args.technology.strip():
            raise ValueError("A technology to score against is required.")
        spark = local_session()
        # One request, whose single row is at most MAX_COUNT records; all that follows reads this row.
        answer = search(spark, args.word, args.count, args.folder, form="response").first()
        body = bytes(answer.body)
        records = list(records_of(parse_tree(body)))
        if args.debug:
            print("\n".join(diagnostics(answer.http_status, body, secret)))
        if not records:
            print("The search gave nothing to rank, so there is no CSV.", file=sys.stderr)
            return 1
        found = spark.createDataFrame(records, RECORD_SCHEMA).withColumnRenamed("pos", "ord")
        scored = score_records(found, args.technology)
        path = write_csv_file(ranked(scored), args.output, f"ranked_{datetime.now():%Y%m%d_%H%M%S}.csv")
        lines = heading(args.word, args.technology, len(records)) + listing(scored)
        print("\n".join(mask_text(line, secret) for line in lines), f"CSV: {path}", sep="\n")
        return 0
    except Exception as exc:  # noqa: BLE001 - one line for people, with the key masked
        print("Error: " + mask_text(str(exc).split("\n")[0], secret), file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
