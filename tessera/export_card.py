"""Exports one sequence card: python -m tessera.export_card --cards PATH (--id ID | --sequence SEQUENCE) [--out FOLDER] [--html]"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from .functions.sequences import normalize_sequence, sequence_id
from .operators.cards import export_html
from .session import local_session


def found(spark, path: str, identifier: str | None, sequence: str | None) -> dict | None:
    """The card of an id or a raw sequence in JSON lines under path, or None."""
    lines = spark.read.text(path)
    wanted = F.lit(identifier) if identifier is not None else sequence_id(normalize_sequence(F.lit(sequence)))
    row = lines.where(F.get_json_object("value", "$.id") == wanted).first()
    return json.loads(row["value"]) if row else None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--cards", required=True)
    one = parser.add_mutually_exclusive_group(required=True)
    one.add_argument("--id")
    one.add_argument("--sequence")
    parser.add_argument("--out")
    parser.add_argument("--html", action="store_true")
    args = parser.parse_args(argv)
    card = found(local_session(), args.cards, args.id, args.sequence)
    if card is None:
        print("no such card", file=sys.stderr)
        return 1
    text = export_html(card) if args.html else json.dumps(card, ensure_ascii=False, indent=2)
    if not args.out:
        print(text)
        return 0
    os.makedirs(args.out, exist_ok=True)
    place = os.path.join(args.out, f"{card['id']}.{'html' if args.html else 'json'}")
    with open(f"{place}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{place}.part", place)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
