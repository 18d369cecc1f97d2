"""Command line: index a photo, query a code, show counts. Exit codes: 0 done or found, 1 not found, 2 wrong input."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession

from .service import Invalid, Missing, Service


def main(argv: list[str] | None = None, spark: SparkSession | None = None, factory=None, out=None) -> int:
    out = out or sys.stdout
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    index, query, stats = (commands.add_parser(x) for x in ("index", "query", "stats"))
    for p in (index, query, stats):
        p.add_argument("--index-dir", default="index")
    index.add_argument("photo")
    index.add_argument("--photo-id")
    query.add_argument("code")
    query.add_argument("--out")
    args = parser.parse_args(argv)
    service = Service(spark or SparkSession.builder.getOrCreate(), args.index_dir, factory)
    return {"index": _index, "query": _query, "stats": _stats}[args.command](service, args, out)


def _index(service: Service, args, out) -> int:
    if not Path(args.photo).exists():
        print(f"no such photo: {args.photo}", file=sys.stderr)
        return 2
    try:
        row = service.ingest(args.photo, datetime.now().isoformat(timespec="seconds"), args.photo_id or None).first()
    except Invalid as e:
        print(f"cannot index {args.photo}: {e}", file=sys.stderr)
        return 2
    rate = f" ({row['recognized'] / row['total']:.1%})" if row["total"] else ""
    print(f"{row['photo_id']}: {row['total']} pieces, {row['recognized']} recognized{rate}, {row['unrecognized']} not", file=out)
    return 0


def _query(service: Service, args, out) -> int:
    found, rows = service.query(args.code)
    if found:
        r = rows.first()
        print(f"{r['code']}: photo {r['photo_id']}, piece {r['piece_id']}, box {(r['x'], r['y'], r['w'], r['h'])}, confidence {r['confidence']:.2f}", file=out)
        if args.out:
            try:
                Path(args.out).write_bytes(service.highlight(args.code))
            except Missing:
                print("the photo's image cannot be read", file=sys.stderr)
        return 0
    left = rows.orderBy("photo_id").collect()
    print(f"{args.code} was not found" + ("" if left else ", and every piece is recognized"), file=out)
    for r in left:
        print(f"{r['photo_id']}: {r['n']} unrecognized: {r['piece_ids']}", file=out)
    return 1


def _stats(service: Service, args, out) -> int:
    rows = service.summary().orderBy("photo_id").collect()
    for r in rows:
        print(f"{r['photo_id']}: {r['recognized']}/{r['total']} {r['created_at']}", file=out)
    if not rows:
        print("the index is empty", file=out)
    return 0
