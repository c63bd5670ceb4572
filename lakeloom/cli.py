"""``python -m lakeloom.cli ROOT``: a SQL shell; ``load KIND PATH`` upserts landed payloads."""

from __future__ import annotations

import argparse
import sys

from .plans.engine import Engine
from .session import build
from .sources import landing


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root", help="folder of the versioned tables")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("-c", "--command", action="append", help="run a statement and end")
    parser.add_argument("--series", help="folder of landed series payloads")
    parser.add_argument("--items", help="folder of landed item payloads")
    parser.add_argument("--limit", type=int, help="load the newest so many stories only")
    parser.add_argument("--no-comments", action="store_true")
    opts = parser.parse_args(args)
    spark = build()
    engine = Engine(spark, opts.root, opts.strict)
    if opts.series:
        landing.load(engine, "fred_observations", landing.observations(spark, opts.series)[0], "series")
    if opts.items:
        rows = landing.items(spark, opts.items)
        rows = rows.where("type <> 'comment'") if opts.no_comments else rows
        rows = rows.orderBy("time", ascending=False).limit(opts.limit) if opts.limit else rows
        landing.load(engine, "hn_items", rows, "items")
    if opts.command or opts.series or opts.items:
        for c in opts.command or []:
            print(*engine.execute(c), sep="\n")
        return 0
    for line in sys.stdin:
        if line.strip().lower() in ("exit", "quit"):
            break
        try:
            print(*engine.execute(line), sep="\n")
        except (ValueError, NotImplementedError, RuntimeError) as error:
            print("error:", error)
    return 0


if __name__ == "__main__":
    sys.exit(main())
