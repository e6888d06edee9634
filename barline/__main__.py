"""python -m barline sync FOLDER: brings the catalogue up to date from a folder of landed vendor files (see sources.vendor_files)."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from barline.operators.catalog import Catalog
from barline.plans import sync
from barline.schema import InsertMode
from barline.session import Settings, session
from barline.sources import vendor_files
from barline.sources.landing import VENDORS


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, dict[str, int]]:
    """Runs a command and gives (and prints) the counts of each table."""
    parser = argparse.ArgumentParser(prog="barline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("sync", help="insert what has landed")
    one.add_argument("folder")
    one.add_argument("--vendor", choices=sorted(VENDORS), default="terminal")
    one.add_argument("--kinds", nargs="*", help="tables to fill (default: all that the vendor has)")
    one.add_argument("--days", nargs=2, metavar=("FIRST", "LAST"), help="days of landing, yyyymmdd")
    one.add_argument("--mode", choices=[str(mode) for mode in InsertMode], default=str(InsertMode.IGNORE))
    one.add_argument("--database", default="market")
    one.add_argument("--settings", help="a file of settings")
    given = parser.parse_args(argv)

    spark = spark or session(settings=Settings.from_sources(given.settings))
    wanted = [table for table, _ in sync.ORDER if table in (given.kinds or VENDORS[given.vendor].kinds)]
    if unknown := set(given.kinds or ()) - set(VENDORS[given.vendor].kinds):
        parser.error(f"the vendor {given.vendor} has no {', '.join(sorted(unknown))}")
    with Catalog(spark, given.database) as market:
        # Files of lists and calendars hold many codes; those of bars, capital and dividends are one code's.
        landed = {table: vendor_files.landed(spark, given.folder, given.vendor, table, tuple(given.days) if given.days else None, many=table.endswith("_list")) for table in wanted}
        counts = sync.sync_all(market, landed, given.mode)
    print(json.dumps(counts))
    return counts


if __name__ == "__main__":
    main()
    sys.exit()
