"""``python -m corpusloom build FOLDER INDEX`` and ``python -m corpusloom remove INDEX --title TITLE``: an index from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from . import config
from .operators import maintenance
from .streaming import ingest


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """The exit code: 0, or 2 for a rebuild that is refused. What was done is printed as JSON."""
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="take in the new files of a folder")
    build.add_argument("folder")
    build.add_argument("index")
    build.add_argument("--rebuild", action="store_true", help="make the index anew from the folder")
    build.add_argument("--force", action="store_true", help="rebuild even where the folder lacks indexed books")
    remove = commands.add_parser("remove", help="take books out of an index")
    remove.add_argument("index")
    remove.add_argument("--title", action="append", required=True, help="a book's whole title; may be repeated")
    remove.add_argument("--dry-run", action="store_true", help="only say what would change")
    asked = parser.parse_args(argv)
    spark = spark or config.session()
    try:
        if asked.command == "build":
            done = ingest.build(spark, asked.folder, asked.index, asked.rebuild, asked.force)
        else:
            index = maintenance.Snapshots(spark, asked.index, "chunks")
            with index.lock():
                index.recover()
                done = maintenance.remove_from_index(index, asked.title, asked.dry_run)
    except ingest.RebuildRefused as refused:
        print(refused, file=sys.stderr)
        return 2
    print(json.dumps(done, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
