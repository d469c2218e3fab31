"""Command line: ``python -m pairlight COMMAND CONFIG`` (``validate``: a JSONL file; ``download``: URL and folder)."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    from pairlight.plans import pipelines

    parser = argparse.ArgumentParser(prog="pairlight", description=__doc__)
    parser.add_argument("command", choices=[*pipelines.RUNS, "download", "health"])
    parser.add_argument("argument", nargs="*")
    args = parser.parse_args(argv)
    if args.command == "health":
        print("ok")
        return 0
    if args.command == "download":
        print(json.dumps(pipelines.download(*args.argument), indent=2))
        return 0
    from pyspark.sql import SparkSession

    from pairlight.session import SETTINGS
    from pairlight.ship import ship

    spark = SparkSession.builder.appName(f"pairlight-{args.command}").config(map=SETTINGS).getOrCreate()
    ship(spark)
    got = pipelines.RUNS[args.command](spark, args.argument[0])
    if args.command == "validate":
        for row in got:
            print(f"uid={row['uid']}: {row['errors']}")
        return 1 if got else 0
    print(json.dumps(got, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
