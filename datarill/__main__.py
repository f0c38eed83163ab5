"""python -m datarill PROGRAM [FOLDER] solves a program; without a program it starts a session.

python -m datarill map FOLDER TARGET=SIZE DOMAIN=SIZE_OR_MAP_FILE ... writes diagrams that map domains into ranges of a target.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from datarill.engine import Engine
from datarill.session import main as interactive
from datarill.sources import maps


def main(args: list[str]) -> None:
    if args[:1] == ["map"]:
        target, *domains = [(name, maps.size_of(size)) for name, _, size in (a.partition("=") for a in args[2:])]
        print("\n".join(maps.write_maps(args[1], target, domains)))
        return
    spark = SparkSession.builder.appName("datarill").getOrCreate()
    if not args:
        interactive(spark)
        return
    with open(args[0], encoding="utf-8", errors="replace") as file:
        engine = Engine(spark, file.read(), include_dirs=[os.path.dirname(args[0]) or "."])
    for warning in engine.program.warnings:
        print("WARNING:", warning)
    print("\n".join(engine.save(args[1] if len(args) > 1 else ".")))


if __name__ == "__main__":
    main(sys.argv[1:])
