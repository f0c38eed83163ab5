"""Element names of a domain: one per line, the line's number is the element."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from datarill.functions.domains import ENUMERATION_LIMIT, DomainTooLarge
from datarill.sources.bdd import write_bdd


def read_map(spark: SparkSession, path: str) -> list[str]:
    """The names in a file that the driver reads; domains with names are held on the driver."""
    with open(path, encoding="utf-8", errors="replace") as file:
        return [line.rstrip("\r\n") for line in file]


def embedding(sizes: list[tuple[str, int]], inclusive: bool = False) -> dict[str, tuple[int, int]]:
    """Consecutive ranges (first, end) of a target for each domain; ``inclusive`` counts one more element each, as some builders do."""
    out, at = {}, 0
    for name, size in sizes:
        out[name] = (at, at + size + inclusive)
        at += size + inclusive
    return out


def write_maps(folder: str, target: tuple[str, int], domains: list[tuple[str, int]]) -> list[str]:
    """Writes map_<domain>_<target>.bdd for each domain: its elements 0 to size inclusive, in consecutive ranges of the target; returns what stands where."""
    out = []
    for name, (first, end) in embedding(domains, inclusive=True).items():
        size = end - first - 1
        if end > target[1] or size > ENUMERATION_LIMIT:
            raise DomainTooLarge(f"{name} doesn't fit into {target[0]} from {first} on")
        write_bdd([(x, first + x) for x in range(size + 1)], os.path.join(folder, f"map_{name}_{target[0]}.bdd"), [(name, size + 1), target])
        out.append(f"{name}[0..{size}] stands at {target[0]}[{first}..{end - 1}]")
    return out


def size_of(text: str) -> int:
    """A size that is given as a number, or as a map file with as many names."""
    if text.isdigit():
        return int(text)
    with open(text, encoding="utf-8", errors="replace") as file:
        return sum(1 for _ in file)
