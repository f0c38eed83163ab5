"""Relations as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datarill.functions.domains import Domain

#: Tuples that are printed at most; the rest is counted.
SHOWN = 100


def tuples_text(name: str, df: DataFrame, attributes: list[str], domains: list[Domain | None], shown: int = SHOWN) -> str:
    """The count, the first tuples in order as (attribute=name(element),...), and how many more there are."""
    total = df.count()
    lines = [f"Tuples in {name}: ({total})"]
    for row in df.orderBy(*[f"`{c}`" for c in df.columns]).limit(shown).collect() if df.columns else []:
        lines.append("(" + ",".join(f"{a}={d.label(v) if d else v}" for a, d, v in zip(attributes, domains, row)) + ")")
    if total > shown:
        lines.append(f"and more ({total} in total)")
    return "\n".join(lines)
