"""Domains: sizes, element names, ranges of all elements, and embeddings of one domain in another."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarill.plans.ast import ProgramError

#: Elements or tuples of a full product that are enumerated at most.
ENUMERATION_LIMIT = 10_000_000


class DomainTooLarge(ProgramError):
    """Something needs all values of domains that are too large, or of an open one."""


@dataclass
class Domain:
    """Elements 0 .. size-1, maybe with names; an open domain (size None) takes any values and can't be enumerated."""

    name: str
    size: int | None
    names: list[str] = field(default_factory=list)
    offsets: dict[str, int] = field(default_factory=dict)
    taken: int | None = None

    def __post_init__(self) -> None:
        self._index = {}
        for i, n in enumerate(self.names):
            self._index.setdefault(n, i)

    @classmethod
    def from_column(cls, name: str, df: DataFrame, column: str, limit: int = 1_000_000) -> Domain:
        """A domain whose names are the distinct values of a column, in order."""
        rows = df.select(F.col(column).cast("string").alias("n")).where(F.col("n").isNotNull()).distinct().orderBy("n").limit(limit + 1).collect()
        if len(rows) > limit:
            raise DomainTooLarge(f"domain {name} has more than {limit} names")
        return cls(name, len(rows), [r["n"] for r in rows])

    def index(self, name: str, warnings: list[str] | None = None) -> int:
        """The element of a name; an unknown name is added, with a warning."""
        if name not in self._index:
            if warnings is not None:
                warnings.append(f"domain {self.name} has no element {name!r}; it is added")
            self.names.append(name)
            self._index[name] = len(self.names) - 1
            if self.size is not None and len(self.names) > self.size:
                self.size = len(self.names)
        return self._index[name]

    def label(self, element) -> str:
        """name(element), or the element alone."""
        if isinstance(element, int) and 0 <= element < len(self.names):
            return f"{self.names[element]}({element})"
        return str(element)

    def embed(self, other: Domain) -> int:
        """The offset at which other's elements stand in this domain; the next free ones when asked first."""
        if other.name not in self.offsets:
            if other.size is None or self.size is None:
                raise DomainTooLarge(f"{other.name} => {self.name} needs sizes")
            at = self.taken if self.taken is not None else len(self.names) or self.size
            count = len(other.names) or other.size
            if self.names:
                if at + count > self.size:
                    raise ProgramError(f"{self.name} can't hold the elements of {other.name}: {at} + {count} > {self.size}")
                for n in other.names:
                    self.names.append(n)
                    self._index.setdefault(n, len(self.names) - 1)
            else:
                self.size = max(self.size, at + count)
            self.taken = at + count
            self.offsets[other.name] = at
        return self.offsets[other.name]


def enumerate_values(spark: SparkSession, domains: list[Domain], what: str, limit: int = ENUMERATION_LIMIT) -> list[DataFrame]:
    """One single-column frame (_v) of all elements for each domain, if their product is within the limit."""
    product = 1
    for d in domains:
        if d.size is None:
            raise DomainTooLarge(f"{what} needs all values of the open domain {d.name}")
        product *= d.size
    if product > limit:
        raise DomainTooLarge(f"{what} needs {product} combinations of {', '.join(d.name for d in domains)}; the limit is {limit}")
    return [spark.range(d.size).select(F.col("id").alias("_v")) for d in domains]


def names_frame(spark: SparkSession, domain: Domain) -> DataFrame:
    """idx, name of a domain's named elements."""
    return spark.createDataFrame(list(enumerate(domain.names)), "idx long, name string")
