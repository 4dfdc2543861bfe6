"""The conjunctive filter of a search, as one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import model


@dataclass(frozen=True)
class Filters:
    """Conditions that all must hold; none given lets every row pass."""

    projects: tuple[str, ...] | None = None
    source_type: str | None = None
    kind: str | None = None
    after: str | None = None
    before: str | None = None

    def active(self) -> bool:
        return any(x is not None for x in (self.projects, self.source_type, self.kind, self.after, self.before))

    def needs_documents(self) -> bool:
        """A filter on the kind alone is a column of chunks; a join with documents isn't built for it."""
        return any(x is not None for x in (self.projects, self.source_type, self.after, self.before))

    def predicate(self) -> Column:
        conds = []
        if self.projects is not None:
            conds.append(F.lower("project").isin([p.lower() for p in self.projects]))
        if self.source_type is not None:
            conds.append(F.col("source_type") == self.source_type)
        if self.kind is not None:
            conds.append(F.col("kind") == self.kind)
        dated = F.col("doc_date").isNotNull() & (F.col("doc_date") != "")
        if self.after is not None:
            conds.append(dated & (F.col("doc_date") >= self.after))
        if self.before is not None:
            conds.append(dated & (F.col("doc_date") <= self.before))
        return reduce(lambda a, b: a & b, conds, F.lit(True))

    def skips_vectors(self) -> bool:
        """Tool events have no vectors."""
        return self.kind == model.TOOL_EVENT
