"""Search plans: filters, gender pools and outfit groups as subqueries. Driver-side, a handful of rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab

#: Soft filters in the order they are given up; gender and category never are.
RELAX_ORDER = ("min_rating", "sentiment", "style", "size", "color")
#: A search with fewer results gives up a filter.
ENOUGH = 5
#: Candidates reranked over all subqueries, and nearest rows fetched per subquery.
RERANK_BUDGET, FETCH, FETCH_OUTFIT, FETCH_ACCESSORIES = 48, 60, 10, 40


@dataclass(frozen=True)
class Filters:
    gender: str | None = None
    category: str | None = None
    color: str | None = None
    style: str | None = None
    size: str | None = None
    min_rating: float | None = None
    sentiment: str | None = None
    #: Genders left out; without effect where ``gender`` is set.
    exclude_genders: tuple[str, ...] = ()
    #: Any of these categories; without effect where ``category`` is set.
    categories: tuple[str, ...] = ()

    def soft(self) -> list[str]:
        return [n for n in RELAX_ORDER if getattr(self, n) is not None]

    def hard_predicate(self) -> Column:
        """What a row must meet whatever is given up. A row without a gender isn't excluded by one."""
        tests = []
        if self.gender is not None:
            tests.append(F.col("gender") == self.gender)
        elif self.exclude_genders:
            tests.append(F.col("gender").isNull() | ~F.col("gender").isin(list(self.exclude_genders)))
        if self.category is not None:
            tests.append(F.col("category") == self.category)
        elif self.categories:
            tests.append(F.col("category").isin(list(self.categories)))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return F.coalesce(out, F.lit(False))

    def soft_test(self, name: str) -> Column:
        """Whether a row meets one soft filter; a missing value doesn't."""
        value = getattr(self, name)
        test = F.col("average_rating") >= value if name == "min_rating" else F.col("overall_sentiment" if name == "sentiment" else name) == value
        return F.coalesce(test, F.lit(False))

    def predicate(self) -> Column:
        """All filters at once; without filters, every row."""
        out = self.hard_predicate()
        for n in self.soft():
            out = out & self.soft_test(n)
        return out

    def level(self, all_at_once: bool) -> Column:
        """How many soft filters, in their order, must be given up before the row passes."""
        level = F.lit(0)
        for step, n in enumerate(self.soft(), 1):
            level = F.greatest(level, F.when(self.soft_test(n), 0).otherwise(1 if all_at_once else step))
        return level

    def steps(self, all_at_once: bool) -> int:
        return min(len(self.soft()), 1) if all_at_once else len(self.soft())

    def after(self, level: int, all_at_once: bool) -> Filters:
        """The filters left once ``level`` steps were taken."""
        gone = self.soft() if all_at_once and level else self.soft()[:level]
        return replace(self, **{n: None for n in gone})

    def applied(self) -> dict[str, object]:
        """Filters as shown to the caller."""
        shown = ("gender", "category", "color", "style", "size", "min_rating", "sentiment")
        return {n: getattr(self, n) for n in shown if getattr(self, n) is not None}


@dataclass(frozen=True)
class Subquery:
    number: int
    pool: int
    group: str | None
    filters: Filters


def gender_pools(filters: Filters) -> list[Filters]:
    """One pool for a set gender or a garment only women wear, else all others and men apart."""
    if filters.gender is not None:
        return [filters]
    others = replace(filters, exclude_genders=("men", "kids"))
    return [others] if filters.category in vocab.WOMEN_ONLY else [others, replace(filters, gender="men")]


def subqueries(filters: Filters, outfit: bool = False) -> list[Subquery]:
    """Pools times outfit groups, pool by pool. An outfit search drops style and category."""
    groups = list(vocab.OUTFIT_GROUPS) if outfit else [None]
    out = []
    for pool, base in enumerate(gender_pools(filters)):
        for group in groups:
            own = base if group is None else replace(base, style=None, category=None, categories=tuple(vocab.OUTFIT_GROUPS[group]))
            out.append(Subquery(len(out), pool, group, own))
    return out


def fetch_size(group: str | None) -> int:
    return FETCH if group is None else FETCH_ACCESSORIES if group == "accessories" else FETCH_OUTFIT


def rerank_share(n: int) -> int:
    """Candidates each of n subqueries may send to the reranker."""
    return max(2, RERANK_BUDGET // n)
