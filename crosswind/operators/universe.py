"""Who may be traded when: membership (ts, symbol, member), known one bar late."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.functions.kernels import over_symbol

KINDS = ("static", "point_in_time", "survivorship_stressed", "research_only")


def static(panel: DataFrame) -> DataFrame:
    return panel.select("ts", "symbol", F.lit(True).alias("member"))


def survivorship_stressed(membership: DataFrame, deaths: DataFrame) -> DataFrame:
    """Membership without symbols from their death on. deaths: (symbol, death), a row for each at most."""
    rows = membership.join(deaths, "symbol", "left")
    return rows.select("ts", "symbol", (F.coalesce("member", F.lit(False)) & F.coalesce(F.col("ts") < F.col("death"), F.lit(True))).alias("member"))


def eligibility(membership: DataFrame) -> DataFrame:
    """(ts, symbol, eligible): member at the bar before; nobody at the first."""
    return membership.select("ts", "symbol", F.coalesce(F.lag("member", 1).over(over_symbol()), F.lit(False)).alias("eligible"))


def masked(scores: DataFrame, membership: DataFrame) -> DataFrame:
    """scores with NULL where the cell isn't eligible."""
    rows = scores.join(eligibility(membership), ["ts", "symbol"], "left")
    return rows.withColumn("score", F.when(F.coalesce("eligible", F.lit(False)), F.col("score"))).drop("eligible")


@dataclass(frozen=True)
class Universe:
    """A membership with its name and kind, which say how far it may be trusted."""

    name: str
    kind: str
    membership: DataFrame

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no kind of universe: {self.kind}")

    def eligibility(self) -> DataFrame:
        return eligibility(self.membership)

    def apply(self, scores: DataFrame) -> DataFrame:
        return masked(scores, self.membership)

    def fingerprint(self) -> str:
        """32 hexadecimal digits that tell universes apart, whatever the order of rows."""
        h = F.xxhash64("ts", "symbol", F.coalesce("member", F.lit(False)))
        row = self.membership.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        return hashlib.sha256("|".join(map(str, (self.name, self.kind, *row))).encode()).hexdigest()[:32]


def static_universe(panel: DataFrame, name: str = "static") -> Universe:
    return Universe(name, "static", static(panel))


def point_in_time_universe(membership: DataFrame, name: str = "pit") -> Universe:
    """A membership known as of each bar."""
    return Universe(name, "point_in_time", membership)


def stressed_universe(membership: DataFrame, deaths: DataFrame, name: str = "survivorship") -> Universe:
    return Universe(name, "survivorship_stressed", survivorship_stressed(membership, deaths))


def research_only(membership: DataFrame, name: str = "research_only") -> Universe:
    """An approximation, named so that nobody takes it for one known as of each bar."""
    return Universe(name, "research_only", membership)
