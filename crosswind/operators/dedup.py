"""Is a factor new? Equal hashes, correlated scores, and a family name from its operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswind.plans.language import Call, Const, fields_used, ops_used, walk

# The names of families.
FAMILIES = ("momentum", "reversal", "volatility", "liquidity", "volume", "trend", "quality", "value", "size", "seasonality", "interaction", "regime", "skewness", "unknown")


def syntactic_duplicates(spec, others) -> list[str]:
    return [o.factor_id for o in others if o.factor_id != spec.factor_id and o.expression_hash == spec.expression_hash]


def _moments(names: list[str]):
    """For mapInArrow over rows of a cell's scores (a list in the order of names, null where there is none): of each pair of
    factors the number of cells that both have, and the sums that a correlation needs, a row per pair and task."""

    def run(batches):
        f = len(names)
        total = np.zeros((6, f, f))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, f)
            known = ~np.isnan(x)
            own, z = known.astype(float), np.where(known, x, 0.0)
            total += np.stack([own.T @ own, z.T @ own, own.T @ z, (z * z).T @ own, own.T @ (z * z), z.T @ z])
        i, j = np.triu_indices(f, 1)
        columns = [pa.array([names[k] for k in i], pa.string()), pa.array([names[k] for k in j], pa.string()), *(pa.array(m[i, j]) for m in total)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return run


def score_correlations(scores: DataFrame, min_overlap: int = 30) -> DataFrame:
    """a, b (factor ids, a < b), overlap and rho over all cells that both have; rho NULL below min_overlap or without spread.

    Cells meet on (ts, symbol): a row per cell with the scores of all factors. Each task adds up a matrix of moments over its
    cells, so what is shuffled behind it is a row per pair and task, whatever the number of cells.
    """
    names = sorted(r[0] for r in scores.select("factor_id").distinct().collect())  # a name for each factor
    if len(names) < 2:
        return scores.sparkSession.createDataFrame([], "a string, b string, overlap long, rho double")
    own = [F.max(F.when(F.col("factor_id") == n, F.col("score"))) for n in names]
    cells = scores.filter("score IS NOT NULL").groupBy("ts", "symbol").agg(F.array(*own).alias("all"))
    sums = cells.select("all").mapInArrow(_moments(names), "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    sums = sums.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).filter("n > 0")
    spread = lambda q, m, k: F.col(q) - F.col(m) * F.col(k) / F.col("n")
    sx, sy = spread("xx", "x", "x"), spread("yy", "y", "y")
    flat = (sx <= F.col("xx") * 1e-12) | (sy <= F.col("yy") * 1e-12)
    rho = F.when((F.col("n") >= min_overlap) & ~flat, F.try_divide(spread("xy", "x", "y"), F.sqrt(sx * sy)))
    return sums.select("a", "b", F.col("n").cast("long").alias("overlap"), rho.alias("rho"))


def correlated(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with |rho| of threshold or more, strongest first."""
    return correlations.filter(F.abs("rho") >= threshold).orderBy(F.desc(F.abs("rho")), "a", "b")


def nearest(correlations: DataFrame) -> DataFrame:
    """For each factor the other one that it correlates with most."""
    both = correlations.select("a", "b", "rho").union(correlations.select("b", "a", "rho")).filter("rho IS NOT NULL")
    w = Window.partitionBy("a").orderBy(F.desc(F.abs("rho")), "b")
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(F.col("a").alias("factor_id"), F.col("b").alias("nearest"), "rho")


@dataclass(frozen=True)
class Novelty:
    factor_id: str
    family: str
    same: list[str]
    alike: list[tuple[str, float]]

    @property
    def nearest(self) -> tuple[str, float] | None:
        return self.alike[0] if self.alike else None

    @property
    def duplicate(self) -> bool:
        return bool(self.same or self.alike)


def novelty(specs: list, scores: DataFrame, threshold: float = 0.7, min_overlap: int = 30) -> dict[str, Novelty]:
    """For each factor: its family, the others with its hash, and those it correlates with by threshold or more, strongest first.
    One plan for the whole family; a row reaches the driver for each pair that is alike."""
    alike: dict[str, list[tuple[str, float]]] = {}
    for r in correlated(score_correlations(scores, min_overlap), threshold).collect():
        alike.setdefault(r["a"], []).append((r["b"], r["rho"]))
        alike.setdefault(r["b"], []).append((r["a"], r["rho"]))
    return {s.factor_id: Novelty(s.factor_id, classify(s.tree), syntactic_duplicates(s, specs), alike.get(s.factor_id, [])) for s in specs}


def _soon_negated(node) -> bool:
    """Whether a return or change over five bars or fewer is negated somewhere."""
    inner = (x.args[0] for x in walk(node) if isinstance(x, Call) and x.op == "neg" and isinstance(x.args[0], Call))
    return any(x.op in ("ts_returns", "ts_delta") and isinstance(x.args[1], Const) and x.args[1].value <= 5 for x in inner)


# Families by what a tree holds, the first row that fits. A row: the family, operators of which one must be there
# (none: any), fields that must all be there, and a further test.
RULES = (
    ("liquidity", "ts_mean cs_rank divide", "volume close", None),
    ("volume", "ts_mean cs_rank divide", "volume", None),
    ("skewness", "ts_skew", "", None),
    ("reversal", "ts_zscore", "close", None),
    ("trend", "ts_argmax ts_argmin", "", None),
    ("volatility", "ts_std ts_downside_std", "", None),
    ("reversal", "", "", _soon_negated),
    ("momentum", "ts_returns ts_delta", "close", None),
    ("trend", "ts_mean ts_ewm", "close", None),
    ("interaction", "ts_corr ts_cov", "", None),
    ("unknown", "", "", None),
)


def classify(node) -> str:
    """The family that the operators and fields of a tree suggest, by RULES."""
    ops, fields = set(ops_used(node)), set(fields_used(node))
    fits = lambda any_of, needs, test: (not any_of or ops & set(any_of.split())) and fields >= set(needs.split()) and (test is None or test(node))
    return next(family for family, *rule in RULES if fits(*rule))
