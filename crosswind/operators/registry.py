"""Experiments, holdout accesses and budgets.

An experiment store is a log of Parquet rows: recording a family appends one file, a status change another, and the latest
row of an experiment counts. Parents are kept as factor ids and found by either kind of id.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.sources.panels import settled

EXPERIMENTS = (
    "experiment_id string, parent_id string, family string, factor_id string, expression string, expression_hash string, generator string, created_at string, git_commit string, git_dirty int, command string, config_json string, "
    "dataset_fingerprint string, universe_fingerprint string, seed int, train_end string, valid_end string, status string, failure_reason string, holdout_viewed int, llm_model string, prompt_hash string, metrics_json string, artifacts_json string"
)
ACCESSES = "family string, experiment_id string, accessed_at string, reason string"
COLUMNS = [c.split()[0] for c in EXPERIMENTS.split(", ")]


def now() -> str:
    return datetime.now(UTC).isoformat()


def git_provenance(root: str | Path | None = None) -> dict:
    """Commit and whether the tree is changed; None where git can't tell."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    changed = git("status", "--porcelain")
    return {"git_commit": git("rev-parse", "HEAD"), "git_dirty": None if changed is None else bool(changed)}


class Registry:
    def __init__(self, spark: SparkSession, path: str, root: str | Path | None = None):
        self.spark, self.path, self.root = spark, path.rstrip("/"), root

    def _append(self, table: str, rows: list[dict], schema: str) -> None:
        if rows:
            stamp = datetime.now(UTC).timestamp()
            df = self.spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) + (stamp, k) for k, r in enumerate(rows)], schema + ", seq double, place int")
            df.coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        schema += ", seq double, place int"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def record(self, rows: Iterable[dict]) -> list[str]:
        """Appends experiments, all of a family at once; ids are given to those without."""
        prov, full = git_provenance(self.root), []
        for r in rows:
            r = {"experiment_id": uuid4().hex, "created_at": now(), "status": "recorded", "holdout_viewed": 0, "git_commit": prov["git_commit"], "git_dirty": None if prov["git_dirty"] is None else int(prov["git_dirty"])} | r
            for name in ("family", "factor_id", "expression", "expression_hash"):
                if not r.get(name):
                    raise ValueError(f"an experiment needs {name}")
            full.append(r)
        self._append("experiments", full, EXPERIMENTS)
        return [r["experiment_id"] for r in full]

    def experiments(self) -> DataFrame:
        """The latest row of each experiment."""
        w = Window.partitionBy("experiment_id").orderBy(F.desc("seq"), F.desc("place"))
        return self._read("experiments", EXPERIMENTS).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*COLUMNS)

    def get(self, experiment_id: str) -> dict | None:
        row = self.experiments().filter(F.col("experiment_id") == experiment_id).first()
        return row.asDict() if row else None

    def list(self, family: str | None = None, status: str | None = None) -> DataFrame:
        df = self.experiments()
        df = df.filter(F.col("family") == family) if family else df
        df = df.filter(F.col("status") == status) if status else df
        return df.orderBy("created_at", "experiment_id")

    def update(self, changes: dict[str, dict]) -> None:
        """New values (status, metrics_json, ...) by experiment id."""
        rows = {r["experiment_id"]: r.asDict() for r in self.experiments().filter(F.col("experiment_id").isin(list(changes))).collect()}
        self._append("experiments", [rows[k] | v for k, v in changes.items() if k in rows], EXPERIMENTS)

    def family_trial_count(self, family: str) -> int:
        return self.experiments().filter(F.col("family") == family).count()

    def lineage(self, experiment_id: str) -> list[dict]:
        """The experiment, its parent, and so on; a loop ends the chain."""
        rows, chain, seen = self.experiments(), [], set()
        key = experiment_id
        while key and key not in seen:
            seen.add(key)
            got = rows.filter((F.col("experiment_id") == key) | (F.col("factor_id") == key)).orderBy("created_at").first()
            if got is None:
                break
            chain.append(got.asDict())
            key = got["parent_id"]
        return chain

    def generations(self) -> DataFrame:
        """factor_id, generations (how many parents there are up to the first) and root of every experiment, of all families at
        once: each round doubles how far everyone has climbed, so the rounds grow with the logarithm of the longest chain. Parents
        are factor ids; NULLs on a loop."""
        rows = self.experiments().select("factor_id", "parent_id").dropDuplicates(["factor_id"])
        known = rows.select(F.col("factor_id").alias("parent_id"), F.lit(True).alias("known"))
        rows = rows.join(known, "parent_id", "left")
        up = settled(rows.select(F.col("factor_id").alias("node"), F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("factor_id")).alias("up"), F.coalesce("known", F.lit(False)).cast("long").alias("steps")))
        far, before = 1, None
        while True:
            now = up.agg(F.count(F.lit(1)).alias("n"), F.sum("steps").alias("steps")).first()
            if now["steps"] == before or far > 2 * max(1, now["n"]):
                break
            before, far = now["steps"], 2 * far
            nxt = up.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
            up = settled(up.join(nxt, "up").select("node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        top = up.filter("steps = 0").select(F.col("node").alias("up"), F.col("node").alias("root"))
        return up.join(top, "up", "left").select(F.col("node").alias("factor_id"), F.when(F.col("root").isNotNull(), F.col("steps")).alias("generations"), "root")

    def record_holdout_access(self, family: str, experiment_id: str | None = None, reason: str = "") -> None:
        self._append("holdout_access", [{"family": family, "experiment_id": experiment_id, "accessed_at": now(), "reason": reason}], ACCESSES)
        if experiment_id:
            self.update({experiment_id: {"holdout_viewed": 1}})

    def holdout_access_count(self, family: str | None = None) -> int:
        df = self._read("holdout_access", ACCESSES)
        return (df.filter(F.col("family") == family) if family else df).count()


@dataclass(frozen=True)
class DataSplit:
    """train up to train_end, valid up to valid_end, test behind, up to test_end; forward is what comes after."""

    train_end: object
    valid_end: object
    test_end: object = None

    def condition(self, part: str):
        ts, end = F.col("ts"), F.lit(self.test_end)
        if part == "train":
            return ts <= F.lit(self.train_end)
        if part == "valid":
            return (ts > F.lit(self.train_end)) & (ts <= F.lit(self.valid_end))
        if part == "test":
            return (ts > F.lit(self.valid_end)) & (ts <= end if self.test_end is not None else F.lit(True))
        if part == "forward":
            return ts > end if self.test_end is not None else F.lit(False)
        raise ValueError(f"no part {part!r}")


def split_by_fraction(panel: DataFrame, train: float = 0.6, valid: float = 0.2) -> DataSplit:
    times = panel.select("ts").distinct().withColumns({"k": F.row_number().over(Window.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    cut = lambda share: F.max(F.when(F.col("k") <= F.greatest(F.floor(F.col("n") * share) - 1, F.lit(0)), F.col("ts")))
    row = times.agg(cut(train).alias("a"), cut(train + valid).alias("b"), F.max("ts").alias("c")).first()
    return DataSplit(row["a"], row["b"], row["c"])


class BudgetExceeded(RuntimeError):
    pass


@dataclass(frozen=True)
class Budget:
    candidates: int = 200
    holdout_per_family: int = 3
    holdout_total: int = 10


class HoldoutGovernor:
    def __init__(self, registry: Registry, split: DataSplit, budget: Budget = Budget()):
        self.registry, self.split, self.budget = registry, split, budget

    def check_candidates(self, family: str, more: int = 1) -> None:
        if self.registry.family_trial_count(family) + more > self.budget.candidates:
            raise BudgetExceeded(f"{family}: more than {self.budget.candidates} candidates")

    def locked_test(self, panel: DataFrame, family: str, experiment_id: str | None = None, reason: str = "") -> DataFrame:
        """The test part; every look is recorded first, and refused beyond the budget."""
        if self.registry.holdout_access_count(family) >= self.budget.holdout_per_family or self.registry.holdout_access_count() >= self.budget.holdout_total:
            raise BudgetExceeded(f"{family}: the test part was looked at too often")
        self.registry.record_holdout_access(family, experiment_id, reason)
        return panel.filter(self.split.condition("test"))


def as_json(value) -> str:
    return json.dumps(value, sort_keys=True, default=str)
