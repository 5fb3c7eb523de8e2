"""Commands of the factor engine: python -m crosswind.cli data validate, factor evaluate EXPR, pipeline run, ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crosswind.operators import agent, dedup, export, generate, robustness, study
from crosswind.operators.analytics import ic_series
from crosswind.operators.preprocess import preprocessed
from crosswind.operators.registry import Registry
from crosswind.plans.compiler import check, family_scores
from crosswind.plans.language import make_factor
from crosswind.sources import panels


def _spark() -> SparkSession:
    return SparkSession.builder.appName("crosswind").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _panel(a):
    spark = _spark()
    return panels.read_csv_dir(spark, a.csv_dir) if a.csv_dir else panels.synthetic(spark, n_days=getattr(a, "n_days", 400), seed=a.seed)


def _print(value) -> int:
    print(json.dumps(value, indent=2, default=str))
    return 0


def data_validate(a) -> int:
    p = _panel(a)
    row = p.agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("ts").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end")).first().asDict()
    return _print(row | {"fingerprint": panels.fingerprint(p)})


def factor_validate(a) -> int:
    try:
        spec = make_factor("cli", a.expression)
        check(spec.tree)
    except ValueError as x:
        print(f"INVALID: {x}")
        return 1
    return _print({k: getattr(spec, k) for k in ("canonical_expression", "expression_hash", "required_fields", "max_lookback", "complexity_score")})


def factor_evaluate(a) -> int:
    metrics, scores, ls = study.evaluate_family(_panel(a), [make_factor("cli", a.expression)], a.horizon)
    return _print(metrics["cli"])


def factor_compare(a) -> int:
    scores = preprocessed(family_scores(_panel(a), [make_factor("a", a.first), make_factor("b", a.second)]))
    row = dedup.score_correlations(scores).first()
    return _print({"correlation": row["rho"] if row else None, "overlap": row["overlap"] if row else 0})


def factor_robustness(a) -> int:
    params = tuple(int(x) for x in a.params.split(",")) if a.params else ()
    r = robustness.robustness_report(_panel(a), a.expression, a.template, params, a.horizon)
    return _print(vars(r) | {"passes": r.passes})


def factor_walkforward(a) -> int:
    name = f"fwd_{a.horizon}"
    scores = preprocessed(family_scores(panels.with_forward(_panel(a), a.horizon), [make_factor("cli", a.expression)], (name,)))
    rows = robustness.walk_forward(ic_series(scores.withColumn("fwd", F.col(name))), a.windows).orderBy("window").collect()
    return _print([r.asDict() for r in rows])


def generate_templates(a) -> int:
    for s in generate.from_templates():
        print(f"{s.factor_id}\t{s.expression}\t{s.expression_hash}")
    return 0


def experiment_list(a) -> int:
    for r in Registry(_spark(), a.registry).list(a.family, a.status).collect():
        print(f"{r['experiment_id']}\t{r['family']}\t{r['factor_id']}\t{r['status']}")
    return 0


def experiment_show(a) -> int:
    row = Registry(_spark(), a.registry).get(a.id)
    return _print(row) if row else 1


def agent_run(a) -> int:
    families = a.families.split(",") if a.families else None
    r = agent.ResearchAgent(_panel(a), Registry(_spark(), a.registry), families, a.budget, generate.MockProvider() if a.ai else None, a.seed).run()
    print(r.summary())
    return 0


def export_bundle(a) -> int:
    print(export.write_contract(export.contract_of(a.dir), a.out or f"{a.dir.rstrip('/')}.v1.json"))
    return 0


def export_verify(a) -> int:
    v = export.validate_bundle(a.dir)
    print(v.summary())
    return 0 if v.ok else 1


def pipeline_run(a) -> int:
    families = a.families.split(",") if a.families else None
    return _print(agent.run_pipeline(_panel(a), a.out, Registry(_spark(), a.registry or f"{a.out}/registry"), families, generate.MockProvider() if a.ai else None, a.n_ai, not a.no_approve, a.seed))


def demo(a) -> int:
    done = agent.run_demo(panels.synthetic(_spark()), a.out, Registry(_spark(), f"{a.out}/registry"))
    print("\n".join(f"{r.spec.factor_id}\t{r.state.value}" for r in done.results))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crosswind")
    groups = top.add_subparsers(required=True)
    made: dict[str, argparse._SubParsersAction] = {}

    def command(path: str, run, *arguments: tuple, data: bool = False) -> None:
        *group, name = path.split()
        at = groups
        if group:
            if group[0] not in made:
                made[group[0]] = groups.add_parser(group[0]).add_subparsers(required=True)
            at = made[group[0]]
        p = at.add_parser(name)
        for names, more in arguments:
            p.add_argument(*names.split(), **more)
        if data:
            p.add_argument("--csv-dir")
            p.add_argument("--seed", type=int, default=7)
        p.set_defaults(run=run)

    expression, horizon, registry = ("expression", {}), ("--horizon", {"type": int, "default": 1}), ("--registry", {"default": "registry"})
    command("data validate", data_validate, data=True)
    command("factor validate", factor_validate, expression)
    command("factor evaluate", factor_evaluate, expression, horizon, data=True)
    command("factor compare", factor_compare, ("first", {}), ("second", {}), data=True)
    command("factor robustness", factor_robustness, expression, ("--template", {}), ("--params", {}), horizon, data=True)
    command("factor walkforward", factor_walkforward, expression, ("--windows", {"type": int, "default": 5}), horizon, data=True)
    command("generate templates", generate_templates)
    command("experiment list", experiment_list, registry, ("--family", {}), ("--status", {}))
    command("experiment show", experiment_show, ("id", {}), registry)
    command("research-agent run", agent_run, registry, ("--families", {}), ("--budget", {"type": int, "default": 12}), ("--n-days", {"type": int, "default": 400}), ("--ai", {"action": "store_true"}), ("--ai-model", {"default": "mock"}), data=True)
    command("export bundle", export_bundle, ("dir", {}), ("--out", {}))
    command("export verify", export_verify, ("dir", {}))
    command("pipeline run", pipeline_run, ("--out", {"required": True}), ("--registry", {}), ("--families", {}), ("--ai", {"action": "store_true"}), ("--n-ai", {"type": int, "default": 1}), ("--no-approve", {"action": "store_true"}), data=True)
    command("demo", demo, ("--out", {"required": True}))
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
