"""From factor trees to one DataFrame program.

All trees of a family share their equal sub-trees. Ready nodes are computed kind by kind: plain arithmetic in a projection,
then every time-series node whose arguments are there in one pass over symbols, then every cross-sectional one in one pass
over timestamps. A plan so has one exchange per alternation of the two kinds, however many factors it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.functions.kernels import ON_NUMBERS, OPERATORS, ScalarOperand, over_symbol, ratio
from crosswind.plans.language import Call, Const, Field, Node, canonical, is_scalar, walk, written


def number(node: Node) -> float:
    """The value of a tree of numbers."""
    if isinstance(node, Const):
        return node.value
    return ON_NUMBERS[node.op](*map(number, node.args))


def check(node: Node) -> None:
    """Raises ScalarOperand if a number stands where a panel is needed, or the whole is a number."""
    if is_scalar(node):
        raise ScalarOperand("the expression is a number, not a panel")


def padded_returns(x, keys: tuple[str, ...] = ()):
    """Helper and value of the ``returns`` field: change from the last known value to the last known one."""
    known = F.last(x, ignorenulls=True).over(over_symbol(keys))
    return known, lambda known: ratio(known, F.lag(known, 1).over(over_symbol(keys))) - 1


def evaluate(panel: DataFrame, factors: dict[str, Node], keep: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """panel's keys, ts, symbol, sym_ord and the columns in ``keep``, and a column of each factor by its name.

    keys: columns that separate panels in one frame (such as an original and a perturbed one).
    """
    names: dict[str, str] = {}
    todo: dict[str, Node] = {}
    for node in factors.values():
        check(node)
        for x in reversed(list(walk(canonical(node)))):
            if not is_scalar(x):
                todo.setdefault(written(x), x)
    fields = sorted({x.name for x in todo.values() if isinstance(x, Field)})
    stem = [*keys, "ts", "symbol", "sym_ord", *dict.fromkeys(keep)]
    bases = [f for f in fields if f != "returns"]
    df = panel.select(*stem, *(F.col(f).alias(f"f_{f}") for f in bases), *([F.col("close").alias("f_for_returns")] if "returns" in fields else []))
    for f in bases:
        names[f] = f"f_{f}"
    if "returns" in fields:
        known, finish = padded_returns(F.col("f_for_returns"), keys)
        df = df.withColumn("f_known", known)
        df = df.withColumn("f_returns", finish(F.col("f_known"))).drop("f_known", "f_for_returns")
        names["returns"] = "f_returns"
    todo = {k: x for k, x in todo.items() if isinstance(x, Call)}

    def args(x: Call) -> list:
        spec = OPERATORS[x.op]
        return [int(a.value) if i in spec.windows else number(a) if i in spec.scalars else F.lit(number(a)) if is_scalar(a) else F.col(names[written(a)]) for i, a in enumerate(x.args)]

    def ready(kind: str) -> list[tuple[str, Call]]:
        return [(k, x) for k, x in todo.items() if OPERATORS[x.op].kind == kind and all(is_scalar(a) or written(a) in names for a in x.args)]

    while todo:
        for kind in ("arith", "ts", "cs"):
            while batch := ready(kind):
                helpers, finals = {}, {}
                for k, x in batch:
                    spec, name = OPERATORS[x.op], f"n{len(names)}"
                    names[k] = name
                    del todo[k]
                    made = spec.helpers(*args(x), keys) if spec.helpers else {}
                    own = {h: f"{name}_{h}" for h in made}
                    helpers |= {own[h]: c for h, c in made.items()}
                    finals[name] = spec.finish(*args(x), keys, **{h: F.col(c) for h, c in own.items()})
                if helpers:
                    df = df.withColumns(helpers)
                df = df.withColumns(finals).drop(*helpers)
                if kind != "arith":
                    break  # arithmetic over these may come before more of the kind
            if kind != "arith" and ready("arith"):
                break
        else:
            if todo and not any(ready(k) for k in ("arith", "ts", "cs")):
                raise AssertionError("no node is ready")
    return df.select(*stem, *(F.col(names[written(canonical(node))]).alias(name) for name, node in factors.items()))


def long_scores(wide: DataFrame, ids: dict[str, str], keep: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each factor and cell: factor_id, keys, ts, symbol, sym_ord, the columns in keep, and score. ids: column by factor id."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("factor_id"), F.col(c).cast("double").alias("score")) for i, c in ids.items())))
    return wide.select(*keys, "ts", "symbol", "sym_ord", *dict.fromkeys(keep), rows.alias("_r")).select("_r.factor_id", *keys, "ts", "symbol", "sym_ord", *dict.fromkeys(keep), "_r.score")


def family_scores(panel: DataFrame, specs: list, keep: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Long scores of all specs in one plan."""
    ids = {s.factor_id: f"s{k}" for k, s in enumerate(specs)}
    return long_scores(evaluate(panel, {ids[s.factor_id]: s.tree for s in specs}, keep, keys), ids, keep, keys)
