"""Reports on candidates and families: JSON, Markdown, and a page without anything from outside."""

from __future__ import annotations

from html import escape

from crosswind.operators.study import Result, Study

COLUMNS = ("factor_id", "state", "mean_ic", "ic_t_stat", "sharpe", "sharpe_after_cost", "turnover", "p_fdr", "fdr_reject", "dsr", "nearest_corr")


def shown(x) -> str:
    if x is None or x != x:
        return "n/a"
    if isinstance(x, float):
        return f"{x:,.0f}" if abs(x) >= 1e5 else f"{x:.4g}"
    return str(x)


def candidate_report(result: Result) -> dict:
    s = result.spec
    return {"factor_id": s.factor_id, "expression": s.expression, "canonical_expression": s.canonical_expression, "expression_hash": s.expression_hash, "hypothesis": s.economic_hypothesis, "complexity": s.complexity_score, "max_lookback": s.max_lookback, "decision": {"state": result.state.value, "reasons": result.reasons}, "metrics": result.metrics, "statistics": result.statistics}


def candidate_markdown(result: Result) -> str:
    r = candidate_report(result)
    lines = [f"# {r['factor_id']}", "", f"`{r['expression']}`", "", r["hypothesis"] or "No hypothesis.", "", f"**Decision:** {r['decision']['state']}", *(f"- {x}" for x in r["decision"]["reasons"])]
    for part in ("metrics", "statistics"):
        lines += ["", f"## {part.capitalize()}", "", "| name | value |", "|---|---|"]
        for k, v in r[part].items():
            for name, value in v.items() if isinstance(v, dict) else (("", v),):
                lines.append(f"| {k}{f'.{name}' if name != '' else ''} | {shown(value)} |")
    return "\n".join(lines) + "\n"


def ordered(study: Study) -> list[dict]:
    """Significant first, then by adjusted p."""
    far = lambda x: 2.0 if x is None or x != x else x
    return sorted(study.rows(), key=lambda r: (not r.get("fdr_reject"), far(r.get("p_fdr")), r["factor_id"]))


def family_markdown(study: Study) -> str:
    lines = [f"# Family {study.family}", "", *(f"- {k}: {shown(v)}" for k, v in study.statistics.items()), "", "| " + " | ".join(COLUMNS) + " |", "|" + "---|" * len(COLUMNS)]
    return "\n".join(lines + ["| " + " | ".join(shown(r.get(c)) for c in COLUMNS) + " |" for r in ordered(study)]) + "\n"


def family_html(study: Study) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in COLUMNS)
    body = "".join("<tr>" + "".join(f"<td>{escape(shown(r.get(c)))}</td>" for c in COLUMNS) + "</tr>" for r in ordered(study))
    facts = "".join(f"<li>{escape(k)}: {escape(shown(v))}</li>" for k, v in study.statistics.items())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(study.family)}</title><style>body{{font-family:sans-serif}}td,th{{border:1px solid #ccc;padding:4px}}table{{border-collapse:collapse}}</style></head><body><h1>{escape(study.family)}</h1><ul>{facts}</ul><table><tr>{head}</tr>{body}</table></body></html>'
