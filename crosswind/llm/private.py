"""Personal data: spans by formats that always count, and more by boosted trees over high-recall candidates.

In DataFrame functions only. Generators propose overlapping spans of any plausible form: runs of digits, long tokens of mixed
characters, values behind a word such as ``password``, addresses written out. Each has features of its format and of its
surroundings. Trees are fitted on the driver on at most SAMPLE candidates, labelled by strict rules, and applied as an
expression; of overlapping selected spans the first and longest stays, and none overlaps a span of the fixed formats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.llm import boosting
from crosswind.llm.common import checkpointed
from crosswind.llm.quality import let

#: At most so many labelled candidates fit the trees: those with the smallest hashes of their texts.
SAMPLE = 6000
KINDS = ("email", "ip", "card", "phone")
#: A match is leftmost, so it begins where the last one ended or where its first class of characters does: the lookbehinds
#: say so, and keep a long run from being tried from each of its characters. Possessive groups need no stack.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Candidate spans and the kind they become.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
    "keyed": r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|key)\x20?[=:]\x20?[^\x00-\x20]{4,}+",
    "number": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63})++",
}
FEATURES = ["kind", "chars", "digits", "upper", "lower", "other", "hex_only", "switches", "distinct", "cue_before", "quote_before", "equals", "alone"]
CUES = r"(?i)(?:password|passwd|pwd|secret|token|key|bearer|login|phone|tel|fax|call|ssn|mail|contact)[^a-z]{0,4}$"


#: Items that are gathered into one array before it is set beside others like it, and so on LEVELS times: an array that grows
#: by one item is copied each time.
TOGETHER, LEVELS = 32, 2


def scanned(items: Column, start: Column, out: str, step) -> Column:
    """What ``step`` gives out, an array of type ``out`` for each item in turn; step takes the state and an item, and gives the next
    state and that array. Each item is copied some TOGETHER times a level, whatever their number."""

    def one(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def level(k: int, state: Column, xs: Column) -> Column:
        if k == 0:
            return F.aggregate(xs, F.struct(state.alias("state"), F.array().cast(out).alias("out")), one)

        def chunk(acc: Column, part: Column) -> Column:
            return let(level(k - 1, acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        size = TOGETHER**k
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(size)), lambda at: F.slice(xs, at + 1, F.lit(size)))
        return F.aggregate(parts, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), chunk, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return level(LEVELS, start, items)["out"]


SPANS = "array<struct<from:int,to:int,match:string,before:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Places of a pattern's leftmost matches, one after the other: structs of from, to (code points, end exclusive), match, and
    before, up to 16 code points that stand in front of it."""

    def placed(parts: Column, found: Column) -> Column:
        items = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("gap"), m.alias("match")))

        def step(state: Column, x: Column):
            front = F.substring(F.concat(state["tail"], F.substring(x["gap"], -16, 16)), -16, 16)
            begin = state["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            new = F.struct(end.alias("at"), F.substring(F.concat(front, F.substring(x["match"], -16, 16)), -16, 16).alias("tail"))
            return new, F.array(F.struct(begin.alias("from"), end.alias("to"), x["match"].alias("match"), front.alias("before")))

        return scanned(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), SPANS, step)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPANS)
    return let(found, lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda parts: placed(parts, found))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3), "^$", "0").cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n < 13) | (n > 19), False).otherwise(_luhn(_digits(match)))
    return (n >= 9) & (n <= 15)


def _good(kind: str):
    """Of spans, those that pass the kind's check, named so."""
    return lambda spans: F.transform(F.filter(spans, lambda x: _valid(kind, x["match"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["from"].alias("from"), x["to"].alias("to")))


def base_spans(text: Column) -> Column:
    """The spans of the fixed formats, by kind as listed and then by place; ``kind`` and the places only."""
    parts = []
    for kind in KINDS:
        gate = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        parts.append(F.when(gate, let(_spans(text, FORMATS[kind]), _good(kind))).otherwise(F.array().cast("array<struct<kind:string,from:int,to:int>>")))
    return F.concat(*parts)


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("double")


def _featured(kind: str, number: int):
    """What makes a candidate of a generator's match."""

    def candidate(x: Column) -> Column:
        m, before = x["match"], x["before"]
        return F.struct(
            F.lit("secret" if kind in ("secret", "keyed") else "phone" if kind == "number" else "email").alias("as"),
            x["from"].alias("from"),
            x["to"].alias("to"),
            F.xxhash64(m).alias("hash"),
            F.lit(float(number)).alias("kind"),
            F.length(m).cast("double").alias("chars"),
            _count(m, "[0-9]").alias("digits"),
            _count(m, "[A-Z]").alias("upper"),
            _count(m, "[a-z]").alias("lower"),
            _count(m, "[^0-9A-Za-z]").alias("other"),
            m.rlike(r"(?:^|[=:\x20])[0-9a-f]+$").cast("double").alias("hex_only"),
            (_count(m, "[0-9][A-Za-z]") + _count(m, "[A-Za-z][0-9]")).alias("switches"),
            F.size(F.array_distinct(F.split(m, ""))).cast("double").alias("distinct"),
            F.when(x["from"] == 0, 0.0).otherwise(before.rlike(CUES).cast("double")).alias("cue_before"),
            F.when(x["from"] == 0, 0.0).otherwise(before.rlike("[\"'=:]$").cast("double")).alias("quote_before"),
            m.rlike("[=:]").cast("double").alias("equals"),
            F.when(x["from"] == 0, 1.0).otherwise(before.rlike(r"[\x20\x09-\x0D]$").cast("double")).alias("alone"),
            _label(kind, m, x, before).alias("label"),
        )

    return candidate


def _candidates(text: Column) -> Column:
    """Proposed spans with their features."""
    return F.concat(*(let(_spans(text, pattern), lambda spans: F.transform(spans, _featured(kind, k))) for k, (kind, pattern) in enumerate(GENERATORS.items())))


def _label(kind: str, m: Column, x: Column, before: Column) -> Column:
    """The strict rules that label candidates: known key formats, values behind a cue, numbers and addresses in full form."""
    if kind == "secret":
        known = m.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$") | m.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | m.rlike(r"^(?:gh[pousr]_|sk-|xox[bap]-)[A-Za-z0-9_-]{16,}$") | m.rlike(r"^eyJ[A-Za-z0-9_=-]+$") | m.rlike(r"^(?:password|passwd|pwd|secret|token|api[_-]?key)=\S+$")
        return known | F.when(x["from"] == 0, False).otherwise(before.rlike(CUES) & m.rlike("[0-9]"))
    if kind == "keyed":
        return m.rlike(r"[=:]\x20?\S*[0-9]") & ~m.rlike(r"[=:]\x20?[0-9]{1,5}$")
    if kind == "number":
        return m.rlike(r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return m.rlike(r"(?i)(?:\(at\)|\[at\]|\{at\}).*(?:\.|\(dot\)|\[dot\])[\x20]?[a-z]{2,}$")


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, base (spans of fixed formats) and candidates (with features) of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digits = F.col("text").rlike("[0-9]")
    any_base = digits | F.contains("text", F.lit("@"))
    long_token = F.col("text").rlike(r"[0-9A-Za-z+/_=-]{16}|[=:]|(?i)\(at\)|\[at\]|\{at\}") | digits
    none = base_spans(F.lit(""))
    return rows.select(id_col, F.when(any_base, base_spans(F.col("text"))).otherwise(none).alias("base"), F.when(long_token, _candidates(F.col("text"))).otherwise(_candidates(F.lit(""))).alias("candidates"))


def learnt(found: DataFrame, sample: int = SAMPLE) -> boosting.Boosted:
    """Trees fitted on at most ``sample`` different candidates: the smallest hashes of each label."""
    rows = found.select(F.explode("candidates").alias("c")).select("c.*")
    rows = rows.groupBy("hash", "label").agg(*(F.min(c).alias(c) for c in FEATURES))
    got = rows.filter("label").orderBy("hash").limit(sample // 2).union(rows.filter("not label").orderBy("hash").limit(sample - sample // 2)).orderBy("hash", "label").collect()
    x = np.array([[r[c] for c in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    return boosting.fit(x, np.array([r["label"] for r in got], bool), FEATURES)


def _chosen(base: Column, candidates: Column) -> Column:
    """Selected candidates by place, longest first; one that overlaps a base span or one chosen before is left out.

    Base spans and candidates are gone through together, first from the end, where the next base span is known, then from the
    begin, where the end of the last one is."""
    kind = "struct<from:int,fixed:boolean,back:int,kind:string,to:int>"
    item = lambda c, name, fixed: F.struct(c["from"].alias("from"), F.lit(fixed).alias("fixed"), (-c["to"]).alias("back"), c[name].alias("kind"), c["to"].alias("to"))
    every = F.sort_array(F.concat(F.transform(base, lambda b: item(b, "kind", True)), F.transform(candidates, lambda c: item(c, "as", False))), asc=False)
    none = F.array().cast(f"array<{kind}>")

    def behind(state: Column, x: Column):
        return F.when(x["fixed"], x["from"]).otherwise(state), F.when(x["fixed"] | (x["to"] <= state), F.array(x)).otherwise(none)

    def ahead(state: Column, x: Column):
        new = ~x["fixed"] & (x["from"] >= state)
        taken = F.array(F.struct(x["kind"].alias("kind"), x["from"].alias("from"), x["to"].alias("to")))
        return F.when(x["fixed"] | new, F.greatest(state, x["to"])).otherwise(state), F.when(new, taken).otherwise(F.array().cast("array<struct<kind:string,from:int,to:int>>"))

    kept = scanned(every, F.lit(2**31 - 1), f"array<{kind}>", behind)
    return let(kept, lambda kept: scanned(F.reverse(kept), F.lit(0), "array<struct<kind:string,from:int,to:int>>", ahead))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id_col, base and more (arrays of kind, from, to) of every row. A null text is empty; an empty table gives no rows."""
    found = checkpointed(proposals(docs, id_col, text_col))
    model = learnt(found, sample)
    return found.select(id_col, "base", F.when(F.size("candidates") == 0, F.array().cast("array<struct<kind:string,from:int,to:int>>")).otherwise(_chosen(F.col("base"), F.filter("candidates", lambda c: model.says(c)))).alias("more"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")


def document_spans(docs: DataFrame) -> DataFrame:
    rows = detected(docs)
    of = lambda kind, spans: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind, F.col("base"))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.concat(*(F.sort_array(F.concat(of(kind, F.col("base")), of(kind, F.col("more")))) for kind in (*KINDS, "secret")))
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the text with every span replaced by its kind in angle brackets."""
    found = detected(docs.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text")
    every = F.sort_array(F.transform(F.concat("base", "more"), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("_row")[text_col]

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["from"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["from"] >= acc["at"], F.struct(s["to"].alias("at"), put.alias("out"))).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return found.select(F.col("_row")[id_col].alias(id_col), F.aggregate(every, start, step, finish).alias(text_col))
