"""Chat formatting with a grammar that is read back.

    turn := "###" ["!"] " " role ": " text "</turn>\\n"

A turn is first rendered as it is, and the rendered string parsed again; where the parser does not give back the same role
and text (or meets a control string inside them), it is rendered with ``!`` and a backslash inside every control string, and
before every backslash. ``parse`` reads either form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def _escape(s: str) -> str:
    return re.sub(r":(?= )", r":\\", re.sub(r"#(?=##)", r"#\\", s.replace("\\", "\\\\").replace(END, "<\\/turn>")))


def parse(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at s[at:]: role and text (unescaped), where its text starts and ends, and where the turn ends."""
    if s.startswith("### ", at):
        escaped, begin = False, at + 4
    elif s.startswith("###! ", at):
        escaped, begin = True, at + 5
    else:
        raise GrammarError(f"no turn at {at}")
    colon = s.find(": ", begin)
    end = s.find(END + "\n", colon + 2) if colon >= 0 else -1
    if end < 0:
        raise GrammarError(f"no end of the turn at {at}")
    role, text = s[begin:colon], s[colon + 2 : end]
    if "###" in role or "###" in text or END in role or END in text:
        raise GrammarError(f"control string inside the turn at {at}")
    if escaped:
        role, text = _ESCAPED.sub(r"\1", role), _ESCAPED.sub(r"\1", text)
    return role, text, colon + 2, end, end + len(END) + 1


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn and the place of its text in it; null role or text: empty."""
    role, text = role or "", text or ""
    s = f"### {role}: {text}{END}\n"
    try:
        again = parse(s)
        if again[:2] == (role, text) and again[4] == len(s):
            return s, again[2], again[3]
    except GrammarError:
        pass
    s = f"###! {_escape(role)}: {_escape(text)}{END}\n"
    again = parse(s)
    if again[:2] != (role, text) or again[4] != len(s):
        raise AssertionError("escaped turns read back as they were")
    return s, again[2], again[3]


def parse_all(s: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(s):
        role, text, _, _, at = parse(s, at)
        turns.append((role, text))
    return turns


def render_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, turn, rendered, loss_from and loss_to of every row: the loss mask, code points in rendered, spans the text of
    rows whose role is ``learn`` and is empty elsewhere. Other columns are dropped. No shuffle."""

    @F.pandas_udf("rendered string, loss_from long, loss_to long")
    def rendered(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [render(r, x) for r, x in zip(roles, texts)]
        return pd.DataFrame([(s, b, e if r == learn else b) for (s, b, e), r in zip(rows, roles)], columns=["rendered", "loss_from", "loss_to"])

    return turns.select("conv_id", "turn", rendered("role", "text").alias("_r")).select("conv_id", "turn", "_r.*")


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """What parsing the rendered turns gives back, a row for each conversation.

    Turns of a conversation stand in the order of (turn, rendered), null turns first. Each task reads its sorted turns as a
    stream and holds one turn and two running hashes, however long a conversation is.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, rows = None, False, []

        def close():
            nonlocal begun
            if begun:
                rows.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
            begun = False

        for b in batches:
            for conv, s, lo, hi in zip(b["conv_id"], b["rendered"], b["loss_from"], b["loss_to"]):
                conv = None if pd.isna(conv) else int(conv)
                if not begun or conv != now:
                    close()
                    now, begun, n, loss_n, chars, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text, start, end, stop = parse(s)
                if stop != len(s):
                    raise GrammarError("more than one turn in a row")
                turns.update(f"{role}\n{text}\n".encode())
                n, chars = n + 1, chars + len(s)
                if hi > lo:
                    if (lo, hi) != (start, end):
                        raise GrammarError("the loss mask isn't the text of its turn")
                    loss.update(text.encode())
                    loss_n += len(text)
            out = pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
            rows.clear()
            yield out
        close()
        yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return dealt.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_texts(rendered: DataFrame, out: str) -> None:
    """Writes the rendered turns, sorted, as text: each conversation's turns follow each other in one part file."""
    rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered").select(F.expr("substring(rendered, 1, length(rendered) - 1)").alias("value")).write.mode("overwrite").text(out)
