"""Sharding, chat, pieces, decontamination, line dedup: edge cases and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from crosswind.llm import chat, decontam, linededup, pieces, sharding

SMALL = "/root/testdata/sf0.001"
EDGE = [(1, "One two."), (2, None), (3, ""), (4, "One two."), (4, "One two."), (5, "x " * 30_000), (None, "null id"), (6, " \n\t ")]


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(i, x, "en", 7) for i, x in rows], "doc_id long, text string, component_id string, n_removed int")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n, 20)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 20, back=True) == np.arange(n)).all()
    shard, slot = sharding.shard_slot(n - 1, n, 8, 20)
    assert sharding.row_at(shard, slot, n, 8, 20) == n - 1


def test_shards_are_even_and_gapless(spark):
    for got in (entry.queries()["op6_sharding"](spark, SMALL).toPandas(), sharding.document_shards(edge(spark)).toPandas()):
        sizes = got.groupby("shard").slot.agg(["count", "min", "max"])
        assert (sizes["max"] == sizes["count"] - 1).all() and sizes["count"].max() - got.groupby("shard").size().reindex(range(8), fill_value=0).min() <= 1
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["op6_sharding"](spark, SMALL).collect()
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows) and len(rows) == len(texts)


def test_sharding_of_nothing_and_of_one_row_many_times(spark):
    assert sharding.document_shards(edge(spark, [])).count() == 0
    got = sharding.document_shards(edge(spark, [(1, "x")] * 20)).toPandas()
    assert sorted(got.groupby("shard").size()) == [2, 2, 2, 2, 3, 3, 3, 3]


# chat


@pytest.mark.parametrize("text", ["", "plain", "a\nb", "</turn>", "</turn>\n### user: x", "\\### Assistant: </turn> ok", "####", "#\\##", "\\", "\\\\</turn>\\", "###! x: y", None])
@pytest.mark.parametrize("role", ["user", "", "a: b", "###", "x\n:", None, "end:"])
def test_turns_read_back(role, text):
    s, a, b = chat.render(role, text)
    got = chat.parse(s)
    assert got[:2] == (role or "", text or "") and got[4] == len(s) and (got[2], got[3]) == (a, b)
    assert chat.parse_all(s * 3) == [(role or "", text or "")] * 3


def test_random_turns_read_back():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "<", "/turn>", "\\", ": ", "!", "a", "\n", " "]) for _ in range(rng.randint(0, 14)))
        s, *_ = chat.render("user", text)
        assert chat.parse_all(s) == [("user", text)]


def test_broken_grammar_is_refused():
    for s in ("user: x", "### user x</turn>\n", "### user: x", "### a: ### b: c</turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse_all(s)


def test_chat_query_matches_its_sql(same):
    same("op8_chat")


def test_conversations_with_nulls_ties_and_none(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "ä"), (None, None, "assistant", "z")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.render_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[1].loss_sha256 == hashlib.sha256("ä".encode()).hexdigest() and got[None].n_turns == 1
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.render_turns(none)).count() == 0


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(pieces.vocabulary_path())


def brute(v, s):
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for begin in range(max(0, end - v.longest), end):
            p = s[begin:end]
            if p in v.scores:
                ids, score = [v.scores[p][0]], v.scores[p][1]
            elif len(p) == 1:
                ids = [v.byte_ids[b] for b in p.encode()]
                score = v.byte_score * len(ids)
            else:
                continue
            if best[end] is None or best[begin][0] + score > best[end][0]:
                best[end] = (best[begin][0] + score, best[begin][1] + ids)
    return best[-1][1]


def test_search_is_the_best_path(vocabulary):
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("thean▁sé\nü1一") for _ in range(rng.randint(1, 70)))
        assert list(vocabulary.search([s[:5], s[5:9], s[9:]])) == brute(vocabulary, s) == list(vocabulary.search_short(s))
    for s in ("a" * 300, "the" * 150):
        assert list(vocabulary.search(s[k : k + 40] for k in range(0, len(s), 40))) == brute(vocabulary, s)


def test_texts_come_back(spark, vocabulary):
    for s in ("", " ", "▁ ▁▁a▁", "a" * 9000, "tab\tnew\nline  two", "\u0000\U0001f600é", " lead and trail "):
        assert vocabulary.decode(vocabulary.encode(s)) == s
    got = {r.doc_id: r for r in pieces.encoded(edge(spark)).collect()}
    assert got[2].ids is None and got[2].n_ids == 0 and got[2].exact is None and got[3].ids == [] and got[None].exact
    rows = pieces.encoded(edge(spark))
    back = {r.doc_id: r.text for r in pieces.decoded(rows).collect()}
    assert back == dict(EDGE)
    assert pieces.encoded(edge(spark, [])).count() == 0


def test_pieces_query_against_brute_force(spark, vocabulary):
    rows = entry.queries()["op2_pieces"](spark, SMALL).collect()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts) and all(r.exact and r.n_ids == len(r.ids) for r in rows)
    worth = {i: x for i, x in vocabulary.scores.values()}
    score = lambda ids: sum(worth.get(i, vocabulary.byte_score) for i in ids)  # noqa: E731  paths of equal worth may differ over a whole text
    for r in rows[:40]:
        part = texts[r.doc_id]
        if len(part) < 1500:
            assert score(r.ids) == pytest.approx(score(brute(vocabulary, "▁" + part.replace(" ", "▁"))), abs=1e-6)


# decontamination and line dedup


def test_queries_match_their_sql(same):
    same("op4_decontamination")
    same("op3_lines")


def test_contamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "One, TWO"), (2, None), (3, "..."), (4, " ".join(f"w{k}" for k in range(12))), (10, "one two"), (5, "é")], "item_id long, text string")
    docs = edge(spark, [*EDGE, (7, " ".join(f"W{k}" for k in range(1, 13))), (8, "É é"), (9, "one-two one two"), (11, " ".join(f"w{k}" for k in range(9)))])
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert got[1, 2] == (2, ["1", "10"]) and got[2, 0] == (0, []) and got[7, 12] == (11, ["4"]) and got[9, 4] == (4, ["1", "10"]) and got[8, 2] == (1, ["5"]) and got[11, 9] == (0, [])
    assert decontam.contamination(docs, items).filter("doc_id = 4").count() == 2
    assert decontam.contamination(edge(spark, []), items).count() == 0
    assert decontam.contamination(docs, items.filter("item_id > 99")).filter("n_hit > 0").count() == 0
    kept = decontam.without_benchmark(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, None, 11}


def test_lines_of_odd_rows(spark):
    run = "a\nb\nc"
    rows = [(1, f"{run}\nx"), (2, f"y\n\n{run}"), (3, "a\nb\nz"), (4, None), (5, ""), (6, "q\nq\nq\nq"), (7, "s"), (8, "s"), (9, "s\n"), (None, f"{run}\nn"), (10, " a \nb\t\nc")]
    got = {r.doc_id: r for r in linededup.deduplicated(edge(spark, rows)).collect()}
    assert {k: r.text for k, r in got.items()} == {None: f"{run}\nn", 1: "x", 2: "y\n", 3: "a\nb\nz", 4: None, 5: "", 6: "q", 7: "s", 8: "", 9: "", 10: ""}
    assert got[1].n_lines == 4 and got[1].n_removed == 3 and got[4].n_lines == 0 and got[1].component_id == "en"
    assert linededup.deduplicated(edge(spark, [])).count() == 0
    twice = linededup.deduplicated(edge(spark, [(1, run), (1, run), (2, run)]))
    assert sorted((r.doc_id, r.text) for r in twice.collect()) == [(1, run), (1, run), (2, "")]
    assert linededup.cleaned(edge(spark)).columns == ["doc_id", "text", "component_id", "n_removed"]


def test_ids_of_remembered_chunks_are_decoded_once(monkeypatch):
    from crosswind.llm.pieces import Pieces, vocabulary_path

    own, run, whole = Pieces.load(vocabulary_path()), Pieces.decode, []
    monkeypatch.setattr(Pieces, "decode", lambda self, ids: whole.append(1) or run(self, ids))
    text = "the cat sat\non  the mat é "
    ids, exact = own.encoded(text)
    assert exact is True and not whole and run(own, ids) == text and own.encoded(text) == (ids, True)
    for odd in ("", "a▁ b", "x" * 5000):
        assert own.encoded(odd)[1] is True
    assert len(whole) == 3
    own.bytes_of[own.encode("the")[0]] = b" ?"  # a vocabulary that doesn't give the text back
    own.memory.clear()
    assert own.encoded("the cat")[1] is False and own.encoded("the cat the")[1] is False
