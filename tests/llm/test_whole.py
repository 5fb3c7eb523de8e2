"""Odd rows, long texts and clashing names; scores and shards by brute force; hot keys."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosswind.llm import attention as net
from crosswind.llm import linededup, private, scoring, sharding
from crosswind.llm.common import spread_join

BLANK = r"[\x20\x09-\x0D]+"


def plain_score(model, path, text, counts, n):
    """log10 probability of a text, id by id, without batches, masks or windows as arrays."""
    m = {k: v.astype(float) for k, v in model.items()}
    words = [w for w in re.split(BLANK, re.sub("[A-Z]", lambda c: c[0].lower(), text)) if w]
    own = [net.word_ids(path, [w.encode()])[0].tolist() for w in words] + [[net.END]]
    ids = [i for w in own for i in w]
    last = [k == len(w) - 1 for w in own for k in range(len(w))]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    logs = []
    for j, t in enumerate(ids):
        begin = j // net.STRIDE * net.STRIDE
        seen = range(max(0, begin - net.CONTEXT), j + 1)
        x = {i: m["embed"][ids[i - 1] if i else net.BEGIN] + m["place"][i - begin + net.CONTEXT] for i in seen}
        q = x[j] @ m["q"] / math.sqrt(net.WIDTH)
        a = softmax(np.array([q @ (x[i] @ m["k"]) for i in seen]))
        u = x[j] + sum(w * (x[i] @ m["v"]) for w, i in zip(a, seen)) @ m["o"]
        u = u + np.maximum(u @ m["w1"] + m["b1"], 0) @ m["w2"]
        c = t // net.MEMBERS
        p = softmax(m["classes"] @ u + m["class_bias"])[c] * softmax(m["members"][c] @ u + m["member_bias"][c])[t % net.MEMBERS]
        ends = 1 / (1 + math.exp(-(m["last"] @ u + m["last_bias"][t])))
        logs.append(math.log(p) + (0 if t == net.END else math.log(ends if last[j] else 1 - ends)))
    out, at = 0.0, 0
    for word, w in zip([*words, scoring.TEXT_END.decode()], own):
        att = math.exp(sum(logs[at : at + len(w)]))
        out += math.log10((1 - scoring.SHARE) * att + scoring.SHARE * counts[word] / max(1, n))
        at += len(w)
    return out


def test_scores_against_a_plain_forward_pass(spark, monkeypatch):
    path, made = net.vocabulary_path(), {}
    fit = scoring.fitted
    monkeypatch.setattr(scoring, "fitted", lambda docs, p=None: made.setdefault("numbers", fit(docs, p)))
    rng = np.random.default_rng(4)
    texts = {i: " ".join(rng.choice(["the", "cat", "Sat", "überall", "x1", "antidisestablishment", "on"], rng.integers(1, 90))) for i in range(20)} | {50: "", 51: None}
    docs = spark.createDataFrame([(i, x, 1.0) for i, x in texts.items()], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in scoring.scored(docs).collect()}
    counts = Counter()
    for i, x in texts.items():
        if not got[i].held_out:
            counts.update([w for w in re.split(BLANK, (x or "").lower()) if w] + [" "])
    n = sum(counts.values())
    model = net.unflat(made["numbers"])
    for i, x in texts.items():
        assert got[i].train_tokens == n and got[i].score == pytest.approx(plain_score(model, path, x or "", counts, n), rel=1e-4)


def test_shards_and_slots_against_the_walk(spark):
    """Row numbers by hand: buckets in turn, rows of a bucket in order; then the permutation of each number."""
    rows = [(i, f"text {i % 7}") for i in range(50)] + [(3, "text 3"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    facts = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    told = [(r.b, (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32)) for r in facts.withColumn("b", F.pmod(F.xxhash64(*facts.columns), F.lit(sharding.BUCKETS))).collect()]
    want = sorted((k[1] if k[0] else None, *sharding.shard_slot(number, len(rows), 8, 20)) if k[0] else (-1, *sharding.shard_slot(number, len(rows), 8, 20)) for number, (_, k) in enumerate(sorted(told)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.shard, r.slot) for r in sharding.document_shards(docs).collect())
    assert got == want


def plain_lines(docs, run, long_words=None):
    """Texts after line dedup, by every window of every document in order; windows of fewer lines count with long_words words."""
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    seen, out = {}, {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if trim(x)]
        gone, size = set(), min(run, len(full))
        for s in range(max(len(full) - run + 1, 1) if full else 0):
            key = (size, tuple(trim(lines[k]) for k in full[s : s + size]))
            if key in seen:
                gone.update(full[s : s + size])
            seen.setdefault(key, (i, s))
        for short in range(1, run) if long_words else ():
            for s in range(len(full) - short + 1):
                part = [trim(lines[k]) for k in full[s : s + short]]
                if sum(len(x.split()) for x in part) >= long_words:
                    key = ("long", tuple(part))
                    if key in seen:
                        gone.update(full[s : s + short])
                    seen.setdefault(key, (i, s))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_runs_against_every_window(spark, run):
    rng = np.random.default_rng(run)
    docs = {i: "\n".join(rng.choice(["alpha", "beta ", " beta", "gamma", "", "delta", "eps"], rng.integers(0, 30))) for i in range(40)}
    docs[40] = "\n".join(f"line {k % 400}" for k in range(20_000))
    docs[41] = "same\n" * 5000
    names = ["_starts", "_id", "_lines", "full", "gone", "key", "row", "print"]
    frame = spark.createDataFrame([(i, x, *[k] * len(names)) for k, (i, x) in enumerate(docs.items())], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = linededup.deduplicated(frame, run)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == plain_lines(docs, run)
    before = {r.doc_id: tuple(r[n] for n in names) for r in frame.collect()}
    assert all(tuple(r[n] for n in names) == before[r.doc_id] for r in rows)


@pytest.mark.parametrize("run", [1, 2, 3, 4])
def test_long_lines_are_runs_by_themselves(spark, run):
    rng = np.random.default_rng(run)
    every = ["a b c d e f", " b c\td e f g ", "x", "y z", "", "p q r", "s t u v w"]
    docs = {i: "\n".join(rng.choice(every, rng.integers(0, 12))) for i in range(40)}
    docs[50], docs[51], docs[52] = "one two three four five six", "own\none two three four five six\nother", "one two three\nfour five six\n"
    docs[53], docs[54] = "before\none two three\n\nfour five six\nbehind", "word " * 30_000
    frame = spark.createDataFrame([(i, x, 7, 7) for i, x in docs.items()] + [(None, None, 7, 7)], "doc_id long, text string, words int, run int")
    got = linededup.deduplicated(frame, run, long_words=6)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.filter("doc_id IS NOT NULL").collect()} == plain_lines(docs, run, 6)
    assert linededup.deduplicated(frame.filter("false"), run, long_words=6).count() == 0


def test_pipeline_drops_a_repeated_passage_on_one_line(spark):
    passage = " ".join(f"w{k}" for k in range(linededup.LONG_WORDS))
    short = " ".join(f"v{k}" for k in range(linededup.LONG_WORDS - 1))
    docs = spark.createDataFrame([(i, f"head {i}\n{passage}\nmid {i}\n{short}\nend {i}", 0) for i in (1, 2, 3)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in linededup.cleaned(docs).collect()}
    assert got[1].text.count("\n") == 4 and all(got[i].text == f"head {i}\nmid {i}\n{short}\nend {i}" and got[i].n_chars == len(got[i].text) for i in (2, 3))


def test_selected_lines_alone_are_joined(spark):
    """A document's positions are fewer than its lines, and two equal runs of run lines have one at the same place."""
    lines = [f"l{k}" for k in range(300)]
    frame = spark.createDataFrame([("\n".join(lines),), ("\n".join(["x", *lines[100:103], "y"]),)], "text string")
    a, b = (r.p for r in frame.select(linededup.positions(linededup.line_digests(F.col("text")), 3).alias("p")).collect())
    assert 100 < len(a) < 200
    assert {p.print for p in a if 100 <= p.place < 103} & {p.print for p in b if 1 <= p.place < 4}


def test_many_spans_in_one_text(spark):
    text = " ".join(f"10.0.{k // 256}.{k % 256}" if k % 3 else f"u{k}@host{k}.org key=secretvalue{k}aa" for k in range(3000))
    r = private.document_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_ip == 2000 and r.n_email == 1000
    spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in r.spans.split(","))]
    assert all(text[a:b] and " " not in text[a:b].strip() or "key" in text[a:b] for a, b in spans)
    emails = [m.span() for m in re.finditer(r"u\d+@host\d+\.org", text)]
    assert set(emails) <= set(spans)


def test_hot_keys_are_spread(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = spread_join(rows, facts, "k", "n", F.xxhash64("id"))
    assert sorted(got.columns) == ["id", "k", "least", "n"] and got.count() == 20_000
    assert {tuple(r) for r in got.filter("k = 7").select("n", "least").distinct().collect()} == {(10_001, 0)} and got.filter("k <> 7 AND least = id").count() == 9_999


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    said = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n)) + "."
    good = "\n".join(said(12) for _ in range(20))
    rows = [(1, good, "en", "a", 9, "x"), (2, good, "en", "a", 9, "x"), (3, None, None, None, None, None), (4, "", "en", "a", 0, "x"), (None, "\n".join(said(12) for _ in range(20)), "en", "a", 9, "x"), (5, "word " * 30_000, "en", "b", 9, "x"), (6, "\n".join(said(12) for _ in range(3000)), "en", "b", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    for name, found in (("all", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "some benchmark text that no document has, of ten words or more")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        final = corpus_pipeline.run(spark, folder).collect()
        assert len(final) == docs.count() and {r.doc_id for r in final} <= {r[0] for r in found}
        if found:
            # the second copy stays as a document without lines
            assert {r.doc_id: r.n_ids > 0 for r in final} == {1: True, 2: False, 6: True, None: True} and all(r.exact for r in final)
