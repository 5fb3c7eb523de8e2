"""SimHash groups, passages and connected components, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as entry
from crosswind.llm import passages, simhash
from crosswind.llm.components import components

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_print(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in (None, "", "a", "A b", "a b c d", "a b c d e", "É\x0bß x\ty z \x1c q", "w " * 20_000):
        assert simhash.fingerprint(text) == brute_print(text)


def test_golay_keys_are_shared_within_two_bits():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 4000)
    flips = np.zeros_like(w)
    for _ in range(2):
        flips ^= np.where(rng.random(len(w)) < 0.8, 1 << rng.integers(0, 23, len(w)), 0)
    a, b = simhash.golay_keys(w), simhash.golay_keys(w ^ flips)
    assert all(set(x) & set(y) - {-1} for x, y in zip(a, b))
    assert set((a >= 0).sum(1)) == {1, 6}


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    keys = [defaultdict(set), defaultdict(set)]
    for k, v in enumerate((x, y)):
        for row, key in zip(*simhash.join_keys(v)):
            keys[k][row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


def test_groups_of_odd_rows(spark):
    rows = [(5, "A b c d e"), (3, "a B c d e"), (9, None), (8, ""), (7, " \n"), (1, "other words stand here now"), (3, "a B c d e"), (None, "alone in the world today"), (2, "x " * 20_000)]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, bits string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.document_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 7), (8, 7), (7, 7), (1, 1), (None, None), (2, 2)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 3, 7, 1, 2, None], key=str)
    assert simhash.document_groups(docs.filter("false")).count() == 0


def test_simhash_query_against_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    prints = {i: brute_print(x) for i, x in texts.items()}
    want = brute_groups(prints)
    got = entry.queries()["op10_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_dense_sets_and_split_keys(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    found = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2))) for b in base for _ in range(120)})
    want = brute_groups({i: f for i, f in enumerate(found)})
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    frame = spark.createDataFrame([(signed(f),) for f in found], "bits long")
    for block in (1 << 16, 40):
        monkeypatch.setattr(simhash, "BLOCK", block)
        parts = dict(components(simhash.links(frame)).collect())
        groups, brute = defaultdict(set), defaultdict(set)
        for i, f in enumerate(found):
            groups[parts.get(signed(f), signed(f))].add(i)
            brute[want[i]].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_keys_are_counted_only_where_both_segments_are_hot(spark, monkeypatch):
    rng = random.Random(18)
    base = rng.getrandbits(64)
    found = sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)})
    bits = np.array(found, np.uint64)
    frame = spark.createDataFrame([(x,) for x in bits.view(np.int64).tolist()], "bits long").repartition(3)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    hot = simhash.hot_segments(frame)
    _, keys = simhash.join_keys(bits)
    values, n = np.unique(keys, return_counts=True)
    counted = simhash.both_hot(values, hot)
    assert (n > 40).any() and counted[n > 40].all() and counted.sum() < 0.1 * len(values)
    monkeypatch.setattr(simhash, "BLOCK", 550)
    assert not simhash.hot_segments(frame).any()


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 101), (102, 100), (100, 102), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def made(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_passages_planted(spark):
    rng = random.Random(5)
    p = made(rng, 60)
    other, more, short, line = p[:20] + ["zzz"] + p[21:], p[:30] + ["new"] + p[30:], made(rng, 45), made(rng, 20)
    rows = [(1, made(rng, 30) + p + made(rng, 100)), (2, made(rng, 5) + other + made(rng, 30)), (3, made(rng, 50) + more), (4, made(rng, 200)), (5, short + made(rng, 100)), (6, made(rng, 100) + short), (7, line + made(rng, 100)), (8, line + made(rng, 120)), (9, p), (12, p)]
    docs = spark.createDataFrame([(i, " ".join(x), 1) for i, x in rows] + [(10, None, 1), (11, "", 1), (4, " ".join(rows[3][1]), 1)], "doc_id long, text string, rep int")
    got = {r.doc_id: r for r in passages.document_passages(docs).collect()}
    assert {i for i, r in got.items() if r.class_id == 1} == {1, 2, 3, 9, 12} and len(got) == 12
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in (4, 5, 6, 7, 8, 10, 11))
    at = got[9].passages[0]
    assert got[12].copy_of == 9 and got[9].n_links >= 1 and (at["from"], at["to"], at["of"], at["of_from"], at["of_to"]) == (0, 60, 1, 30, 90)
    assert passages.document_passages(docs.filter("false")).count() == 0


def test_windows_hold_every_stretch():
    h = np.random.default_rng(3).integers(0, 50, 80).astype(np.uint64)
    found = passages.compact_windows(h, 10)
    for a in range(80):
        for b in range(a + 10, 81):
            c = a + int(h[a:b].argmin())
            assert any(lo <= a and b - 1 <= hi and at == c for lo, at, hi in found)


def test_passage_query_joins_all_that_share_fifty_words(spark):
    got = {r.doc_id: r.class_id for r in entry.queries()["op5_passages"](spark, SMALL).collect()}
    shared = defaultdict(set)
    for i, x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        w = words(x)
        for k in range(len(w) - 49):
            shared[tuple(w[k : k + 50])].add(got[i])
    assert shared and all(len(c) == 1 for c in shared.values())


def test_passage_of_two_lines_that_stand_alone_in_earlier_texts(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(25):
        one, two = made(rng, 30), made(rng, 30)
        alone = [made(rng, 60) + x + made(rng, 60) for _ in range(20) for x in (one, two)]
        pair = [made(rng, 60) + one + two + made(rng, 60) for _ in range(2)]
        at = 100 * k
        rows += [(at + j, " ".join(x)) for j, x in enumerate(alone + pair)]
        want.append((at + len(alone), at + len(alone) + 1))
    found, *_ = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.a, r.b) for r in found.collect()} == set(want)


def test_change_near_an_edge_of_a_passage():
    rng = random.Random(12)
    shingles = passages.Shingles()
    for n, at in ((52, 7), (54, 9), (56, 11), (52, 44), (54, 44)):
        p = made(rng, n)
        x, y = (shingles(" ".join(made(rng, 60) + w + made(rng, 60)).encode()) for w in (p, [*p[:at], "changed", *p[at + 1 :]]))
        common = [k for k in range(60, 60 + n - 4) if x[k] == y[k]]
        assert all(passages.common_passages(x, y, [(k, k)], 46) == [(60, 56 + n, 60, 56 + n)] for k in common)
    few = made(rng, 44)
    x, y = (shingles(" ".join(made(rng, 60) + few + made(rng, 60)).encode()) for _ in range(2))
    assert passages.common_passages(x, y, [(70, 70)], 46) == []


def test_every_partner_counts(spark):
    rng = random.Random(13)
    p, q = made(rng, 60), made(rng, 70)
    rows = {i: made(rng, 40) + (p if i <= 40 else []) + made(rng, 30) + (q if i % 4 == 0 else []) + made(rng, 20) for i in range(1, 61)}
    rows[61] = made(rng, 30) + p[:20] + made(rng, 1) + p[21:]
    got = {r.doc_id: r.n_links for r in passages.document_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in rows.items()], "doc_id long, text string")).collect()}
    with_p, with_q = set(range(1, 41)), set(range(4, 61, 4))
    for i in with_p | with_q:
        want = len(((with_p if i in with_p else set()) | (with_q if i in with_q else set())) - {i})
        assert got[i] in ((want, want + 1) if i in with_p else (want,))
    assert got[61] >= 1 and all(got[i] == 0 for i in range(41, 61) if i % 4)


def test_every_near_copy_counts(spark):
    """A form with one word of its own in each of 40 texts, which so share no 50 words; and one of them with a word more."""
    rng = random.Random(16)
    p, line = made(rng, 60), made(rng, 30)
    rows = [made(rng, 30) + p[:30] + made(rng, 1) + p[31:] + made(rng, 30) for _ in range(40)]
    rows.append(made(rng, 30) + p[:30] + made(rng, 2) + p[31:] + made(rng, 30))
    rows += [made(rng, 40) + line + made(rng, 40) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    for block in (1 << 14, 16):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(passages, "NEAR_BLOCK", block)
            got = {r.doc_id: (r.class_id, r.n_links) for r in passages.document_passages(docs).collect()}
        assert got == {i: (0, 40) if i <= 40 else (i, 0) for i in range(81)}


def test_near_copies_around_a_place_against_all_pairs():
    rng, shingles = random.Random(17), passages.Shingles()
    base = made(rng, 130)
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(130), rng.randint(0, 8)):
            w[at : at + rng.randint(0, 2)] = made(rng, rng.randint(0, 2))
        texts.append(shingles(" ".join(w if rng.random() < 0.7 else w[:75] + made(rng, 60)).encode()))
    spot = shingles(" ".join(base).encode())[60]
    texts = [h for h in texts if spot in h]
    at = [int(np.flatnonzero(h == spot)[0]) for h in texts]
    n = passages.AROUND
    around = np.zeros((len(texts), 2 * n + 1), np.uint32)
    for row, h, c in zip(around, texts, at):
        for k in range(max(0, c - n), min(len(h), c + n + 1)):
            row[k - c + n] = (h[k] >> np.uint64(32)) | np.uint64(1)
    got = set(passages.near_only(np.arange(len(texts)), around, [[] for _ in texts], 46))
    cut = [(h[max(0, c - n) : c + n + 1], min(c, n)) for h, c in zip(texts, at)]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if passages.common_passages(cut[i][0], cut[j][0], [(cut[i][1], cut[j][1])], 46)}
    assert len(texts) > 40 and 100 < len(want) < len(texts) * (len(texts) - 1) / 2 and want <= got and len(got - want) <= 0.02 * len(want)


def test_only_what_can_hold_a_passage_is_aligned(monkeypatch):
    """Forms with 3 words of their own in each 46 shingles, and a word more behind the middle; and two with one such word."""
    rng, shingles, tried = random.Random(18), passages.Shingles(), []
    base = made(rng, 119)
    texts = [list(base) for _ in range(40)]
    for k, w in enumerate(texts):
        for at in range(2, 119, 14) if k > 1 else ():
            w[at] = made(rng, 1)[0]
        w[70:70] = made(rng, k % 3)
    middle = base[57:62]
    n, rows, whole = passages.AROUND, [], []
    for w in texts:
        w[57:62] = middle
        h = shingles(" ".join(w).encode())
        whole.append(h)
        rows.append(np.r_[(h[:115] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(2 * n + 1, np.uint32)][: 2 * n + 1])
    run = passages._passages
    monkeypatch.setattr(passages, "_passages", lambda *x: tried.append(1) or run(*x))
    got = passages.near_only(np.arange(40), np.stack(rows), [[]] * 40, 46)
    assert got == [(0, 1)] and len(tried) < 40
    tried.clear()
    assert all(not passages.common_passages(whole[2], whole[k], [(57, 57)], 46) for k in range(3, 40)) and not tried


def test_words_of_shingles_are_told_apart():
    rng, shingles = random.Random(14), passages.Shingles()
    texts = [b"", b" \x0b\t", b"a", b"A b\x0bc\x0cd\re\nF", "É é ß\x1cx".encode(), b"x" * 5000 + b" " + b"x" * 5001, " ".join(made(rng, 3000)).encode(), bytes(range(1, 256))]
    seen = {}
    for t in texts:
        own = t.lower().split()
        h = shingles.words(t).tolist()
        assert len(h) == len(own)
        for w, x in zip(own, h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_recall_of_near_copies_and_one_row_an_id(spark):
    """Passages of 60 words with one to three changed, at 0.8 or more, against the pairs that there are."""
    rng = random.Random(15)
    rows, want = [], set()
    for k in range(120):
        p = made(rng, 80)
        q = list(p)
        for at in rng.sample(range(80), rng.randint(1, 2)):
            q[at] = "changed"
        grams = [{tuple(x[i : i + 5]) for i in range(76)} for x in (p, q)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            want.add((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(made(rng, 50) + p + made(rng, 40))), (2 * k + 1, " ".join(made(rng, 30) + q + made(rng, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, *_ = passages.near_passages(docs)
    got = {(r.a, r.b) for r in found.collect()}
    assert len(want) > 60 and len(got & want) >= 0.9 * len(want) and all(b == a + 1 and a % 2 == 0 for a, b in got)
    p = " ".join(made(rng, 60))
    twice = [(1, p), (1, p), (1, p), (2, p + " more"), (2, "something else"), (3, "x " * 30_000), (3, "x " * 30_000), (4, "x " * 29_000 + "y"), (5, None), (None, p)]
    out = passages.document_passages(spark.createDataFrame([(i, x, 7, "r") for i, x in twice], "doc_id long, text string, rep int, body string")).collect()
    assert sorted((r.doc_id for r in out), key=str) == [1, 2, 3, 4, 5, None]
    classes = {r.doc_id: r.class_id for r in out}
    assert classes[1] == classes[2] == 1 and classes[3] == classes[4] == 3 and classes[5] == 5 and classes[None] is None


def test_files_of_earlier_steps_are_gone_when_texts_are_compared(spark, monkeypatch):
    import time

    rng = random.Random(21)
    part = [f"p{rng.randrange(9**9)}" for _ in range(80)]
    docs = spark.createDataFrame([(i, " ".join([f"w{rng.randrange(9**9)}" for _ in range(60)] + part * (i % 2))) for i in range(40)], "doc_id long, text string")
    save, left = passages.checkpointed, []

    def counted(df):
        if "from_a" in df.columns:
            until = time.time() + 10
            while (n := spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()) and time.time() < until:
                time.sleep(0.1)
            left.append(n)
        return save(df)

    monkeypatch.setattr(passages, "checkpointed", counted)
    found, *_ = passages.near_passages(docs)
    assert found.count() and left[0] <= 3  # dozens otherwise


def test_packed_texts(spark):
    texts = ["", "größe " * 100, "the cat"]
    got = {r.id: bytes(r.text) for r in passages.packed(spark.createDataFrame([(7, i, x) for i, x in enumerate(texts)], "h long, id long, text string")).collect()}
    assert [*passages.unpacked(pa.array([got[i] for i in range(3)], pa.binary()))] == [x.encode() for x in texts] and len(got[1]) < 100


def contexts(rows: list[np.ndarray], sides: list[bool] | None = None) -> pa.RecordBatch:
    """Rows around places of one signature, each of a text of its own, as ``_near_links`` takes them."""
    n = len(rows)
    ids = pa.array(range(n), pa.int64())
    around = pa.array([x.tobytes() for x in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int64()), ids, ids, pa.array([57] * n, pa.int32()), around, pa.array([[]] * n, pa.list_(pa.int64())), pa.array(sides or [False] * n)], ["set", "doc", "id", "at", "around", "sets", "side"])


def test_what_is_held_of_a_large_group_of_near_copies_does_not_grow_with_its_pairs():
    """800 forms with a shingle of their own in each 20: 319,600 pairs."""
    import tracemalloc

    rng = np.random.default_rng(22)
    rows = np.tile(rng.integers(1, 2**32, 115, np.uint32), (800, 1))
    for at in range(10, 115, 20):
        rows[:, at] = rng.integers(1, 2**32, 800, np.uint32)
    tracemalloc.start()
    got, linked = {}, 0
    for batch in passages._near_links(iter([contexts(list(rows))]), 46):
        linked += batch.column(4).null_count
        ids, partners = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
        for i, n in zip(ids, partners.value_lengths().to_pylist()):
            if n:
                got[int(i)] = got.get(int(i), 0) + n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == dict.fromkeys(range(800), 799) and linked == 799 and peak < 60e6, peak


def test_two_blocks_are_compared_with_each_other_only():
    rng = np.random.default_rng(23)
    rows = np.tile(rng.integers(1, 2**32, 115, np.uint32), (12, 1))
    for at in range(10, 115, 20):
        rows[:, at] = rng.integers(1, 2**32, 12, np.uint32)
    got = set()
    for batch in passages._near_links(iter([contexts(list(rows), [k % 3 == 0 for k in range(12)])]), 46):
        got |= {(r["id"], k) for r in batch.to_pylist() for k in r["partners"] or ()}
    assert got == {(i, j) for i in range(12) for j in range(12) if (i % 3 == 0) != (j % 3 == 0)}


def test_places_of_a_crowded_signature_are_marked_under_every_function():
    """Near copies may meet under the last two functions alone."""
    for function in range(passages.FUNCTIONS):
        n = passages.FEW + 2
        rows = [[7] * n, list(range(n)), [3 << 2 | function] * n, [46 << 8 | 46] * n]
        batch = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.int16())], ["key", "doc", "packed", "reach"])
        out = [r for b in passages._links(iter([batch]), 46) for r in b.to_pylist()]
        assert sorted((r["a"], r["at_a"]) for r in out if r["function"] == passages.CROWDED + function and r["b"] == 7) == [(k, 3) for k in range(n)]


def test_near_copies_that_both_repeat_shingles_are_found():
    """Forms of 60 words with one of their own, behind which a line stands twice; 8 shingles of 46 are others in the last two."""
    rng, shingles = random.Random(24), passages.Shingles()
    base, line = made(rng, 60), made(rng, 8)
    texts = [base[:20] + [w] + base[21:] + line + [w] + line + [w] for w in made(rng, 4)]
    texts += [base[:20] + [w] + base[21:26] + made(rng, 1) + base[27:44] + made(rng, 1) + base[45:] + line + [w] + line for w in made(rng, 2)]
    n, rows, cut = passages.AROUND, [], []
    for w in texts:
        h = shingles(" ".join(w).encode())
        upper = np.zeros(len(h) + 2 * n, np.uint32)
        upper[n : n + len(h)] = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        rows.append(upper[35 : 35 + 2 * n + 1])
        cut.append(h)
    assert all(len(set(x[x > 0].tolist())) < (x > 0).sum() for x in rows)
    got = {tuple(sorted(x)) for x in passages.near_only(np.arange(len(texts)), np.stack(rows), [[] for _ in texts], 46)}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if passages.common_passages(cut[i], cut[j], [(35, 35)], 46)}
    assert got == want and {(i, j) for j in range(4) for i in range(j)} <= got


def test_texts_of_repeated_words_are_not_compared_place_by_place(monkeypatch):
    """Runs of one word, as many texts have, with others of their own beside them; and two texts that differ in a word behind such runs."""
    rng, shingles, aligned = random.Random(25), passages.Shingles(), []
    texts = [["of"] * 47 + [w] * 30 + [v] * 30 for w, v in zip(made(rng, 40), made(rng, 40))]
    texts += [["of"] * 47 + ["was"] * 43 + made(rng, 1) + ["that"] * 30 for _ in range(2)]
    n, rows, ids, cut = passages.AROUND, [], [], []
    for k, w in enumerate(texts):
        h = shingles(" ".join(w).encode())
        upper = np.zeros(len(h) + 2 * n, np.uint32)
        upper[n : n + len(h)] = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for at in range(43):
            rows.append(upper[at : at + 2 * n + 1])
            ids.append(k)
            cut.append((h[max(0, at - n) : at + n + 1], min(at, n)))
    run = passages._stuck
    monkeypatch.setattr(passages, "_stuck", lambda x, y, least: aligned.append(len(x)) or run(x, y, least), raising=False)
    for side in (None, np.array(ids) % 2 == 1):
        got = [tuple(sorted(z)) for x, y in passages.near_pairs(np.array(ids), np.stack(rows), [[]] * len(ids), 46, side) for z in zip(x.tolist(), y.tolist())]
        own = [[r for r, k in enumerate(ids) if k == t] for t in (40, 41)]
        want = {(i, j) for i in own[0] for j in own[1] if passages.common_passages(cut[i][0], cut[j][0], [(cut[i][1], cut[j][1])], 46)}
        assert set(got) == want and len(got) == len(want) > 0
        # 1.5 million pairs of places otherwise
        assert aligned and sum(aligned) <= 43 * 43
        aligned.clear()
    # rows of one block alone have no pairs
    assert not list(passages.near_pairs(np.array(ids), np.stack(rows), [[]] * len(ids), 46, np.zeros(len(ids), bool)))


def test_references_are_gone_before_the_driver_collects(spark, monkeypatch):
    from collections import deque

    from crosswind.llm import common

    class Slow(deque):
        asked = 0

        def __bool__(self):
            Slow.asked += 1
            return Slow.asked < 4

    monkeypatch.setattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", Slow())
    common.released(spark)
    assert Slow.asked == 4


def test_files_of_places_are_gone_when_pairs_are_made(spark, monkeypatch):
    rng = random.Random(26)
    part = [f"p{rng.randrange(9**9)}" for _ in range(80)]
    docs = spark.createDataFrame([(i, " ".join([f"w{rng.randrange(9**9)}" for _ in range(60)] + part * (i % 2))) for i in range(40)], "doc_id long, text string")
    save, order = passages.checkpointed, []
    monkeypatch.setattr(passages, "checkpointed", lambda df: order.append(df.columns) or save(df))
    go = passages.released
    monkeypatch.setattr(passages, "released", lambda session: order.append("released") or go(session))
    found, *_ = passages.near_passages(docs)
    partners = next(k for k, x in enumerate(order) if "partners" in x)
    named = next(k for k, x in enumerate(order) if "places" in x)
    exact = next(k for k, x in enumerate(order) if "set" in x and "at_a" in x)
    assert found.count() and "released" in order[exact:partners] and "released" in order[partners:named]
