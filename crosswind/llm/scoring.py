"""Scores of documents under a language model learnt from the corpus.

A text is its words, each with its end, then an end. A word's probability mixes that of the attention model (over the ids of
the word, the last marked as such) with its share of all training tokens, for words that training has:
(1 - SHARE) * attention + SHARE * c / N. Either is a distribution over words, so the mixture is one.

Word counts cover every training document. The attention model starts from a fit on at most WARM_WINDOWS windows, on the
driver, and then learns from every window of every training document, each partition on its own; partitions' models are
averaged, weighted by their windows. Documents are dealt, by a hash of id and text, into blocks of about BLOCK_BYTES, a partition
each: first to count a block's words, each once, then to score it. Its rows then come as a stream: the counts of its own words,
then its texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.llm import attention as net
from crosswind.llm.common import lower_words, released, slices, text_bytes, written

SHARE = 0.4
WARM_WINDOWS, WARM_PASSES, WARM_RATE, WARM_BATCH, RATE, RATE_BATCH = 49_152, 2, 1e-2, 128, 1e-3, 64
BLOCK_BYTES = 24 << 20
SLICE_CHARS = 240
#: Windows that are shuffled before they are learnt, so that a batch has those of several texts.
SHUFFLED = 8192
#: Windows scored together: their arrays stay in the processor's cache.
BATCH = 192
#: Bytes of texts that are scored together; more only make for fewer repeated look-ups.
TOGETHER = 4 << 20

#: A word that no text has: the end of a text.
TEXT_END = b" "


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as ``lower_words`` gives them, and how many each text has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = found.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][found.offsets.to_numpy() - found.offsets[0].as_py()]
    return words.filter(real), np.diff(ends)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of all texts, an end (0) behind each text's; how many each text has; and the words from number 1 on."""
    words, sizes = split_words(texts)
    found = words.dictionary_encode()
    word = np.zeros(len(words) + len(sizes), np.int64)
    word[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = found.indices.to_numpy() + 1
    return word, sizes + 1, found.dictionary


class _Spelt:
    """The ids of numbered words, each distinct one looked up once."""

    def __init__(self, place: Iterable[bytes], path: str):
        distinct = list(place)[1:]
        parts = [net.word_ids(path, distinct[k : k + 20_000]) for k in range(0, len(distinct), 20_000)]
        self.ids = np.concatenate([np.array([net.END], np.int32), *(x for x, _ in parts)])
        self.sizes = np.concatenate([np.array([1]), *(x for _, x in parts)])
        self.begins = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.last = np.zeros(len(self.ids), np.int32)
        self.last[self.begins + self.sizes - 1] = 1

    def __call__(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of words one after the other, which of them end a word, and where each word starts."""
        own = self.sizes[word]
        starts = np.cumsum(own) - own
        take = np.repeat(self.begins[word] - starts, own) + np.arange(own.sum())
        return self.ids[take], self.last[take], starts

    def windows(self, word: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The windows of texts of so many words, which stand one after the other in word, and how many each text has."""
        ids, last, starts = self(word)
        if len(lengths) == 1:  # may be very long, so without the places of all its ids
            own = net.windows_of(ids, last)
            return own, np.array([len(own)])
        return net.windows_of_all(ids, last, np.r_[starts[np.r_[0, np.cumsum(lengths)[:-1]]], len(ids)])


def _together(lengths: list[int], words: int = 40_000) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts that have about so many words together; a longer text is by itself."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + words, side="right")))
        yield at, upto
        at = upto


def pieces(columns: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """Texts in order, as many at a time as have about TOGETHER bytes; a longer one is by itself."""
    held, size = [], 0
    for column in columns:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + TOGETHER - size, side="right"))
            if upto == at and not held:
                upto += 1
            if upto > at:
                held.append(column.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
            if upto < len(column):
                yield pa.concat_arrays(held)
                held, size = [], 0
            at = upto
    if held:
        yield pa.concat_arrays(held)


def block_words(dealt: DataFrame) -> DataFrame:
    """block, word and n: the words of each block, ends as TEXT_END, and how often training documents of it have them, counted
    per task first. dealt: block, train and text."""

    def run(batches):
        total: dict[int, Counter[bytes]] = {}
        for batch in slices(batches, 512):
            for block, train, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                own = total.setdefault(block, Counter())
                if train:
                    own.update(lower_words(x))
                    own[TEXT_END] += 1
                else:
                    for w in lower_words(x):
                        own[w] += 0
            if sum(map(len, total.values())) > 1_000_000:
                yield from counted(total)
                total.clear()
        yield from counted(total)

    def counted(total):
        for block, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int64)), _strings(own), pa.array(list(own.values()), pa.int64())], ["block", "word", "n"])

    return dealt.select("block", "train", "text").mapInArrow(run, "block long, word string, n long")


def known_words(dealt: DataFrame, blocks: int) -> DataFrame:
    """block, word, n, c and first: the words of each block that training documents have, n times in rows of this block and c times in
    all; first tells one row of each word. A word has a row for each block, so none is in more rows than there are blocks.

    A block's texts should stand together: its words are then counted to the end before they are shuffled."""
    words = written(block_words(dealt))
    released(dealt.sparkSession)
    own = Window.partitionBy("word").orderBy("word")
    parts = max(blocks, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = words.repartition(parts, "word").withColumns({"c": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "first": F.row_number().over(own) == 1})
    known = written(found.filter("c > 0"))
    released(dealt.sparkSession)
    return known


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c: how often training documents have each token, ends counted as TEXT_END."""
    rows = docs.select(F.lit(0).cast("long").alias("block"), _train().alias("train"), "text").filter("train")
    return block_words(rows).groupBy("word").agg(F.sum("n").alias("c"))


def _train() -> Column:
    return F.coalesce(~held_out(F.col("doc_id")), F.lit(True))


def _strings(words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def _training_windows(docs: DataFrame, path: str) -> DataFrame:
    """For the start: a window (bytes of 32-bit numbers) of each training document, at a place told by a hash of its id; and that hash.

    Where there are fewer documents than WARM_WINDOWS, as many windows of each as make up that number."""
    train = docs.filter(~held_out(F.col("doc_id")) | F.col("doc_id").isNull())
    each = -(-WARM_WINDOWS // max(1, train.count()))
    train = train.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(each))))
    text, hashed = F.coalesce("text", F.lit("")), F.xxhash64("doc_id", "j")
    room = F.greatest(F.length(text) - SLICE_CHARS, F.lit(1))
    start = F.when(F.pmod(hashed, F.lit(8)) == 0, 0).otherwise(F.pmod(F.shiftright(hashed, 3), room)).cast("int")
    rows = train.select(hashed.alias("hash"), start.alias("start"), F.length(text).alias("chars"), F.substring(text, start + 1, F.lit(SLICE_CHARS)).alias("part"))

    def run(batches):
        for batch in slices(batches, 1024):
            hashes, found = [], []
            for h, start, chars, part in zip(*(batch.column(k).to_pylist() for k in range(3)), text_bytes(batch.column(3))):
                ws = lower_words(part)
                ends = start + SLICE_CHARS >= chars
                ws = ws[1 if start else 0 : None if ends else -1]
                ids, sizes = net.word_ids(path, ws)
                last = np.zeros(len(ids), np.int32)
                last[np.cumsum(sizes) - 1] = 1
                if ends:
                    ids, last = np.append(ids, np.int32(net.END)), np.append(last, np.int32(1))
                if not len(ids):
                    continue
                own = net.windows_of(ids, last, begins=not start)
                own = own[1:] if start else own  # the first has no context, though the text has
                if len(own):
                    hashes.append(h)
                    found.append(own[h % len(own)].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["hash", "window"])

    return rows.mapInArrow(run, "hash long, window binary")


def learnt(docs: DataFrame, start: np.ndarray, path: str) -> DataFrame:
    """numbers and seen for each partition of the training documents: the model after all windows of all its texts, and how many these are."""

    def run(batches):
        net.keep_memory()
        own, seen, rng = net.unflat(start.copy()), 0, np.random.default_rng(5)
        adam = net.Adam(own)
        held, n = [], 0

        def step(held):
            w = np.concatenate(held)
            w = w[rng.permutation(len(w))]
            for k in range(0, len(w), RATE_BATCH):
                adam.step(net.gradients(own, *net.parts(w[k : k + RATE_BATCH]))[1], RATE)

        for texts in pieces(batch.column(0) for batch in batches):
            word, lengths, distinct = numbered(texts)
            spelt, ends = _Spelt([TEXT_END, *distinct.cast(pa.large_binary()).to_pylist()], path), np.cumsum(lengths)
            for first, upto in _together(lengths):
                windows, sizes = spelt.windows(word[ends[first] - lengths[first] : ends[upto - 1]], lengths[first:upto])
                for own_windows in np.split(windows, np.cumsum(sizes)[:-1]):
                    held.append(own_windows)
                    n += len(own_windows)
                    if n >= SHUFFLED:
                        step(held)
                        seen, held, n = seen + n, [], 0
        if n:
            step(held)
            seen += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([net.flat(own)], pa.list_(pa.float32())), pa.array([seen], pa.int64())], ["numbers", "seen"])

    return docs.filter(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()).select("text").mapInArrow(run, "numbers array<float>, seen long")


def fitted(docs: DataFrame, path: str | None = None) -> np.ndarray:
    """The model's numbers, learnt from the training documents. What reaches the driver is bounded by WARM_WINDOWS and the model's size."""
    path = path or net.vocabulary_path()
    warm = _training_windows(docs, path).orderBy("hash", "window").limit(WARM_WINDOWS).select("window").toArrow()
    model = net.initial()
    if warm.num_rows:
        net.train(model, np.stack([np.frombuffer(x, np.int32) for x in warm.column(0).to_pylist()]), WARM_RATE, WARM_PASSES, WARM_BATCH)
    start = net.flat(model)
    each = learnt(docs, start, path)
    sums = each.select(F.posexplode("numbers").alias("place", "x"), "seen").groupBy("place").agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).cast("float").alias("x"))
    got = sums.toArrow()
    numbers = start.copy()
    numbers[got.column("place").to_numpy()] = got.column("x").to_numpy()
    return numbers


class _Scorer:
    def __init__(self, numbers: np.ndarray, path: str, n: int, v: int):
        self.model, self.path, self.n, self.v = net.unflat(numbers), path, n, v

    def block(self, texts: pa.Array, words: pa.Array, counts: np.ndarray):
        """n_tokens, n_known, base_score and score of each text; words are those of training, TEXT_END among them, and counts theirs."""
        word, lengths, distinct = numbered(texts)
        distinct = pa.concat_arrays([pa.array([TEXT_END.decode()], pa.large_string()), distinct])
        at = pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy()
        spelt = _Spelt(distinct.cast(pa.large_binary()).to_pylist(), self.path)
        c = np.append(counts, 0)[at].astype(np.float64)
        base = np.log10(c + 1) - (np.log10(self.n + 1.0 * (self.v + 1)))
        share = np.log(SHARE) + np.log(np.maximum(c, 1e-300) / max(1, self.n))
        share[c == 0] = -np.inf
        ends = np.cumsum(lengths)
        out = []
        for at, upto in _together(lengths):
            part = word[ends[at] - lengths[at] : ends[upto - 1]]
            scores = np.logaddexp(np.log1p(-SHARE) + self._attention(part, lengths[at:upto], spelt), share[part])
            bounds = np.r_[0, np.cumsum(lengths[at:upto])[:-1]]
            out.append((lengths[at:upto], np.add.reduceat((c[part] > 0).astype(np.int64), bounds), np.add.reduceat(base[part], bounds), np.add.reduceat(scores, bounds) / log(10)))
        return [np.concatenate(x) for x in zip(*out)]

    def _attention(self, part, lengths, spelt) -> np.ndarray:
        """Natural log probability of each of the words in part; a very long text is taken as a whole, in windows."""
        windows, _ = spelt.windows(part, lengths)
        got = np.concatenate([net.log_probs(self.model, *net.parts(windows[k : k + BATCH])) for k in range(0, len(windows), BATCH)])
        real = net.parts(windows)[1] != net.NOTHING
        own = spelt.sizes[part]
        return np.add.reduceat(got[real].astype(np.float64), np.cumsum(own) - own)


def scored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; only doc_id and text are read.

    A null text is empty: one token, its end. A null id counts as training. Rows that repeat an id are rows of their own.
    Without training documents counts are zero and the model is as it starts.
    """
    path = path or net.vocabulary_path()
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = docs.withColumns({"block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"), "train": _train()})
    known = known_words(dealt.repartitionById(blocks, F.col("block").cast("int")), blocks)
    facts = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("first").cast("long")), F.lit(0)).alias("v")).first()
    n, v = facts["n"], facts["v"]
    numbers = fitted(docs, path)
    released(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    first = known.select("block", F.lit(0).alias("kind"), F.col("word").alias("text"), F.col("c").alias("c"), F.lit(None).cast(kind).alias("doc_id"))
    rows = first.union(dealt.select("block", F.lit(1), "text", F.lit(0).cast("long"), "doc_id"))
    rows = rows.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind")

    def score(batches):
        net.keep_memory()
        scorer, words, counts, kept, texts, size = _Scorer(numbers, path, n, v), [], [], [], [], 0

        def scored():
            nonlocal words, counts
            if len(words) != 1:
                words, counts = [pa.concat_arrays([pa.array([], pa.large_string()), *words])], [np.concatenate([np.empty(0, np.int64), *counts])]
            got = scorer.block(pa.concat_arrays(texts), words[0], counts[0])
            return pa.RecordBatch.from_arrays([pa.concat_arrays(kept), *(pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in slices(batches, 1024):
            kinds = batch.column(1).to_numpy()
            upto = int((kinds == 0).sum())
            if upto:
                words.append(batch.column(2).slice(0, upto).cast(pa.large_string()))
                counts.append(batch.column(3).slice(0, upto).to_numpy())
            if upto == len(kinds):
                continue
            kept.append(batch.column(4).slice(upto))
            texts.append(batch.column(2).slice(upto))
            size += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
            if size > TOGETHER:
                yield scored()
                kept, texts, size = [], [], 0
        if texts:
            yield scored()

    rows = rows.select("block", "kind", "text", "c", "doc_id").mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
