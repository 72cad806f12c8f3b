"""A quality classifier on learned subword embeddings.

A document's features are hashed words, pairs of neighbouring words (all pairs of equal words are one) and the characters' n-grams of each word; each has
a learned vector, a document's vector is their average and a softmax over a linear output gives the label's probability. Vectors
and output are trained together by numpy stochastic gradient descent on a bounded, seeded sample of labelled documents.

To score, each vector is folded with the output into one number (the difference of both labels' scores), so that a
document's score is a mean of numbers of one table of fixed size. A slice of texts computes that number once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm._words import PIECE, binary, flat, gather, mixed, pieces, span_hashes, word_spans

#: Hashed features; numbers in a vector; lengths of character n-grams.
BUCKETS, DIMS, GRAMS = 1 << 18, 8, (2, 3, 4)
#: Documents in the sample at most, rounds over it, documents in a step, first step size.
SAMPLE, ROUNDS, BATCH, RATE = 4000, 6, 16, 2.0
SEED = 5
PAIR = np.uint64(0x632BE59BD9B4E019)


class Features:
    """Feature buckets of a slice of texts: of each distinct word, which word stands where, and of each pair."""

    def __init__(self, column: pa.Array):
        data, offsets = flat(column)
        starts, ends, self.first = word_spans(data, offsets)
        spans, cuts = gather(data, starts, ends - starts)
        coded = binary(spans, cuts).dictionary_encode()
        self.which = coded.indices.to_numpy()
        words, at = flat(coded.dictionary)
        #: features of distinct words: their buckets and each word's offset in them
        self.buckets, self.offsets = self._of_words(words, at)
        whole = span_hashes(words, at[:-1], at[1:])[self.which]
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.pairs = np.flatnonzero(self.row[:-1] == self.row[1:]) if len(whole) else np.zeros(0, np.int64)
        same = whole[self.pairs] == whole[self.pairs + 1]  # a word said twice is one feature, whatever the word
        pair = np.where(same, np.uint64(SEED), whole[self.pairs] * PAIR + whole[self.pairs + 1])
        self.pair_buckets = (mixed(pair) % np.uint64(BUCKETS)).astype(np.int64)

    @staticmethod
    def _of_words(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(at) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        found, of = [span_hashes(words, at[:-1], at[1:])], [np.arange(n)]
        # each word between marks, as characters
        marked = np.insert(words, np.r_[at[:-1], at[1:]], 0x20)
        points = np.frombuffer(marked.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = (np.cumsum(points == 0x20) - 1) // 2
        gram = np.zeros(len(points), np.uint64)
        for size in range(1, max(GRAMS) + 1):
            last = len(points) - size + 1
            if last <= 0:
                break
            gram[:last] = gram[:last] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :]
            if size in GRAMS:
                inside = np.flatnonzero(word[:last] == word[size - 1 :])
                found.append(mixed(gram[inside] + np.uint64(size)))
                of.append(word[inside])
        found, of = np.concatenate(found), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return (found[order] % np.uint64(BUCKETS)).astype(np.int64), np.r_[0, np.cumsum(np.bincount(of, minlength=n))]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, its weight in the document's average) of each text; for training."""
        pair_at = np.searchsorted(self.row[self.pairs], np.arange(len(self.first)))
        for k, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            w = self.which[a:b]
            own, _ = gather(self.buckets, self.offsets[w], np.diff(self.offsets)[w])
            every = np.r_[own, self.pair_buckets[pair_at[k] : pair_at[k + 1]]]
            bucket, many = np.unique(every, return_counts=True)
            yield bucket, (many / max(len(every), 1)).astype(np.float32)

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean of ``table`` over all features of each text; 0 where it has none."""
        lengths = np.diff(self.offsets)
        sums = np.add.reduceat(np.r_[table[self.buckets], 0.0], self.offsets[:-1]) if len(lengths) else np.zeros(0)
        n = len(self.first) - 1
        total = np.bincount(self.row, sums[self.which], n) + np.bincount(self.row[self.pairs], table[self.pair_buckets], n)
        many = np.bincount(self.row, lengths[self.which], n) + np.bincount(self.row[self.pairs], minlength=n)
        return total / np.maximum(many, 1)


def trained(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The folded table of the trained model and its bias: score = 1 / (1 + exp(-(mean + bias))).

    Without both labels there is nothing to tell apart: the table is empty of signal and the bias gives the labels' rate (0.5 without any).
    """
    rate = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(BUCKETS), float(np.log(rate / (1 - rate)))
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for part in pieces(pa.record_batch([pa.array(texts, pa.string())], names=["t"]), "t", PIECE):
        docs += Features(part.column("t")).rows()
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    output, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    steps = ROUNDS * -(-len(docs) // BATCH)
    step = 0
    for _ in range(ROUNDS):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            some = [i for i in batch if len(docs[i][0])]
            hidden = np.zeros((len(batch), DIMS), np.float32)
            for j, i in enumerate(batch):
                bucket, weight = docs[i]
                hidden[j] = weight @ vectors[bucket] if len(bucket) else 0
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(batch)), labels[batch]] -= 1
            rate = RATE * (1 - step / steps)
            back = error @ output.T
            output -= rate * hidden.T @ error / len(batch)
            bias -= rate * error.mean(0) * 0.1
            for j, i in enumerate(batch):
                bucket, weight = docs[i]
                if len(some):
                    vectors[bucket] -= rate * weight[:, None] * back[j]
            step += 1
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 2, text: str = "text", key: str = "doc_id", least: float = 0.7) -> DataFrame:
    """key, held_out, score and predicted (score >= ``least``) of each row of ``docs``.

    The model learns from the ``SAMPLE`` labelled keys outside the held-out fold that a seeded hash puts first (all, if fewer);
    of several labels of a key the largest counts, null labels none. Null and blank texts get the bias's score. Only
    the texts are scored: key, language and source are never read. The driver gets the sample; the table that tasks get holds
    ``BUCKETS`` numbers.
    """
    known = labels.where(labels[key].isNotNull() & labels[label].isin(0, 1)).select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y"))
    known = known.where(fold(F.col("k")) != held_out).groupBy("k").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("k", F.lit(SEED)), "k").limit(SAMPLE)
    picked = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).join(F.broadcast(known), "k")  # at most SAMPLE keys
    rows = sorted(picked.collect(), key=lambda r: (r["k"], r["t"] or ""))
    table, bias = trained([r["t"] for r in rows], np.array([r["y"] for r in rows], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value.astype(np.float64)
        for batch in batches:
            for part in pieces(batch, "t"):
                score = 1 / (1 + np.exp(-(Features(part.column("t")).means(numbers) + bias)))
                yield pa.record_batch([part.column("k"), part.column("h"), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["k", "h", "score", "predicted"])

    rows = docs.select(docs[key].alias("k"), (F.coalesce(fold(docs[key]), F.lit(-1)) == held_out).alias("h"), docs[text].alias("t"))
    out = rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, h boolean, score double, predicted int")
    return out.toDF(key, "held_out", "score", "predicted")
