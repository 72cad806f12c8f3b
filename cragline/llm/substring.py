"""Exact removal of passages that an earlier document holds, by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Consecutive windows that share a minimiser (the least
hash among their word grams) travel as one packed string to the minimiser's bucket, so equal windows
always meet. In its bucket each window is sorted and compared with its equals; the least doc_id of each goes
back to the group of documents that sent it.

Documents are dealt into groups of a few MB by a hash of their id. A group sends each distinct packed
string once, with the least doc_id it has there: a passage that a third of all documents share reaches its
bucket once from each group, however many documents hold it. Only windows that some other group holds with a
smaller doc_id come back. A minimiser that very many different passages hold would fill one bucket; the windows of
such ones are dealt by all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import carried, parallelism, text_volume
from cragline.llm._words import ODD, binary, flat, gather, joined, mixed, pieces, span_hashes, word_spans

#: Words of the grams that minimisers are chosen from; windows in one packed string at most.
GRAM, LONGEST = 3, 64
#: Text bytes in a group of documents and in a bucket.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: One in so many rows is read to find hot minimisers, and so many of them are told to the tasks at most.
SAMPLED, HOTTEST = 16, 100_000
NULL_KEY = np.iinfo(np.int64).max
SENT = "grp int, bucket int, raw long, blob binary"
BACK = "grp int, bucket int, raw long, blob binary"


def _pack(*parts: bytes) -> tuple[int, bytes]:
    """Parts with their lengths before them, compressed; (size before, bytes)."""
    raw = b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])
    return len(raw), zstandard.compress(raw, 5)


def _unpack(size: int, blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob, max_output_size=size)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


class Packed:
    """The super-k-mers of a group of documents: distinct strings by bucket, and where each occurs.

    Strings are numbered in the order of their bytes, so the numbers don't depend on the order of the rows.
    """

    def __init__(self, texts: pa.ChunkedArray, keys: np.ndarray, width: int, buckets: int, hot: np.ndarray = np.zeros(0, np.uint64)):
        self.data, offsets = flat(texts)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        text, at, to = joined(self.data, self.starts, self.ends)
        n = len(at)
        row = np.repeat(np.arange(len(keys)), np.diff(self.first))
        #: windows by the index of their first word
        window = np.flatnonzero(np.arange(n) + width <= self.first[1:][row]) if n else np.zeros(0, np.int64)
        self.occurs = self.row = self.of = self.windows = np.zeros(0, np.int64)
        self.strings: list[bytes] = []
        self.bucket = np.zeros(0, np.int32)
        self.least = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.uint64)
        if not len(window):
            return
        word = span_hashes(text, at, to)
        gram, last = word.copy(), n - GRAM + 1
        for k in range(1, GRAM):
            gram[:last] = gram[:last] * np.uint64(ODD) + word[k : last + k]
        gram = mixed(gram)
        low, span, reach = gram[:last], 1, width - GRAM + 1
        while span < reach:  # minima over span grams, doubled until they cover a window
            step = min(span, reach - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        low = low[window]
        alone = np.isin(low, hot)
        new = alone | np.r_[True, (low[1:] != low[:-1]) | (window[1:] != window[:-1] + 1) | (row[window][1:] != row[window][:-1])]
        begin = np.flatnonzero(new)
        place = np.arange(len(window)) - np.repeat(begin, np.diff(np.r_[begin, len(window)]))
        begin = np.flatnonzero(place % LONGEST == 0)
        route = low.copy()
        if alone.any():  # a window of a hot minimiser goes where its words say
            route[alone] = 0
            for k in range(width):
                route[alone] = route[alone] * np.uint64(ODD) + word[window[alone] + k]
        many = np.diff(np.r_[begin, len(window)])
        self.occurs, self.row = window[begin], row[window[begin]]
        raw = text.tobytes()
        sent = [raw[a:b] for a, b in zip(at[self.occurs].tolist(), to[self.occurs + many + width - 2].tolist())]
        # numbered by content: the rows of a group come in another order each time they are shuffled, and answers name strings by number
        self.strings = sorted(set(sent))
        number = dict(zip(self.strings, range(len(self.strings))))
        self.of = np.fromiter(map(number.__getitem__, sent), np.int64, len(sent))
        self.windows, self.bucket = np.zeros(len(number), np.int64), np.zeros(len(number), np.int32)
        self.windows[self.of] = many
        self.bucket[self.of] = (mixed(route[begin]) % np.uint64(buckets)).astype(np.int32)
        self.minimiser = np.zeros(len(number), np.uint64)
        self.minimiser[self.of] = low[begin]
        self.least = np.full(len(number), NULL_KEY)
        np.minimum.at(self.least, self.of, keys[self.row])

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its strings' numbers in ascending order)."""
        order = np.argsort(self.bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.bucket[order])) + 1):
            if len(part):
                yield int(self.bucket[part[0]]), part


def _keys(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["k"], int(NULL_KEY)).to_numpy()


def hot_minimisers(docs: DataFrame, width: int, text: str, key: str) -> np.ndarray:
    """Minimisers whose different strings alone would overfill a bucket, estimated on one in ``SAMPLED`` rows.

    Their windows are dealt by a hash of all their words instead, each as a string of its own: equal windows still meet, so this only
    decides where the work is done. There is at most one for each half bucket of strings; the ``HOTTEST`` largest are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", GROUP_BYTES):
                group = Packed(part.column("t"), np.zeros(part.num_rows, np.int64), width, 1)
                low, of = np.unique(group.minimiser, return_inverse=True)
                yield pa.record_batch([pa.array(low.view(np.int64)), pa.array(np.bincount(of, list(map(len, group.strings)), len(low)).astype(np.int64))], names=["low", "size"])

    taken = docs.where(F.pmod(F.xxhash64(docs[key].cast("long"), F.octet_length(docs[text])), F.lit(SAMPLED)) == 0).select(docs[text].alias("t"))
    found = taken.mapInArrow(run, "low long, size long").groupBy("low").agg(F.sum("size").alias("size")).where(F.col("size") * SAMPLED > BUCKET_BYTES // 2)
    rows = found.orderBy(F.desc("size"), "low").limit(HOTTEST).collect()
    return np.sort(np.array([r["low"] for r in rows], np.int64).view(np.uint64))


def _send(width: int, buckets: int, hot: np.ndarray = np.zeros(0, np.uint64)):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Packed(table["t"], _keys(table), width, buckets, hot)
        rows = [(b, *_pack(group.least[part].tobytes(), b"\n".join([group.strings[i] for i in part.tolist()]))) for b, part in group.by_bucket()]
        bucket, raw, blob = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(bucket, pa.int32()), pa.array(raw, pa.int64()), pa.array(blob, pa.binary())], names=["grp", "bucket", "raw", "blob"])

    return run


def least_keys(ids: np.ndarray, start: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """For each window (``width`` exact word ids from ``start`` on): the least ``key`` among its equals.

    Windows are sorted by a hash; the equals in a run of one hash are found by comparing all their words.
    """
    mark = np.zeros(len(start), np.uint64)
    for k in range(width):
        mark = mark * np.uint64(ODD) + mixed(ids[start + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(mark)
    same = mark[order][1:] == mark[order][:-1]
    shared = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    out = key.copy()
    while len(shared):
        sorted_mark = mark[shared]
        head = np.flatnonzero(np.r_[True, sorted_mark[1:] != sorted_mark[:-1]])
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(shared)]))
        lead = shared[head][run]
        equal = np.ones(len(shared), bool)
        for k in range(width):
            equal &= ids[start[shared] + k] == ids[start[lead] + k]
        least = np.full(len(head), NULL_KEY)
        np.minimum.at(least, run[equal], key[shared[equal]])
        out[shared[equal]] = least[run[equal]]
        shared = shared[~equal]  # other words with the same hash: once more among themselves
    return out


def _meet(width: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(n, b) for n, b in zip(table["raw"].to_pylist(), table["blob"].to_pylist())]
        least = [np.frombuffer(p[0], np.int64) for p in parts]
        data = np.frombuffer(b"".join([p[1] + b"\n" for p in parts]), np.uint8)
        line = np.flatnonzero(data == 0x0A) + 1
        starts, ends, first = word_spans(data, np.r_[0, line])
        spans, offsets = gather(data, starts, ends - starts)
        ids = binary(spans, offsets).dictionary_encode().indices.to_numpy()
        windows = np.diff(first) - width + 1
        of = np.repeat(np.arange(len(windows)), windows)
        start = np.repeat(first[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
        own = np.concatenate(least)[of]
        best = least_keys(ids, start, own, width)
        rows, at = [], 0
        for group, bucket, mine in zip(table["grp"].to_pylist(), table["bucket"].to_pylist(), least):
            n = int(windows[: len(mine)].sum())
            windows = windows[len(mine) :]
            lower = np.flatnonzero(best[at : at + n] < own[at : at + n])
            if len(lower):
                rows.append((group, bucket, *_pack(lower.astype(np.int32).tobytes(), best[at : at + n][lower].tobytes())))
            at += n
        columns = zip(*rows) if rows else ((),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["grp", "bucket", "raw", "blob"])

    return run


def _remove(width: int, buckets: int, names: list[str], with_text: bool, hot: np.ndarray = np.zeros(0, np.uint64)):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _keys(left)
        group = Packed(left["t"], keys, width, buckets, hot)
        offsets = np.r_[0, np.cumsum(group.windows)]
        low = np.repeat(group.least, group.windows)
        parts = dict(group.by_bucket())
        for bucket, raw, blob in zip(*(right[c].to_pylist() for c in ("bucket", "raw", "blob"))):
            at, least = _unpack(raw, blob)
            mine = parts[bucket]
            many = group.windows[mine]
            place = np.repeat(offsets[mine] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            low[place[np.frombuffer(at, np.int32)]] = np.frombuffer(least, np.int64)
        low, ends = gather(low, offsets[group.of], group.windows[group.of])
        at = np.repeat(group.occurs - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        gone = at[low < np.repeat(keys[group.row], np.diff(ends))]
        change = np.zeros(len(group.starts) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + width, -1)
        kept = np.cumsum(change[:-1]) == 0
        counted = np.r_[0, np.cumsum(kept)]
        words = np.diff(group.first)
        removed = words - np.diff(counted[group.first])
        text, begin, _ = joined(group.data, group.starts[kept], group.ends[kept])
        edge = np.r_[begin, len(text)][counted[group.first]]
        raw = text.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        last = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        return pa.table([*(left[c] for c in names), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), last], names=[*names, "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, width: int = 13, carry: list[str] | None = None, with_text: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Removes each word covered by a window whose words also start in a row with a smaller key.

    Returns the columns named in ``carry`` (default: the key) and n_words, n_removed and kept: the kept words joined
    by one space (``with_text``) or the SHA-256 of that text. A null text has no words. Rows of one key remove
    nothing from each other, so exact repeats of a row stay alike. A null key is above all others: such
    rows lose what any keyed row holds. Windows are judged on the input. An empty table gives an empty result.
    """
    rows, volume = text_volume(docs, text)
    groups = max(2 * parallelism(docs.sparkSession), -(-volume // GROUP_BYTES))
    buckets = max(2 * parallelism(docs.sparkSession), -(-volume // (BUCKET_BYTES // 3)))
    hot = hot_minimisers(docs, width, text, key)
    carry = [key] if carry is None else carry
    columns, names = carried(docs, carry)
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry))
    dealt = docs.select(
        F.pmod(F.xxhash64(docs[key].cast("long"), F.octet_length(docs[text])), F.lit(groups)).cast("int").alias("grp"),
        docs[key].cast("long").alias("k"), docs[text].alias("t"), *columns,
    )
    sent = dealt.groupBy("grp").applyInArrow(_send(width, buckets, hot), SENT)
    back = sent.groupBy("bucket").applyInArrow(_meet(width), BACK)
    out = dealt.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(
        _remove(width, buckets, names, with_text, hot), f"{kinds}{', ' if kinds else ''}n_words long, n_removed long, kept string")
    return out.toDF(*carry, "n_words", "n_removed", "kept")


def texts_without_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` with every repeated passage cut from its text, and n_chars as it then is; other columns and all rows stay.

    A text that loses nothing stays as it is; of one that does, the kept words are joined by one space.
    """
    out = without_repeats(docs, width, docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*[
        F.coalesce(F.length("text"), F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
