"""Which tokens of two tokenizers stand for the same bytes, and how often over a corpus.

Each Arrow partition is encoded by both, and DuckDB aligns it inside the task: tables of token intervals, a window sum over common
ends for the groups, ASOF joins for the first and the last token that each token overlaps, a range join where these
differ. Texts fall into units where both tokenizers always cut, so only the distinct units of a slice are
encoded and aligned, and a text's links follow from how often it holds each. What a text holds is written once as a Parquet table; the counts of pairs
in each task are merged by Spark, and the table is read again with them.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import pinned, shared_folder
from cragline.llm._units import SLICE, by_unit
from cragline.llm._words import binary, flat, gather, pieces
from cragline.llm.pieces import piece_model
from cragline.llm.token_files import byte_tokenizer

#: Pairs whose counts every worker holds at most (16 bytes each); those of the others meet the texts by a shuffle.
KNOWN = 1_000_000
NAMES = ["n_a", "n_b", "n_groups", "n_links"]
COUNTED = ", ".join(f"{c} long" for c in NAMES)

#: Distinct units that a worker remembers at most, with their pairs and groups.
REMEMBERED = 250_000

#: Left tokens with the number of common ends before their own, and whether they end at one; then the byte offsets of these ends.
GROUPED = """SELECT i, ended, CAST(sum(ended) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - ended AS BIGINT) AS grp, e
 FROM (SELECT a.i, a.e, CAST(b.e IS NOT NULL AS INTEGER) AS ended FROM ta a LEFT JOIN tb b ON a.e = b.e) ORDER BY i"""
#: The right token at which each left one starts, and all others that start before it ends. Steps are tables, so that each is planned by its true size.
OVERLAPS = (
    "CREATE OR REPLACE TEMP TABLE firsts AS SELECT a.unit, a.id AS a, a.e, b.id AS b, b.e AS b_e FROM ta a ASOF JOIN tb b ON a.s >= b.s",
    "CREATE OR REPLACE TEMP TABLE longer AS SELECT unit, a, e, b_e FROM firsts WHERE e > b_e",
    "CREATE OR REPLACE TEMP TABLE others AS SELECT x.unit, x.a, b.id AS b FROM longer x JOIN tb b ON b.s >= x.b_e AND b.s < x.e",
    "CREATE OR REPLACE TEMP TABLE fresh AS SELECT unit, a * {wide} + b AS pair, count(*) AS k FROM (SELECT unit, a, b FROM firsts UNION ALL SELECT unit, a, b FROM others) GROUP BY ALL",
    "INSERT INTO pairs SELECT * FROM fresh",
)
HELD = "SELECT doc, pair, CAST(sum(m * k) AS INTEGER) AS times FROM used JOIN pairs USING (unit) GROUP BY ALL ORDER BY doc, pair"


class Aligner:
    """Both tokenizers, the bytes of their tokens, and a DuckDB connection; one for each worker and two files."""

    def __init__(self, byte_path: str, piece_path: str):
        import duckdb

        self.left, self.right = byte_tokenizer(byte_path), piece_model(piece_path)
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        names = self.left.tokenizer.get_vocab(with_added_tokens=False)
        out: list[bytes] = [b""] * len(self.left.lengths)
        for token, i in names.items():
            out[i] = bytes(byte_of[c] for c in token)
        self.out_lengths = np.fromiter(map(len, out), np.int64, len(out))
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths
        self.out = np.frombuffer(b"".join(out), np.uint8)
        #: ids in decimals with each of three signs behind: same side goes on, other side, next group
        written = [b"%d%c" % (i, sign) for i in range(max(len(out), self.right.size)) for sign in b",|;"]
        self.sign_lengths = np.fromiter(map(len, written), np.int64, len(written))
        self.sign_starts = np.cumsum(self.sign_lengths) - self.sign_lengths
        self.signs = np.frombuffer(b"".join(written), np.uint8)
        self.folder = tempfile.TemporaryDirectory()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.folder.name})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.good, self.counts = np.zeros(0, bool), np.zeros((4, 0), np.int64)
        self.text, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.con.execute("CREATE OR REPLACE TEMP TABLE pairs (unit BIGINT, pair BIGINT, k BIGINT)")

    def _sides(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, offsets by unit, byte lengths) of either side, of units whose bytes both give back; no tokens for others."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        space, line = data == 0x20, data == 0x0A
        cut[1:-1] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
        cuts = np.flatnonzero(cut)
        ids, ends = by_unit(data, cuts, self.right.encode_units)
        found = [(*self.left.encode_units(data, offsets), self.out, self.out_starts, self.out_lengths),
                 (ids, ends[np.searchsorted(cuts, offsets)], self.right.out, self.right.out_starts, self.right.out_lengths)]
        good, sides = np.ones(len(offsets) - 1, bool), []
        for ids, at, out, starts, lengths in found:
            text, ends = gather(out, starts[ids], lengths[ids])
            if not np.array_equal(text, data):
                raw, mine, ends = data.tobytes(), text.tobytes(), ends[at]
                good &= [raw[a:b] == mine[c:d] for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())]
        for ids, at, _, _, lengths in found:
            many = np.where(good, np.diff(at), 0)
            ids, at = gather(ids, at[:-1], many)
            sides.append((ids.astype(np.int64), at, lengths[ids]))
        return [*sides, good]

    def _align(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Adds the groups, links and counts of new units to what is known."""
        a, b, good = self._sides(data, offsets)
        begin, many, ends = len(self.known), len(good), [np.cumsum(x[2]) for x in (a, b)]
        for name, (ids, at, lengths), e in zip(("ta", "tb"), (a, b), ends):
            self.con.register("given", pa.table({"i": np.arange(len(ids)), "unit": begin + np.repeat(np.arange(many), np.diff(at)), "id": ids, "s": e - lengths, "e": e}))
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        grouped = self.con.execute(GROUPED).fetchnumpy()
        group, ended = np.asarray(grouped["grp"]), np.asarray(grouped["ended"])
        of_right = np.searchsorted(np.asarray(grouped["e"])[ended > 0], ends[1])  # common ends before a right token's own
        for step in OVERLAPS:
            self.con.execute(step.format(wide=self.right.size))
        links = self.con.execute("SELECT unit, CAST(sum(k) AS BIGINT) AS k FROM fresh GROUP BY unit").fetchnumpy()
        found = np.zeros((4, many), np.int64)
        found[0], found[1] = np.diff(a[1]), np.diff(b[1])
        np.add.at(found[2], np.repeat(np.arange(many), found[0]), ended)
        found[3][np.asarray(links["unit"]) - begin] = np.asarray(links["k"])
        text, at = self._written(a, b, [group, of_right])
        self.good, self.counts = np.r_[self.good, good], np.concatenate([self.counts, found], 1)
        self.text, self.at = np.r_[self.text, text], np.r_[self.at, at[1:] + len(self.text)]

    def _units(self, column: pa.Array) -> np.ndarray:
        """The number of each distinct unit."""
        if len(self.known) > REMEMBERED:
            self._forget()
        units = column.to_pylist()
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        if len(new):
            data, offsets = flat(column)
            self._align(*gather(data, offsets[new], np.diff(offsets)[new]))
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(map(units.__getitem__, new.tolist()), place[new].tolist()))
        return place

    def _written(self, a: tuple, b: tuple, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Groups of all units as text, each with ``;`` behind, and each unit's offset in it."""
        key = np.concatenate([2 * groups[0], 2 * groups[1] + 1])
        order = np.argsort(key, kind="stable")
        ids, key = np.concatenate([a[0], b[0]])[order], key[order]
        after = np.r_[key[1:], np.iinfo(np.int64).max][: len(key)]
        sign = np.where(after == key, 0, np.where(after // 2 == key // 2, 1, 2))
        text, ends = gather(self.signs, self.sign_starts[3 * ids + sign], self.sign_lengths[3 * ids + sign])
        return text, ends[a[1] + b[1]]

    def aligned(self, column: pa.Array) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The counts, digests, and pairs (with their offsets and times) of each text. Null and empty texts, and those that not both give back, have none."""
        data, offsets = flat(column)
        some = np.flatnonzero(np.diff(offsets))  # a space goes in front of these
        data = np.insert(data, offsets[some], 0x20)
        offsets = offsets + np.r_[0, np.cumsum(np.diff(offsets) > 0)]
        rows = len(offsets) - 1
        if not len(data):
            return {c: np.zeros(rows, np.int64) for c in NAMES}, [""] * rows, np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        cuts = self.left.cuts(data, offsets, self.right.marks_apart)
        coded = binary(data, cuts).dictionary_encode()
        which, first = self._units(coded.dictionary)[coded.indices.to_numpy()], np.searchsorted(cuts, offsets)
        doc, many = np.repeat(np.arange(rows), np.diff(first)), len(self.good)
        bad = np.zeros(rows, bool)
        bad[doc[~self.good[which]]] = True
        held, times = np.unique((doc * many + which)[~bad[doc]], return_counts=True)
        self.con.register("used", pa.table({"doc": held // many, "unit": held % many, "m": times}))
        found = self.con.execute(HELD).fetchnumpy()
        counts = {c: np.where(bad, 0, np.diff(np.r_[0, np.cumsum(x[which])][first])) for c, x in zip(NAMES, self.counts)}
        raw, ends = gather(self.text, self.at[which], np.diff(self.at)[which])
        raw, ends = raw.tobytes(), ends[first].tolist()
        digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if n else "" for x, y, n in zip(ends[:-1], ends[1:], counts["n_a"].tolist())]
        ends = np.searchsorted(np.asarray(found["doc"]), np.arange(rows + 1))
        return counts, digests, ends, np.asarray(found["pair"], np.int64), np.asarray(found["times"], np.int32)


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _lists(ends: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in values]


def write_aligned(docs: DataFrame, folder: str, byte_path: str, piece_path: str, text: str, key: str) -> None:
    """Writes a row for each row of ``docs``: row (a number of its own), key, the counts, groups_sha256, and its distinct pairs with how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                counts, digests, ends, pairs, times = both.aligned(part.column("t"))
                yield pa.record_batch([part.column("k"), *map(pa.array, counts.values()), pa.array(digests, pa.string()), *_lists(ends, pairs, times)],
                                      names=["key", *counts, "groups_sha256", "pairs", "times"])

    read = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    out = read.mapInArrow(run, f"key long, {COUNTED}, groups_sha256 string, pairs array<long>, times array<int>")
    out.select(F.monotonically_increasing_id().alias("row"), "*").write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair; only pairs that several hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pairs")
            found, n = np.unique(pairs.values.to_numpy()[pairs.offsets[0].as_py() : pairs.offsets[-1].as_py()], return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n)], names=["pair", "n"])

    return held.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")


def aligned_counts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256: one row for each row of ``docs``.

    n_best: links whose pair is one of those that most rows hold among all pairs of its left token; count_sum: over all links, how many rows
    hold the pair. Null and empty texts and those whose bytes either tokenizer doesn't give back have zeros and ''. Each of repeated rows counts. Other columns
    of ``docs`` are not read; an empty table gives an empty result. The table of what texts hold stays in the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    write_aligned(docs, folder, byte_path, piece_path, text, key)
    held, wide = spark.read.parquet(folder), piece_model(piece_path).size
    counted = pinned(pair_counts(held))
    # a row for each left token at most: the vocabulary is the bound
    tops = counted.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = np.ones(len(byte_tokenizer(byte_path).lengths) + 1, np.int64)
    best[tops["a"].to_numpy()] = tops["n"].to_numpy()
    more = counted.count() > KNOWN
    known = pinned(counted.orderBy(F.desc("n"), "pair").limit(KNOWN)) if more else counted
    sent = known.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((sent["pair"].to_numpy(), sent["n"].to_numpy(), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = pairs.offsets.to_numpy().astype(np.int64)
            code, m = pairs.values.to_numpy()[ends[0] : ends[-1]], times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()].astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            n = np.where(hit, counts[at], 1) if len(codes) else np.ones(len(code), np.int64)  # a pair that isn't known counts once; more is added below
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (np.where(n == best[code // wide], m, 0), n * m)]
            rest = np.diff(np.r_[0, np.cumsum(~hit)][ends])
            yield pa.record_batch([*(batch.column(c) for c in ("row", "key", *NAMES, "groups_sha256")), *map(pa.array, sums), *_lists(np.r_[0, np.cumsum(rest)], code[~hit], m[~hit])],
                                  names=["row", "key", *NAMES, "groups_sha256", "n_best", "count_sum", "rest", "rest_times"])

    out = held.mapInArrow(run, f"row long, key long, {COUNTED}, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if more:
        out = with_rest(out, counted.join(known, "pair", "left_anti"), spark.createDataFrame(tops.rename_columns(["a", "top"])) if len(tops) else None, wide)
    return out.select("key", *NAMES, "n_best", "count_sum", "groups_sha256").toDF(key, *NAMES, "n_best", "count_sum", "groups_sha256")


def with_rest(out: DataFrame, counted: DataFrame, tops: DataFrame, wide: int) -> DataFrame:
    """``out`` with what pairs outside the known ones add: their counts less the one already added, and links that are the best of their left token."""
    rows = out.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("m"))
    counted = counted.join(F.broadcast(tops), F.expr(f"pair div {wide}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    added = rows.join(counted, "pair").groupBy("row").agg(F.sum(F.col("m") * F.col("is_best")).alias("more_best"), F.sum(F.col("m") * (F.col("n") - 1)).alias("more_sum"))
    added = added.withColumnRenamed("row", "of")
    both = out.join(added, out["row"] == added["of"], "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
