"""Token ids of a corpus as Parquet list columns, written in key order and read back selectively.

Files hold consecutive key ranges and rows ascend by key in them. Token ids are dictionary-encoded (a row
group uses few of them), all other columns are delta-encoded integers, row groups are small and the page indexes
let a reader skip to the rows or the columns it needs: positions and lengths are read without touching tokens.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.llm._spark import parallelism, shared_folder, text_volume
from cragline.llm._units import SLICE, by_unit
from cragline.llm._words import BLANK, flat, gather, pieces, span_hashes

#: Text bytes of a file; bytes of a row group and of a page.
FILE_BYTES, GROUP_BYTES, PAGE_BYTES = 16 << 20, 8 << 20, 256 << 10
#: Distinct units that a worker remembers.
REMEMBERED = 2_000_000
#: Bytes that can't stand next to a cut: blanks, separators and the lead bytes of wide blanks.
UNSAFE = BLANK.copy()
UNSAFE[0x1C:0x20] = True
UNSAFE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters of a byte; single marks that may end a plain unit.
LETTER = np.zeros(256, bool)
LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
MARKS = np.zeros(256, bool)
MARKS[[*b".,;:!?"]] = True


def _written() -> dict[int, str]:
    """Bytes as the byte-level alphabet writes them, each word of a plain unit behind a blank."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return shown | {0x20: " " + shown[0x20]} | {b: " " + shown[b] for b in np.flatnonzero(MARKS).tolist()}


WRITTEN = _written()
#: The same for words without a blank, each behind a line feed.
BARE = WRITTEN | {0x0A: " "}


def letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte is (of) a letter: ASCII, or of two bytes up to U+00FF."""
    letter = LETTER[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    letter[wide], letter[wide + 1] = True, True
    return letter


def plain_units(data: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Which of the units (a byte and more each) are a blank, then letters (ASCII, or of two bytes up to U+00FF), then one mark or none."""
    begin, end = offsets[units], offsets[units + 1]
    end = end - MARKS[data[end - 1]]
    others = np.r_[0, np.cumsum(~letters(data))]
    return (data[begin] == 0x20) & (end > begin + 1) & (others[end] == others[begin + 1])


class ByteTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library. Strings of special tokens in a text are ordinary text, or with ``added`` (as in the library) those tokens.

    The pre-tokenizer always splits between a character and a single space that another word follows, so
    texts fall into units there; distinct units that such splits bound are encoded as one string. The usual byte-level one (``usual``)
    also splits between a letter and a mark, and on both sides of a single line feed between other characters.
    Of plain units (a space and letters, perhaps a mark; or letters alone) the words of that pre-tokenizer are known, so they go to the merges without it.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        usual = made["normalizer"] is None and made["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.usual = usual
        self.merger = Tokenizer(self.tokenizer.model) if usual else None  # the same model, not a copy
        if usual:
            self.merger.pre_tokenizer = CharDelimiterSplit(" ")
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character for each byte
        self._forget()

    def _forget(self) -> None:
        #: hashes of remembered units, ascending, with each one's place; their bytes; their ids
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.units, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, marks: bool = True) -> np.ndarray:
        """Where units begin and end; with ``marks`` also between letters and marks, where the file's pre-tokenizer splits there."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        single = self._ended(data)[:-1] & np.r_[~UNSAFE[data[2:]], False][: max(len(data) - 1, 0)]
        cut[1:-1] |= (data[1:] == 0x20) & single
        if self.usual:
            line = (data[1:] == 0x0A) & single
            cut[1:-1] |= line
            cut[2:] |= line
        if self.usual and marks:
            letter, mark = letters(data), MARKS[data]
            cut[1:-1] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        return np.flatnonzero(cut)

    @staticmethod
    def _ended(data: np.ndarray) -> np.ndarray:
        """Whether the character that ends at each byte can't be a blank of any kind."""
        bad = BLANK[data] | (data >= 0x1C) & (data < 0x20)
        bad[1:] |= data[:-1] == 0xC2
        bad[2:] |= UNSAFE[data[:-2]] & (data[:-2] > 0xC2)
        return ~bad

    def remembered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct units (a byte and more each); a worker remembers up to ``REMEMBERED`` of them, found by a hash and compared by their bytes."""
        if len(self.places) > REMEMBERED:
            self._forget()
        lengths = np.diff(offsets)
        hashes = span_hashes(data, offsets[:-1], offsets[1:])
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        place = np.where(self.hashes[at] == hashes, self.places[at], -1) if len(self.hashes) else np.full(len(lengths), -1)
        place[place >= 0] = np.where(self._same(data, offsets, place), place[place >= 0], -1)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, fresh_ends = gather(data, offsets[new], lengths[new])
            ids, ends = self.encode_units(fresh, fresh_ends)
            place[new] = np.arange(len(self.places), len(self.places) + len(new))
            order = new[np.argsort(hashes[new])]
            to = np.searchsorted(self.hashes, hashes[order])
            self.hashes, self.places = np.insert(self.hashes, to, hashes[order]), np.insert(self.places, to, place[order])
            self.units, self.ends = np.r_[self.units, fresh], np.r_[self.ends, fresh_ends[1:] + len(self.units)]
            self.ids, self.offsets = np.r_[self.ids, ids], np.r_[self.offsets, ends[1:] + len(self.ids)]
        return gather(self.ids, self.offsets[place], np.diff(self.offsets)[place])

    def _same(self, data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each unit with a place has the bytes of the unit remembered there."""
        found = np.flatnonzero(place >= 0)
        held, lengths = place[found], np.diff(offsets)[found]
        same = self.ends[held + 1] - self.ends[held] == lengths
        found, held, lengths = found[same], held[same], lengths[same]
        mine, ends = gather(data, offsets[found], lengths)
        theirs, _ = gather(self.units, self.ends[held], lengths)
        if not np.array_equal(mine, theirs):
            same[np.flatnonzero(same)] = np.logical_and.reduceat(mine == theirs, ends[:-1])
        return same

    def encode_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(offsets)
        long = lengths > 2
        begin, end = np.where(long, offsets[:-1], 0), np.where(long, offsets[1:] - 1, 0)
        bound = np.flatnonzero(long & (data[begin] == 0x20) & ~UNSAFE[data[begin + long]] & self._ended(data)[end])
        alone = np.ones(len(lengths), bool)
        alone[bound] = False
        alone = np.flatnonzero(alone)
        plain = plain_units(data, offsets, bound) if self.merger else np.zeros(len(bound), bool)
        bound = bound[np.argsort(plain, kind="stable")]  # plain units after others, bare words last
        first, bare = len(bound) - int(plain.sum()), len(bound)
        if self.merger:
            others = np.r_[0, np.cumsum(~letters(data))][offsets]
            word = (np.diff(others)[alone] == 0) & (lengths[alone] > 0)
            bound, alone = np.r_[bound, alone[word]], alone[~word]
        text, at = gather(data, offsets[bound], lengths[bound])
        ids, many = [], np.zeros(len(lengths), np.int64)
        steps = np.unique(np.r_[np.arange(0, len(bound), 4096), first, bare, len(bound)])
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            part = text[at[a] : at[b]]
            if a < first:
                found = self.tokenizer.encode_batch_fast([part.tobytes().decode()], add_special_tokens=False)
            else:
                part = np.insert(part, at[a:b] - at[a], 0x0A) if a >= bare else part
                found = self.merger.encode_batch_fast([part.tobytes().decode("latin-1").translate(BARE if a >= bare else WRITTEN)], add_special_tokens=False)
            found = np.array(found[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.lengths[found]), at[a + 1 : b + 1] - at[a]) + 1
            many[bound[a:b]] = np.diff(np.r_[0, ends])
            ids.append(found)
        raw = data.tobytes()
        for found in self.tokenizer.encode_batch_fast([raw[offsets[i] : offsets[i + 1]].decode() for i in alone.tolist()], add_special_tokens=False):
            ids.append(np.array(found.ids, np.int32))
        many[alone] = list(map(len, ids[len(steps) - 1 :]))
        order = np.r_[bound, alone]
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(many[order]) - many[order]
        return gather(np.concatenate([*ids, np.zeros(0, np.int32)]), starts, many)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text's ids. Texts that hold an added token are encoded whole."""
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode(column)
        ids, offsets = self._encode(pc.if_else(pa.array(whole), pa.scalar("", column.type), column))
        found = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(column.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        starts, many = offsets[:-1].copy(), np.diff(offsets)
        many[whole] = list(map(len, found))
        starts[whole] = len(ids) + np.cumsum(many[whole]) - many[whole]
        return gather(np.concatenate([ids, *found]), starts, many)

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = flat(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts = self.cuts(data, offsets)
        ids, ends = by_unit(data, cuts, self.remembered)
        return ids, ends[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, added: bool = False) -> ByteTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores already
    return ByteTokenizer(path, added)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, text: str = "text", key: str = "doc_id", added: bool = False) -> None:
    """Writes doc_id, file, start (in its file), n_tokens and tokens (with ``end_id``) as Parquet, ascending by key.

    Null texts are empty: they hold the end id alone. Null keys come last; rows of one key ascend by text.
    Nothing but the texts is shuffled, once, by key range.
    """
    _, volume = text_volume(docs, text)
    files = max(parallelism(docs.sparkSession), -(-volume // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, file, start = byte_tokenizer(tokenizer_path, added), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                ids, offsets = tokenizer.encode(part.column("t"))
                ids = np.insert(ids, offsets[1:], np.int32(end_id))
                offsets = offsets + np.arange(len(offsets))
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([part.column("k"), pa.array(np.full(part.num_rows, file, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), tokens], names=["doc_id", "file", "start", "n_tokens", "tokens"])
                start += int(offsets[-1])

    order = [F.col("k").asc_nulls_last(), F.col("t")]
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    dealt = rows.repartitionByRange(files, order[0]).sortWithinPartitions(*order)
    out = dealt.mapInArrow(run, "doc_id long, file int, start long, n_tokens long, tokens array<int>")
    writer = out.write.mode("errorifexists").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
    writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 2000).parquet(folder)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """(file, before): the number of ids in all earlier files; reads two small columns only. A row for each file."""
    files = spark.read.parquet(folder).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start in the whole corpus, n_tokens, ids_crc32), all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            at = tokens.offsets.to_numpy()
            ids = memoryview(np.ascontiguousarray(tokens.values.to_numpy().astype("<u4", copy=False)).view(np.uint8))
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("file"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "start", "n_tokens", "ids_crc32"])

    read = spark.read.parquet(folder).select("doc_id", "file", "start", "tokens")
    rows = read.mapInArrow(run, "doc_id long, file int, start long, n_tokens long, ids_crc32 long")
    joined = rows.join(positions(spark, folder), "file")
    return joined.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
