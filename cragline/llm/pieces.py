"""SentencePiece BPE encoding and decoding in numpy, equal to the library's ids for its identity-normalised BPE models.

Spaces read as the model's space mark and each non-empty text gets one in front. No piece goes on from another
character to a space mark, or holds a line feed, so a text falls into units there, and each distinct
unit of a slice is encoded once. Units are encoded together by merge rounds over one flat symbol array: the best
pair rank of each unit, all its leftmost non-overlapping pairs of that rank merged at once, compaction, until
no pair remains. Where a merged piece could form a pair of an equal or better rank than its own, only
the leftmost pair is merged in that round, as a priority queue would. A very long unit, such as a page of
base64, is merged from such a queue itself. Characters that are no piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cragline.llm._spark import carried
from cragline.llm._units import SLICE, by_unit, written
from cragline.llm._words import flat, gather, pieces

MARK = "▁"
#: Letters and marks as sets of a pattern (those of ``token_files``).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: Symbols of a unit from which its merges are taken from a queue of its own: rounds over it would cost the square of its length.
LONG = 512
NO_PAIR = np.iinfo(np.int64).max


class PieceModel:
    """Vocabulary, pair ranks and decoding table of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        piece = {p: i for i, p in enumerate(names) if not special[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in piece):
            raise ValueError("pieces that go on over a space or a line feed aren't supported")
        #: whether no piece goes on from a letter to a mark or from a mark to a letter
        self.marks_apart = not any(re.search(rf"[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]", p) for p in piece)
        # symbols: ids of pieces, then single characters that are no piece but part of one
        symbol = dict(piece)
        for p in piece:
            for c in p:
                symbol.setdefault(c, size + len(symbol) - len(piece))
        self.size, self.symbols = size, size + len(symbol) - len(piece) + 1
        #: the last symbol stands for any other character
        _, ranks = np.unique(-scores, return_inverse=True)
        pairs = {}
        self.hasty = np.zeros(self.symbols, bool)
        for p, i in piece.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.symbols + right] = i
                    for part in (left, right):
                        if part < size and len(names[part]) > 1 and ranks[i] <= ranks[part]:
                            self.hasty[part] = True
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.made_of = pairs
        self.ranks = np.r_[ranks, np.zeros(self.symbols - size, ranks.dtype)].astype(np.int64)
        self.codes = np.full(0x110000, self.symbols - 1, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.codes[ord(p)] = i
        byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes = np.array([byte[b] for b in range(256)], np.int32)
        out = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.out_lengths = np.fromiter(map(len, out), np.int64, size)
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or -1."""
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def encode_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units (UTF-8 with spaces for space marks) and the offsets of each unit's ids."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 0x20] = ord(MARK)
        lengths = np.diff(np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets])
        symbols, unit = self.codes[points], np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(points))  # of each symbol's first character
        piece = np.full(len(points), -1)  # what a symbol makes with the next one
        inner = np.flatnonzero(unit[:-1] == unit[1:])
        piece[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if (lengths >= LONG).any():
            ends = np.cumsum(lengths)
            for k in np.flatnonzero(lengths >= LONG).tolist():
                own = slice(ends[k] - lengths[k], ends[k])
                left = self._merged(symbols[own].tolist(), piece[own].tolist())
                at = np.flatnonzero(left >= 0)
                done.append((left[at], np.full(len(at), k), place[own][at]))
            short = (lengths < LONG)[unit]
            symbols, unit, place, piece = (x[short] for x in (symbols, unit, place, piece))
        while len(symbols):
            rank = np.where(piece >= 0, self.ranks[piece], NO_PAIR)
            head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[head, len(symbols)])
            best = np.minimum.reduceat(rank, head)
            over = np.repeat(best == NO_PAIR, sizes)
            if over.any():  # compaction: units without a pair leave
                done.append((symbols[over], unit[over], place[over]))
                symbols, unit, place, piece, rank = (x[~over] for x in (symbols, unit, place, piece, rank))
                sizes, best = sizes[best != NO_PAIR], best[best != NO_PAIR]
                if not len(symbols):
                    break
            of = np.repeat(np.arange(len(best)), sizes)
            at = np.flatnonzero(rank == best[of])
            # of neighbouring candidates every second one overlaps the one before it
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 1
            first = np.r_[True, of[at][1:] != of[at][:-1]]
            hasty = np.zeros(len(best), bool)
            hasty[of[at[self.hasty[piece[at]]]]] = True
            at = at[np.where(hasty[of[at]], first, ~odd)]
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, unit, place, piece = symbols[keep], unit[keep], place[keep], piece[keep]
            # only the merged symbols and those before them have new pairs
            changed = np.zeros(len(symbols) + 1, bool)
            changed[at] = changed[at - 1] = True
            changed = np.flatnonzero(changed[:-1])
            piece[changed] = -1
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[unit[changed] == unit[changed + 1]]
            piece[changed] = self._pairs(symbols[changed], symbols[changed + 1])
        symbols, unit, place = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        whole, first = np.full(len(points), -1), np.zeros(len(points), np.int64)
        whole[place], first[place] = symbols, unit
        place = np.flatnonzero(whole >= 0)
        return self._split(whole[place], first[place], points[place], len(lengths))

    def _merged(self, symbols: list[int], piece: list[int]) -> np.ndarray:
        """The symbols of one long unit after all merges, each at its first character's place and -1 elsewhere: pairs wait in a queue by rank and place."""
        rank, size, n = self.ranks, self.symbols, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(int(rank[p]), i, symbols[i], symbols[i + 1], p) for i, p in enumerate(piece) if p >= 0]
        heapify(queue)
        while queue:
            _, i, a, b, p = heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j], after[i] = p, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := self.made_of.get(symbols[x] * size + symbols[y])) is not None:
                    heappush(queue, (int(rank[q]), x, symbols[x], symbols[y], q))
        return np.array(symbols, np.int64)

    def _split(self, symbols: np.ndarray, unit: np.ndarray, points: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit offsets; symbols that are no piece are single characters and become their bytes."""
        bare = np.flatnonzero(symbols >= self.size)
        raw = [self.bytes[np.frombuffer(chr(c).encode(), np.uint8)] for c in points[bare].tolist()]
        lengths = np.ones(len(symbols), np.int64)
        lengths[bare] = list(map(len, raw))
        ids = np.repeat(symbols, lengths).astype(np.int32)
        if raw:
            begin = (np.cumsum(lengths) - lengths)[bare]
            many = lengths[bare]
            ids[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())] = np.concatenate(raw)
        return ids, np.r_[0, np.cumsum(np.bincount(unit, lengths, units).astype(np.int64))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text's ids."""
        data, offsets = flat(column)
        if MARK.encode() in (raw := data.tobytes()):
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(list(map(len, texts)))].astype(np.int64)
        some = np.flatnonzero(np.diff(offsets))  # a space goes in front of these
        data = np.insert(data, offsets[some], 0x20)
        offsets = offsets + np.r_[0, np.cumsum(np.diff(offsets) > 0)]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        space, line = data == 0x20, data == 0x0A
        cut[1:-1] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
        cuts = np.flatnonzero(cut)
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ids, ends = by_unit(data, cuts, self.encode_units)
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row of ids: the pieces joined, without the one space put in front."""
        text, ends = gather(self.out, self.out_starts[ids], self.out_lengths[ids])
        raw, at = text.tobytes(), ends[offsets]
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model_path: str, carry: list[str] | None = None, with_ids: bool = True, text: str = "text") -> DataFrame:
    """Columns ``carry`` (default doc_id), n_tokens, and ids and decoded (``with_ids``) or ids_sha256 and decoded_sha256.

    One row for each row of ``docs``, in any order; null and empty texts have no ids. Rows are encoded
    where they lie, without a shuffle. Decoding starts from the ids alone.
    """
    carry = ["doc_id"] if carry is None else carry
    columns, names = carried(docs, carry)
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                ids, offsets = model.encode(part.column("t"))
                texts = model.decode(ids, offsets)
                if with_ids:
                    out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(texts, pa.binary()).cast(pa.string())]
                else:
                    out = [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (written(ids, offsets), texts)]
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(np.diff(offsets)), *out], names=[*names, "n_tokens", "x", "y"])

    kind = "x array<int>, y string" if with_ids else "x string, y string"
    out = docs.select(docs[text].alias("t"), *columns).mapInArrow(run, f"{kinds}n_tokens long, {kind}")
    return out.toDF(*carry, "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")))
