"""Token ids of whole texts from the ids of their distinct units.

A unit is a stretch of text whose tokens don't depend on what stands around it. Units of a slice of texts are
dictionary-encoded by Arrow, the distinct ones are tokenised together, and the ids of all occurrences are
gathered as flat numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from cragline.llm._words import binary, flat, gather

#: Text bytes whose units are encoded together.
SLICE = 4 << 20


def by_unit(data: np.ndarray, cuts: np.ndarray, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units between ``cuts`` (from 0 to the length of ``data``), one after another, and each unit's offset in them.

    ``encode`` gets the bytes and offsets of distinct units and returns their ids and offsets.
    """
    if len(cuts) < 2:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    coded = binary(data, cuts).dictionary_encode()
    which = coded.indices.to_numpy()
    ids, offsets = encode(*flat(coded.dictionary))
    return gather(ids, offsets[which], np.diff(offsets)[which])


def written(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids of each row as decimal numbers joined by commas."""
    table = [b"%d," % i for i in range(int(ids.max(initial=0)) + 1)]
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    starts = np.cumsum(lengths) - lengths
    text, ends = gather(np.frombuffer(b"".join(table), np.uint8), starts[ids], lengths[ids])
    raw, at = text.tobytes(), ends[offsets]
    return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
