"""A Python data source of .npy tiles, and configuration merging for drivers."""

from __future__ import annotations

import copy

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(";") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition):
        array = np.load(partition.path, mmap_mode="r")
        if array.ndim != 2:
            raise ValueError(f"{partition.path} isn't a two-dimensional array")
        for y in range(array.shape[0]):
            yield partition.path, y, [float(v) for v in array[y]]


class NpyTiles(DataSource):
    """format("npy_tiles").option("paths", "a.npy;b.npy"): a row (path, y, values) for each array row, a partition for each file. The folder is one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "npy_tiles"

    def schema(self) -> str:
        return "path string, y int, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def merged(base: dict, stage: dict) -> dict:
    """``base`` with each section of ``stage`` laid over it; two levels."""
    out = copy.deepcopy(base)
    for section, values in stage.items():
        out[section] = {**out[section], **values} if isinstance(values, dict) and isinstance(out.get(section), dict) else copy.deepcopy(values)
    return out
