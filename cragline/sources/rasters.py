"""Folders of raster files as a Python data source: a scan over several directories, and a sink of typed single bands.

A raster is a .npy file with an optional .json beside it (``nodata``, and what else the writer was given). Folders lie on any file
system that pyarrow opens by its address, and that the driver and all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

SCANNED = "path string, status string, height int, width int, y int, values array<double>"
#: Files of a task of the scan; raster rows of an Arrow batch.
FILES, ROWS = 32, 256


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; a bare path is one of this machine's."""
    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


@dataclass
class Files(InputPartition):
    """Files of one directory, or a directory that isn't there."""

    folder: str
    paths: list[str] | None


class Scan(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders = [p for p in options.get("dirs", options.get("path", "")).split(";") if p]
        self.ending, self.per_task = options.get("ending", ".npy"), int(options.get("files", FILES))
        size = options.get("size")
        self.size = int(size) if size else None
        self.wanted: dict[str, object] = {}

    def partitions(self) -> Sequence[InputPartition]:
        """Files in the order of their names, ``files`` a task; a directory that isn't there is reported by a row."""
        out: list[InputPartition] = []
        for folder in self.folders:
            system, path = opened(folder)
            if system.get_file_info(path).type != fs.FileType.Directory:
                out.append(Files(folder, None))
                continue
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(self.ending))
            out += [Files(folder, names[a : a + self.per_task]) for a in range(0, len(names), self.per_task)]
        if not any(p.paths for p in out):
            raise ValueError(f"no files ending in {self.ending} in {'; '.join(self.folders)}")
        return out

    def _rows(self, path: str, status: str, height: int | None = None, width: int | None = None, values: np.ndarray | None = None, first: int = 0) -> Iterator[pa.RecordBatch]:
        if any({"status": status, "height": height, "width": width}[k] != v for k, v in self.wanted.items()):
            return
        n = 1 if values is None else len(values)
        lists = pa.nulls(1, pa.list_(pa.float64()))
        if values is not None:
            flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)[: n + 1]), flat)
        yield pa.record_batch([pa.array([path] * n), pa.array([status] * n), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()),
                               pa.array([None] if values is None else np.arange(first, first + n), pa.int32()), lists], names=[c.split()[0] for c in SCANNED.split(", ")])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition.paths is None:
            yield from self._rows(partition.folder, "missing directory")
            return
        system, _ = opened(partition.folder)
        for path in partition.paths:
            try:
                with system.open_input_file(path) as file:
                    version = np.lib.format.read_magic(file)
                    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
                    if len(shape) != 2 or kind.kind not in "iufb":
                        yield from self._rows(path, "unreadable")
                        continue
                    wrong = self.size is not None and shape != (self.size, self.size)
                    if wrong or any(k in self.wanted and self.wanted[k] != n for k, n in zip(("height", "width"), shape)):
                        if wrong:
                            yield from self._rows(path, "wrong size", *shape)
                        continue
                    data = np.frombuffer(file.read(shape[0] * shape[1] * kind.itemsize), kind).reshape(shape, order="F" if fortran else "C")
                nodata = self._nodata(system, path)
            except (OSError, ValueError, EOFError):
                yield from self._rows(path, "unreadable")
                continue
            for at in range(0, shape[0], ROWS):
                part = data[at : at + ROWS].astype(np.float64)
                if nodata is not None:
                    part[part == nodata] = np.nan
                yield from self._rows(path, "ok", *shape, part, at)

    @staticmethod
    def _nodata(system: fs.FileSystem, path: str) -> float | None:
        beside = path.rpartition(".")[0] + ".json"
        if system.get_file_info(beside).type != fs.FileType.File:
            return None
        with system.open_input_file(beside) as file:
            return json.loads(file.read().decode()).get("nodata")


class PushedScan(Scan):
    """A scan that takes filters; Spark allows one only with ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities on height, width and status are answered here: a file of another size is known by its header and not read on."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("height",), ("width",), ("status",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """Staged files and the names they get."""

    files: list[tuple[str, str]]


class Sink(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.kind = np.dtype(options.get("dtype", "float32"))
        nodata = options.get("nodata")
        self.nodata = float(nodata) if nodata is not None else None
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _band(self, name: str, values: list[list[float | None]]) -> np.ndarray:
        band = np.array([[np.nan if v is None else v for v in row] for row in values], np.float64)
        if band.ndim != 2:
            raise ValueError(f"{name} isn't a two-dimensional raster")
        missing = np.isnan(band)
        if missing.any() and self.nodata is None and self.kind.kind != "f":
            raise ValueError(f"{name} has pixels without a value and {self.kind} has no value for them")
        out = np.where(missing, np.nan if self.nodata is None else self.nodata, band)
        if self.kind.kind in "iu":
            bounds = np.iinfo(self.kind)
            if out.size and (out.min() < bounds.min or out.max() > bounds.max):
                raise ValueError(f"{name} has values that {self.kind} can't hold")
        return out.astype(self.kind)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.folder)
        files = []
        for batch in iterator:
            for name, values in zip(batch.column("raster").to_pylist(), batch.column("values")):
                band = self._band(name, values.as_py())
                own = f"{path}/{self.staging}/{uuid.uuid4().hex}"  # a task that runs again writes other files
                system.create_dir(own)
                with system.open_output_stream(f"{own}/{name}.json") as out:
                    out.write(json.dumps({"nodata": self.nodata, "dtype": str(self.kind)}).encode())
                with system.open_output_stream(f"{own}/{name}.npy") as out:
                    np.lib.format.write_array(out, band)
                files.append((own, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves whole files to their names; before any is moved, names must be new (unless the folder is overwritten) and different."""
        system, path = opened(self.folder)
        files = [f for m in messages if m for f in m.files]
        try:
            names = [n for _, n in files]
            there = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith((".npy", ".json"))]
            taken = {p.rpartition("/")[2].rpartition(".")[0] for p in there}
            if len(set(names)) < len(names) or (not self.overwrite and taken & set(names)):
                raise ValueError("a raster is written twice, or is there already")
            for p in there if self.overwrite else []:
                system.delete_file(p)
            for own, name in files:
                for ending in ("json", "npy"):  # a raster is there once its .npy is
                    system.move(f"{own}/{name}.{ending}", f"{path}/{name}.{ending}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class RasterFolder(DataSource):
    """format("raster_folder").

    Reading: ``dirs`` ("a;b"), ``ending``, ``size`` (files of another side length are reported, not read), ``files`` (of a task), ``push`` (filters on size and status go into the scan; needs the session's setting for it). A row for each raster row of a file with status
    ``ok``, and one row for each directory that is missing and each file of the wrong size or that can't be read. Pixels of the no-data value are null.
    Writing (append or overwrite): rows (raster string, values array<array<double>>), a file each; ``path``, ``dtype``, ``nodata``.
    A write that fails leaves no raster; what tasks stage that still run then lies in a folder ``_staging-...`` that no scan reads.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_folder"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema) -> DataSourceReader:
        return PushedScan(self.options) if self.options.get("push") == "true" else Scan(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Sink(self.options, overwrite)


def as_rasters(pixels: DataFrame, height: int, width: int, value: str = "v") -> DataFrame:
    """(raster, values): a row for each raster of ``pixels`` (raster, row, col, value); pixels without a row are null."""
    lines = pixels.groupBy("raster", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col(value).cast("double").alias("v")))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.try_element_at("m", c.cast("int")))
    rasters = lines.select("raster", "row", line.alias("line")).groupBy("raster").agg(F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("m"))
    none = F.array_repeat(F.lit(None).cast("double"), width)
    return rasters.select(F.col("raster").cast("string").alias("raster"), F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.coalesce(F.try_element_at("m", y.cast("int")), none)).alias("values"))
