"""Voxel images and dense matrices from binary files: one file is one row of a scan, decoded in its task."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the NIfTI-1 format: datatype codes and NumPy types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, affine) of a NIfTI-1 file, gzipped or not. More than one volume raises."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(f"{order}8h", raw[40:56])
    if dim[0] > 3 and any(d > 1 for d in dim[4 : dim[0] + 1]):
        raise ValueError(f"{dim[4]} volumes; one is expected")
    shape = tuple(dim[1:4])
    kind = np.dtype(order + NIFTI_TYPES[struct.unpack(f"{order}h", raw[70:72])[0]])
    start, slope, shift = struct.unpack(f"{order}3f", raw[108:120])
    values = np.frombuffer(raw, kind, int(np.prod(shape)), int(start)).reshape(shape, order="F")
    if slope and (slope, shift) != (1.0, 0.0):
        values = values * slope + shift
    qform, sform = struct.unpack(f"{order}2h", raw[252:256])
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack(f"{order}12f", raw[280:328])).reshape(3, 4)
    else:
        affine[:3, :3] = np.diag(struct.unpack(f"{order}3f", raw[80:92]))
        if qform > 0:
            b, c, d, *offset = struct.unpack(f"{order}6f", raw[256:280])
            a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
            turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
            side = struct.unpack(f"{order}f", raw[76:80])[0]
            affine[:3, :3] = turn @ affine[:3, :3] @ np.diag([1, 1, -1.0 if side < 0 else 1.0])
            affine[:3, 3] = offset
    return values, affine


def voxels(spark: SparkSession, paths: DataFrame, *, keep_zeros: bool = False) -> DataFrame:
    """subject, i, j, k, value, shape, affine of the images named in paths (subject, path): the sparse long form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subject, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, affine = decode_nifti(data)
                at = np.indices(values.shape).reshape(3, -1) if keep_zeros else np.array(np.nonzero(values))
                for lo in range(0, at.shape[1], 100_000):
                    part = at[:, lo : lo + 100_000]
                    n = part.shape[1]
                    fixed = [pa.array([x] * n, pa.list_(t)) for x, t in ((list(values.shape), pa.int32()), (affine.ravel().tolist(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([subject] * n), *[pa.array(c.astype(np.int64)) for c in part], pa.array(values[tuple(part)].astype(float)), *fixed], names=["subject", "i", "j", "k", "value", "shape", "affine"])

    files = [r["path"] for r in paths.select("path").collect()]  # names only
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("_p"), "content")
    rows = paths.join(content, F.col("path") == F.col("_p")).select("subject", "content")
    return rows.mapInArrow(run, "subject string, i long, j long, k long, value double, shape array<int>, affine array<double>")


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """row, x of a dense matrix in .npy files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                m = np.load(io.BytesIO(data), allow_pickle=False)
                for lo in range(0, len(m), 1000):
                    part = m[lo : lo + 1000].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["row", "x"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, x array<double>")


def xml_labels(spark: SparkSession, path: str, row_tag: str = "label") -> DataFrame:
    """index, name of an atlas's label file; indexes there count from 0, label values from 1."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema("_index INT, _VALUE STRING").load(path)
    return df.select((F.col("_index") + 1).alias("index"), F.trim("_VALUE").alias("name"))
