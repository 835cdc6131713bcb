"""Decoding of scan files into bricks.

Files are rows of ``binaryFile``; each is decoded in the task that read it and
leaves as bricks.  A file that fails leaves one row with its error instead.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.conventions import MODALITY_NAMES, SEGMENTATION_CODE
from voxelarium.functions import ids
from voxelarium.operators.bincounts import label_histogram
from voxelarium.operators.voxels import explode_bricks

BRICK_SCHEMA = (
    "path string, channel int, channels int, bx int, by int, bz int, x0 int, y0 int, z0 int, "
    "nx int, ny int, nz int, values array<float>, status string, error string"
)

# Decoded voxels handed back to Spark at a time, and bricks: small ones take more as rows than by their voxels.
OUTPUT_BYTES = 32 << 20
OUTPUT_ROWS = 2048

# Voxel type codes of the single-file NIfTI-1 header.
_VOXEL_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def read_nifti(content: bytes) -> np.ndarray:
    """Voxels of a single-file NIfTI-1 image, gzipped or not, slope and intercept applied."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:347] != b"n+1":
        raise ValueError("not a single-file NIfTI-1 image")
    dims = struct.unpack(order + "8h", raw[40:56])
    shape = dims[1 : 1 + dims[0]]
    code = struct.unpack(order + "h", raw[70:72])[0]
    offset, slope, intercept = struct.unpack(order + "3f", raw[108:120])
    if code not in _VOXEL_TYPES:
        raise ValueError(f"unsupported voxel type {code}")
    data = np.frombuffer(raw, order + _VOXEL_TYPES[code], int(np.prod(shape)), int(offset))
    data = data.reshape(shape, order="F")
    if slope not in (0.0, 1.0) or intercept != 0.0:
        data = data * (slope or 1.0) + intercept
    return data.astype(np.float32)


def write_nifti(voxels: np.ndarray) -> bytes:
    """Gzipped single-file NIfTI-1 image of a float32 volume."""
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, voxels.ndim, *voxels.shape, *[1] * (7 - voxels.ndim))
    struct.pack_into("<2h", header, 70, 16, 32)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    header[344:348] = b"n+1\0"
    body = np.asfortranarray(voxels, "<f4").tobytes(order="F")
    return gzip.compress(bytes(header) + body, mtime=0)


def read_npy(shape: Sequence[int]) -> Callable[[bytes], np.ndarray]:
    """Reader of ``.npy`` bytes that insists on the shape and returns float32."""
    expected = tuple(shape)

    def read(content: bytes) -> np.ndarray:
        data = np.load(io.BytesIO(content), allow_pickle=False)
        if data.shape != expected:
            raise ValueError(f"invalid shape {data.shape}, expected {expected}")
        return data.astype(np.float32)

    return read


def write_npy(voxels: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, voxels)
    return buffer.getvalue()


def _tiles(volume: np.ndarray, size: Sequence[int]):
    """Bricks of a ``(channel, x, y, z)`` array in scan order."""
    steps = [range(-(-extent // step)) for extent, step in zip(volume.shape[1:], size)]
    for channel in range(volume.shape[0]):
        for bx in steps[0]:
            for by in steps[1]:
                for bz in steps[2]:
                    corner = [b * s for b, s in zip((bx, by, bz), size)]
                    block = volume[
                        channel,
                        corner[0] : corner[0] + size[0],
                        corner[1] : corner[1] + size[1],
                        corner[2] : corner[2] + size[2],
                    ]
                    yield channel, (bx, by, bz, *corner), block


def by_channel(volume: np.ndarray, last: bool) -> np.ndarray:
    """``(channel, x, y, z)`` view; trailing axes of length one are no axes.

    Images have their channels, such as times, on the last axis, arrays on the first.
    """
    while volume.ndim > 3 and volume.shape[-1] == 1 and (last or volume.ndim > 4):
        volume = volume[..., 0]
    if volume.ndim == 3:
        return volume[None]
    if volume.ndim != 4:
        raise ValueError(f"{volume.ndim} axes, expected 3 or 4")
    return np.moveaxis(volume, -1, 0) if last else volume


def decode_volumes(
    files: DataFrame,
    reader: Callable[[bytes], np.ndarray] = read_nifti,
    size: Sequence[int] = (32, 32, 32),
    channels_last: bool | None = None,
) -> DataFrame:
    """Bricks of ``(path, content)`` rows; failures become rows with ``status = 'error'``.

    Bricks at the far edges are smaller when the extent is no multiple of the size.
    ``channels_last`` is the rule for images unless given.
    """
    last = reader is read_nifti if channels_last is None else channels_last
    names = [field.split()[0] for field in BRICK_SCHEMA.split(", ")]

    def rows_of(path: str, content: bytes) -> list[tuple]:
        try:
            volume = by_channel(reader(content), last)
            return [
                (path, channel, volume.shape[0], *place, *block.shape, block.ravel(), "ok", None)
                for channel, place, block in _tiles(volume, size)
            ]
        except Exception as e:  # any defect of a file belongs in the error table
            return [(path, *[None] * 12, "error", f"{type(e).__name__}: {e}")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path, content in zip(batch["path"], batch["content"]):
                new = rows_of(path, content)
                held += sum(0 if row[-3] is None else row[-3].nbytes for row in new)
                rows += new
                if held >= OUTPUT_BYTES or len(rows) >= OUTPUT_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(decode, BRICK_SCHEMA)


def _named(decoded: DataFrame) -> DataFrame:
    """Decoded rows with case and modality of their file name and, if there is one, the problem."""
    code = ids.modality_of(F.col("path"))
    problem = (
        F.when(F.col("status") != "ok", "unreadable")
        .when(code.isNull() | ~code.isin(*MODALITY_NAMES, SEGMENTATION_CODE), "unnamed")
        .when(F.col("channels") > 1, "several channels")
    )
    return decoded.withColumns({"case_id": ids.case_of(F.col("path")), "modality": code, "problem": problem})


def _keyed(named: DataFrame) -> DataFrame:
    return named.drop("path", "channel", "channels", "status", "error", "problem")


def scan_bricks(decoded: DataFrame) -> DataFrame:
    """Bricks of the four modalities in files named ``<case>-<modality>.nii.gz``."""
    return _keyed(_named(decoded).where(F.col("problem").isNull() & (F.col("modality") != SEGMENTATION_CODE)))


def segmentation_bricks(decoded: DataFrame) -> DataFrame:
    """Bricks of the segmentation files, whose values are labels."""
    return _keyed(_named(decoded).where(F.col("problem").isNull() & (F.col("modality") == SEGMENTATION_CODE)))


def segmentation_counts(decoded: DataFrame) -> DataFrame:
    """``case_id, label, voxels`` of the segmentation files, background included, counted inside the bricks."""
    return label_histogram(segmentation_bricks(decoded))


def segmentation_voxels(decoded: DataFrame) -> DataFrame:
    """Voxels ``case_id, x, y, z, label`` of the segmentation files, background included."""
    return explode_bricks(segmentation_bricks(decoded)).select("case_id", "x", "y", "z", F.rint("value").cast("int").alias("label"))


def _stacked(decoded: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Decoded arrays with the case of their file name and, if there is one, the problem."""
    case = F.regexp_extract("path", r"([^/]+?)(?:\.[a-z]+)*$", 1)
    problem = (
        F.when(F.col("status") != "ok", "unreadable")
        .when(case == "", "unnamed")
        .when(F.col("channels") != len(modalities), F.concat(F.col("channels"), F.lit(f" channels, expected {len(modalities)}")))
    )
    return decoded.withColumns({"case_id": case, "problem": problem})


def stacked_bricks(decoded: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Bricks of arrays that hold all ``modalities`` of a case, which the file is named after."""
    names = F.array(*[F.lit(m) for m in modalities])
    whole = _stacked(decoded, modalities).where("problem is null").withColumn("modality", F.get(names, F.col("channel")))
    return whole.drop("path", "channel", "channels", "status", "error", "problem")


def undecodable_arrays(decoded: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Files that ``stacked_bricks`` leaves out: path, problem, error."""
    return _stacked(decoded, modalities).where("problem is not null").select("path", "problem", "error").distinct()


def undecodable_files(decoded: DataFrame) -> DataFrame:
    """Files that ``scan_bricks`` and ``segmentation_voxels`` leave out: path, problem, error."""
    return _named(decoded).where(F.col("problem").isNotNull()).select("path", "problem", "error").distinct()


def encode_files(df: DataFrame, path: Column, values: str, shape: Sequence[int], writer=write_nifti) -> DataFrame:
    """Scan files as rows ``(path, content)`` from flat float arrays, channels first in ``shape``."""
    want = tuple(shape)

    def placed(voxels: np.ndarray) -> np.ndarray:
        return np.moveaxis(voxels, 0, -1) if writer is write_nifti and voxels.ndim == 4 else voxels

    @F.pandas_udf("binary")
    def encode(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: writer(placed(np.asarray(a, np.float32).reshape(want))))

    return df.select(path.alias("path"), encode(F.col(values)).alias("content"))
