"""Quality numbers and features from images, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quality_bucket

_OUT = ("path string, width int, height int, sharpness double, contrast double, "
        "brightness double, ink_density double")
_TOGETHER = 1 << 22  # pixels that are worked on at once, one image at least


def grey_features(grey: np.ndarray) -> np.ndarray:
    """Per image (image, row, column): Laplacian variance without the border, deviation, mean, share below 128."""
    g = grey.astype(np.float64)
    inner = g[:, 1:-1, 1:-1]
    edges = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * inner
    sharp = edges.var(axis=(1, 2)) if edges[0].size else np.zeros(len(g))
    return np.stack([sharp, g.std(axis=(1, 2)), g.mean(axis=(1, 2)), (g < 128).mean(axis=(1, 2))], axis=1)


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of decoded images: BGR(A) or single channel bytes in the last axis."""
    if pixels.shape[-1] == 1:
        return pixels[..., 0]
    blue, green, red = (pixels[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.299 * red + 0.587 * green + 0.114 * blue)


def image_quality(images: DataFrame) -> DataFrame:
    """Features per image row ``(origin, height, width, nChannels, data)``, as
    Spark's image source decodes it. A row that cannot be read (a size null or
    below 1, data null or of another size) keeps NULLs. Images of one size are
    worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            shape = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 3)], axis=1)
            data = batch.column(4)
            size = pa.compute.fill_null(pa.compute.binary_length(data), -1).to_numpy(zero_copy_only=False)
            good = (shape > 0).all(axis=1) & np.isin(shape[:, 2], (1, 3, 4)) & (shape.prod(axis=1) == size)
            found = np.full((n, 4), np.nan)
            for kind in np.unique(shape[good], axis=0):
                rows = np.flatnonzero(good & (shape == kind).all(axis=1))
                each = max(1, _TOGETHER // int(kind.prod()))
                for some in (rows[k:k + each] for k in range(0, len(rows), each)):
                    pixels = np.frombuffer(b"".join(data[int(k)].as_py() for k in some), np.uint8)
                    found[some] = grey_features(_grey(pixels.reshape(len(some), *kind)))
            bad = ~good
            columns = [batch.column(0), *[pa.array(shape[:, k], pa.int32(), mask=bad) for k in (1, 0)],
                       *[pa.array(found[:, k], mask=bad) for k in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return images.select("origin", F.col("height").cast("int"), F.col("width").cast("int"), F.col("nChannels").cast("int"), "data").mapInArrow(run, _OUT)


def survey_table(features: DataFrame) -> DataFrame:
    """Two decimals and a bucket; unreadable images are broken rows."""
    rounded = [F.round(c, 2).alias(c) for c in ("sharpness", "contrast", "brightness")]
    return features.select("path", "width", "height", *rounded).withColumn(
        "heuristic_bucket", quality_bucket("sharpness", "contrast", "brightness"))
