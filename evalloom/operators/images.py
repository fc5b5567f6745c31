"""Pixel measurements per image, as NumPy inside Arrow batches.

Image bytes stay in the scan stage: the output has no pixel column, so nothing
large is shuffled afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalloom import constants as C

PIXEL_COLUMNS = ("height", "width", "channels", "data")
STEPS = np.arange(1, 256)
PER_VALUE = np.concatenate([[0], np.rint((255 << 12) / STEPS).astype(np.int64)])
PER_SPREAD = np.concatenate([[0], np.rint((180 << 12) / (6.0 * STEPS)).astype(np.int64)])


def hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (0-179), saturation, value in the usual fixed-point rounding."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    spread = v - np.minimum(np.minimum(r, g), b)
    s = (spread * PER_VALUE[v] + (1 << 11)) >> 12
    sector = np.where(v == r, g - b, np.where(v == g, b - r + 2 * spread, r - g + 4 * spread))
    h = (sector * PER_SPREAD[spread] + (1 << 11)) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, v], axis=-1)


def detect_color(rgb: np.ndarray) -> str | None:
    """Most frequent colour among saturated, bright pixels; ties go to the first in the fixed order."""
    h, s, v = np.moveaxis(hsv(rgb), -1, 0)
    vivid = np.bincount(h[(s >= C.MIN_SATURATION) & (v >= C.MIN_VALUE)], minlength=181)
    counts = {name: sum(int(vivid[a : b + 1].sum()) for a, b in spans) for name, spans in C.HUE_RANGES.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] >= C.MIN_COLOR_PIXELS else None


def _spread(mask: np.ndarray, grow: bool) -> np.ndarray:
    """3x3 dilation or erosion; pixels outside the image never decide."""
    padded = np.pad(mask, 1, constant_values=not grow)
    rows, cols = mask.shape
    views = [padded[i : i + rows, j : j + cols] for i in range(3) for j in range(3)]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected labels (-1 outside): least pixel number, spread by neighbours and pointer jumps."""
    size = mask.size
    ids = np.where(mask, np.arange(size).reshape(mask.shape), size)
    while True:
        padded = np.pad(ids, 1, constant_values=size)
        rows, cols = mask.shape
        low = np.minimum.reduce([padded[i : i + rows, j : j + cols] for i in range(3) for j in range(3)])
        low = np.where(mask, low, size)
        jump = np.append(low.ravel(), size)
        low = np.where(mask, jump[low], size)
        if np.array_equal(low, ids):
            return np.where(mask, ids, -1)
        ids = low


def detect_position(rgb: np.ndarray) -> str | None:
    """Quadrant of the only dark component of plausible size; NULL when there is none or several."""
    dark = rgb.max(axis=-1) <= C.DARK_VALUE
    for grow in (True, False, False, True, True):  # close, open, dilate
        dark = _spread(dark, grow)
    labels = components(dark)
    ids, areas = np.unique(labels[labels >= 0], return_counts=True)
    fitting = ids[(areas >= C.MIN_AREA) & (areas <= C.MAX_AREA)]
    if len(fitting) != 1:
        return None
    ys, xs = np.nonzero(labels == fitting[0])
    height, width = dark.shape
    slack_x, slack_y = width * C.EDGE_TOLERANCE, height * C.EDGE_TOLERANCE
    left, right = xs.min() >= width // 2 - slack_x, xs.max() + 1 <= width // 2 + slack_x
    top, bottom = ys.min() >= height // 2 - slack_y, ys.max() + 1 <= height // 2 + slack_y
    for name, fits in (
        ("top left", right and bottom), ("top right", left and bottom),
        ("bottom left", right and top), ("bottom right", left and top),
    ):
        if fits:
            return name
    return None


DETECTORS = {"color": detect_color, "position": detect_position}


def run_detectors(df: DataFrame, detectors: Mapping[str, Callable[[np.ndarray], str | None]] = DETECTORS) -> DataFrame:
    """Each detector fills ``grading_detected_<x>``; an exception fills ``grading_error_<x>`` of that row only.

    ``df`` has height, width, channels and data (blue-green-red rows) as the
    image source gives them; detectors get red-green-blue arrays.
    """
    keep = [f for f in df.schema.fields if f.name not in PIXEL_COLUMNS]
    added = [n for d in detectors for n in (f"grading_detected_{d}", f"grading_error_{d}")]
    schema = T.StructType([*keep, *[T.StructField(n, T.StringType()) for n in added]])

    def measure(row) -> list[str | None]:
        bgr = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
        rgb = bgr[..., [2, 1, 0]] if row.channels >= 3 else np.repeat(bgr[..., :1], 3, axis=-1)
        out: list[str | None] = []
        for fn in detectors.values():
            try:
                out += [fn(rgb), None]
            except Exception as ex:  # one detector's failure belongs to its row
                out += [None, str(ex)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values = pd.DataFrame([measure(r) for r in rows.itertuples(index=False)], columns=added, index=rows.index, dtype=object)
            yield pd.concat([rows[[f.name for f in keep]], values], axis=1)

    return df.mapInPandas(run, schema)
