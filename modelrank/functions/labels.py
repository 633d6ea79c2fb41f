"""Labels derived from nested or numeric features, and image arrays.

The bucket bounds are fixed values of the public benchmark tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of distance buckets.
CLOSEST_OBJECT_BOUNDS = (0.0, 8.0, 8.5, 9.0, 9.5, 10.0, 100.0)
VEHICLE_BOUNDS = (-100.0, 8.0, 20.0, 999.0)
NO_VEHICLE = 1000.0


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """The place of the last bound below the value; null if there is none."""
    below = sum(F.when(value > F.lit(b), 1).otherwise(0) for b in bounds) - 1
    return F.when(value.isNotNull() & (below >= 0), below)


def closest_object(distances: Column) -> Column:
    return bucket(F.array_min(distances), CLOSEST_OBJECT_BOUNDS)


def object_count(objects: Column) -> Column:
    """Number of objects, from three on."""
    return F.size(objects) - 3


def count_of_kind(kinds: Column, kind: int) -> Column:
    return F.size(F.filter(kinds, lambda x: x == kind))


def grid_position(x: Column, cells: int, groups: int = 16) -> Column:
    """Which of ``groups`` equal groups of cells a place is in."""
    return F.floor(x / F.lit(cells / groups)).cast("int")


def closest_vehicle(kinds: Column, distances: Column) -> Column:
    """Bucket of the nearest object of a kind below 3; without one, as if it were far away."""
    near = F.transform(F.filter(F.arrays_zip(kinds.alias("k"), distances.alias("d")), lambda p: p["k"] < 3), lambda p: p["d"])
    return bucket(F.array_min(F.concat(near, F.array(F.lit(NO_VEHICLE)))), VEHICLE_BOUNDS)


def grey_to_rgb(pixels: Column) -> Column:
    return F.flatten(F.transform(pixels, lambda p: F.array_repeat(p, 3)))


def scale_to_bytes(pixels: Column) -> Column:
    return F.transform(pixels, lambda p: p * F.lit(255.0))


def centre_crop(image: np.ndarray, size: int) -> np.ndarray:
    """The middle of an image, height by width by channels; smaller sides stay."""
    h, w = image.shape[:2]
    top, left = max(0, (h - size) // 2), max(0, (w - size) // 2)
    return image[top : top + size, left : left + size]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres in line."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    image = image.astype(np.float64)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def three_channels(image: np.ndarray) -> np.ndarray:
    image = image if image.ndim == 3 else image[:, :, None]
    return image if image.shape[2] == 3 else np.repeat(image[:, :, :1], 3, axis=2)


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    return (image - np.array(mean)) / np.array(std)


def channels_first(image: np.ndarray) -> np.ndarray:
    return np.moveaxis(image, 2, 0)


def preprocess_image(image: np.ndarray, size: int, crop: int | None = None, mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0), first: bool = False, flat: bool = False) -> np.ndarray:
    """Three channels, middle, size, range 0 to 1, normalised; for use in a vectorised function."""
    image = three_channels(image)
    image = centre_crop(image, crop) if crop else image
    image = normalise(resize(image, size, size) / 255.0, mean, std)
    image = channels_first(image) if first else image
    return image.reshape(-1) if flat else image
