"""Page images as grey arrays of bytes: is a page a photo, and cleaning one for recognition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Share of the shorter side that the window over the background spans, and its least size.
WINDOW_SHARE, LEAST_WINDOW = 0.04, 15
#: Dark points up to which a page has no angle, and degrees up to which it stays as it is.
LEAST_DARK, LEAST_SKEW = 100, 0.5


def _around(image: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over a window of `size` along both axes, one after the other; edges repeat."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size - 1 - size // 2)
        image = pick(np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), size, axis=axis), axis=-1)
    return image


def median3(image: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(image, 1, mode="edge"), (3, 3))
    return np.median(windows, axis=(2, 3)).astype(np.uint8)


def background(image: np.ndarray) -> np.ndarray:
    """The page without its letters: the brightest, then the darkest of it, over a window larger than strokes."""
    size = max(LEAST_WINDOW, int(WINDOW_SHARE * min(image.shape))) | 1
    return _around(_around(median3(image), size, np.max), size, np.min)


def brightness_spread(image: np.ndarray) -> float:
    """Distance of the 5th from the 95th percentile of the background."""
    low, high = np.percentile(background(image), (5, 95))
    return float(high - low)


def flattened(image: np.ndarray) -> np.ndarray:
    """The image over its background, so that shadows go."""
    return np.clip(255.0 * median3(image) / np.maximum(background(image), 1), 0, 255).astype(np.uint8)


def threshold(image: np.ndarray) -> int:
    """The grey value that parts dark from bright with the most variance between both."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / below - (mass[-1] - mass) / above
        between = np.where((below > 0) & (above > 0), below * above * gap**2, 0)
    return int(between.argmax())


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), once around."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def side(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(points) + side(points[::-1]))


def skew_angle(dark: np.ndarray) -> float:
    """Degrees, above -45 and up to 45, by which the smallest rectangle around the dark points is turned, clockwise as the page is seen; 0 for LEAST_DARK points or fewer."""
    if np.count_nonzero(dark) <= LEAST_DARK:
        return 0.0
    # Of a row only its ends can be corners of the hull.
    rows = np.flatnonzero(dark.any(1))
    ends = np.concatenate([np.stack([dark[rows].argmax(1), rows], 1), np.stack([dark.shape[1] - 1 - dark[rows][:, ::-1].argmax(1), rows], 1)])
    corners = hull(ends.astype(float))
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2))
    # A rectangle of least area has a side along an edge of the hull.
    along = corners @ np.stack([np.cos(angles), np.sin(angles)])
    across = corners @ np.stack([-np.sin(angles), np.cos(angles)])
    angle = float(np.degrees(angles[(np.ptp(along, 0) * np.ptp(across, 0)).argmin()]))
    return angle - 90 if angle > 45 else angle


def turned(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned about its middle, counterclockwise as it is seen, between its points in proportion; what comes from outside is `fill`."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - h // 2, x - w // 2
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    from_x, from_y = c * x - s * y + w // 2, s * x + c * y + h // 2
    left, top = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    padded = np.pad(image.astype(float), 1, constant_values=fill)
    at = lambda dy, dx: padded[np.clip(top + dy + 1, 0, h + 1), np.clip(left + dx + 1, 0, w + 1)]
    fx, fy = from_x - left, from_y - top
    mixed = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    return np.clip(np.round(mixed), 0, 255).astype(np.uint8)


def preprocessed(image: np.ndarray) -> np.ndarray:
    """A page for recognition: shadows flattened, upright, black on white. Angles up to LEAST_SKEW stay."""
    flat = flattened(image)
    angle = skew_angle(flat <= threshold(flat))
    if abs(angle) > LEAST_SKEW:
        flat = turned(flat, angle)
    return np.where(flat > threshold(flat), 255, 0).astype(np.uint8)


def shadowed(image: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """A test image: darker from left to right, down to 1 - strength."""
    return (image * np.linspace(1, 1 - strength, image.shape[1])).astype(np.uint8)


def image_spreads(images: DataFrame) -> DataFrame:
    """Rows (page, spread) of rows (page, height, width, grey): grey holds a byte a point, row by row. Broken images have a null spread."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            spreads = [brightness_spread(np.frombuffer(g, np.uint8).reshape(h, w)) if g is not None and h and w and len(g) == h * w else None for h, w, g in zip(rows["height"], rows["width"], rows["grey"], strict=True)]
            yield pd.DataFrame({"page": rows["page"], "spread": pd.Series(spreads, dtype="float64")})

    return images.select("page", "height", "width", "grey").mapInPandas(measure, "page string, spread double")


def preprocess_images(images: DataFrame, least_spread: float = 25.0) -> DataFrame:
    """The images (page, height, width, grey) with those whose background spreads by `least_spread` or more preprocessed, and `method`, which tells them apart; broken images stay."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for page, h, w, grey in rows.itertuples(index=False):
                image = np.frombuffer(grey, np.uint8).reshape(h, w) if grey is not None and h and w and len(grey) == h * w else None
                photo = image is not None and brightness_spread(image) >= least_spread
                out.append((page, h, w, preprocessed(image).tobytes() if photo else grey, "ocr_preprocessed" if photo else "ocr_raw"))
            yield pd.DataFrame(out, columns=["page", "height", "width", "grey", "method"])

    return images.select("page", "height", "width", "grey").mapInPandas(work, "page string, height int, width int, grey binary, method string")
