"""Image steps on grey pixels, with numpy inside Arrow batches; recognisers are functions given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CANVAS_WIDTH, CANVAS_HEIGHT = 1241, 1755
IMAGE = "w int, h int, pixels binary"
#: Shares of a comb cell that strips are made of.
WIDTHS = (0.62, 0.72, 0.82)


def _image(w: int, h: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(h, w)


def _taps(size: int, to: int, reach: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For every output place, the input places that count and their Lanczos weights; places outside weigh nothing."""
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    at = np.floor(centre - reach * scale).astype(int)[:, None] + np.arange(int(2 * reach * scale) + 2)
    x = (at - centre[:, None]) / scale
    w = np.where((np.abs(x) < reach) & (at >= 0) & (at < size), np.sinc(x) * np.sinc(x / reach), 0.0)
    return np.clip(at, 0, size - 1), w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    (rows, down), (columns, across) = _taps(image.shape[0], h), _taps(image.shape[1], w)
    tall = np.einsum("hk,hkw->hw", down, image.astype(float)[rows])
    return np.clip(np.round(np.einsum("wk,hwk->hw", across, tall[:, columns])), 0, 255).astype(np.uint8)


def resize_to_canvas(pages: DataFrame, width: int = CANVAS_WIDTH, height: int = CANVAS_HEIGHT) -> DataFrame:
    """(page_id, w, h, pixels) at the canvas size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [resize(_image(w, h, p), width, height).tobytes() for w, h, p in zip(batch["w"], batch["h"], batch["pixels"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "w": width, "h": height, "pixels": made})

    return pages.select("page_id", "w", "h", "pixels").mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, {IMAGE}")


def comb_strip(image: np.ndarray, cells: list[tuple[int, int, int, int]], inner: float) -> np.ndarray | None:
    """The middles of inked cells side by side with a border of four; None if no cell has ink."""
    boxes = np.array(cells).reshape(-1, 4)
    # ink of every box at once, from sums over the dark pixels above and to the left
    dark = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    dark[1:, 1:] = (image < 200).cumsum(0).cumsum(1)
    left, top, right, bottom = boxes.T
    ink = dark[bottom, right] - dark[top, right] - dark[bottom, left] + dark[top, left]
    inked = boxes[ink > 0.02 * (right - left) * (bottom - top)]
    if not len(inked):
        return None
    height = int((inked[:, 3] - inked[:, 1]).max())
    rim = ((inked[:, 2] - inked[:, 0]) * (1 - inner) / 2).astype(int)
    middles = [np.pad(image[t:b, l + r : w - r], ((0, height - (b - t)), (0, 0)), constant_values=255) for (l, t, w, b), r in zip(inked, rim, strict=True)]
    return np.pad(np.hstack(middles), 4, constant_values=255)


def box_with_margin(image: np.ndarray, box: tuple[int, int, int, int], dx: int = 4, dy: int = 6) -> np.ndarray:
    """A whole value box with some room around it, at twice its size."""
    x1, y1, x2, y2 = box
    part = image[max(0, y1 - dy) : min(image.shape[0], y2 + dy), max(0, x1 - dx) : min(image.shape[1], x2 + dx)]
    return resize(part, part.shape[1] * 2, part.shape[0] * 2)


def read_strips(pages: DataFrame, recognise: Callable[[np.ndarray], tuple[str, float]], widths: tuple[float, ...] = WIDTHS) -> DataFrame:
    """(page_id, field, width_ord, text, score) of comb fields (page_id, field, w, h, pixels, cells array<array<int>>).

    A field without ink reads '' with score 1. The recogniser is any picklable function from pixels to text and score.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                image = _image(r.w, r.h, r.pixels)
                for k, inner in enumerate(widths):
                    strip = comb_strip(image, [tuple(c) for c in r.cells], inner)
                    rows.append((r.page_id, r.field, k, *(("", 1.0) if strip is None else recognise(strip))))
            yield pd.DataFrame(rows, columns=["page_id", "field", "width_ord", "text", "score"])

    return pages.mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, field string, width_ord int, text string, score double")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map of point pairs by least squares on the direct linear transform, with normalised points."""

    def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - mid) ** 2).sum(1)).mean(), 1e-12)
        return (p - mid) * s, np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])

    (a, ta), (b, tb) = norm(src), norm(dst)
    (x, y), (u, v), one, zero = a.T, b.T, np.ones(len(a)), np.zeros((3, len(a)))
    rows = np.vstack([np.stack([x, y, one, *zero, -u * x, -u * y, -u], 1), np.stack([*zero, x, y, one, -v * x, -v * y, -v], 1)])
    # the triangular factor has nine rows at most, however many pairs there are
    h = np.linalg.inv(tb) @ np.linalg.svd(np.linalg.qr(rows, mode="r"))[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.column_stack([points, np.ones(len(points))]) @ h.T
    return q[:, :2] / q[:, 2:]


def robust_homography(src: np.ndarray, dst: np.ndarray, within: float = 5.0, rounds: int = 300, seed: int = 1) -> tuple[np.ndarray | None, int]:
    """The map that most pairs agree with, from samples of four, and how many do."""
    if len(src) < 4:
        return None, 0
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(rounds):
        at = rng.choice(len(src), 4, replace=False)
        try:
            h = homography(src[at], dst[at])
        except np.linalg.LinAlgError:
            continue
        if h is None:
            continue
        with np.errstate(all="ignore"):
            near = np.sqrt(((project(h, src) - dst) ** 2).sum(1)) < within
        if near.sum() > best.sum():
            best = near
    return (homography(src[best], dst[best]) if best.sum() >= 4 else None), int(best.sum())


def fit_homographies(pairs: DataFrame, least: int = 10) -> DataFrame:
    """(image, h array of 9 or null, inliers) from matched points (image, x, y, u, v); too few inliers fail."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "u", "v"])
        h, n = robust_homography(pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "h": [h.ravel().tolist() if h is not None and n >= least else None], "inliers": [n]})

    return pairs.groupBy("image").applyInPandas(run, f"image {dict(pairs.dtypes)['image']}, h array<double>, inliers long")


def warp(image: np.ndarray, h: np.ndarray, w: int, height: int) -> np.ndarray:
    """The image seen through the map, white outside, by bicubic interpolation (convolution with a = -0.75)."""
    ys, xs = np.mgrid[0:height, 0:w]
    at = project(np.linalg.inv(h), np.column_stack([xs.ravel(), ys.ravel()]).astype(float))
    low = np.floor(at).astype(int)
    near = at - low
    padded = np.pad(image.astype(float), 2, constant_values=255)
    reach = np.arange(-1, 3)
    columns = np.clip(low[:, :1] + reach + 2, 0, padded.shape[1] - 1)
    rows = np.clip(low[:, 1:] + reach + 2, 0, padded.shape[0] - 1)
    across, down = (_cubic(np.abs(reach - near[:, k : k + 1])) for k in (0, 1))
    out = np.einsum("pi,pij,pj->p", down, padded[rows[:, :, None], columns[:, None, :]], across)
    return np.clip(np.round(out), 0, 255).astype(np.uint8).reshape(height, w)


def _cubic(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0.0))


def warp_pages(pages: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, w, h, pixels) of pages with a map (page_id, w, h, pixels, map array<double>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [warp(_image(r.w, r.h, r.pixels), np.array(r.map).reshape(3, 3), width, height).tobytes() for r in batch.itertuples()]
            yield pd.DataFrame({"page_id": batch["page_id"], "w": width, "h": height, "pixels": made})

    return pages.mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, {IMAGE}")
