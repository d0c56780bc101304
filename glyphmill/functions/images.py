"""Image operators in numpy, for Arrow UDFs: one image at a time, no other library.

Grey images are arrays of 0 to 255; walls, regions and masks are boolean.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the segmentation; functions take others as parameters.
MIN_AREA, WINDOW, STEP, MAX_SHARE, EXTENT, SAME_BOX = 800, 12, 3, 0.25, 0.85, 0.9
CORNER = 0.02
WEIGHTS = {"RGB": (0.299, 0.587, 0.114), "BGR": (0.114, 0.587, 0.299)}


def normalise(pixels: np.ndarray, order: str = "RGB") -> np.ndarray:
    """Grey image of dark strokes on white: alpha over white, channels weighed by their order, turned round if its corners are dark."""
    p = pixels.astype(np.float64)
    if p.ndim == 3 and p.shape[2] == 1:
        p = p[..., 0]
    if p.ndim == 3 and p.shape[2] == 4:
        alpha = p[..., 3:] / 255
        p = p[..., :3] * alpha + 255 * (1 - alpha)
    grey = p @ np.array(WEIGHTS[order]) if p.ndim == 3 else p
    corners = np.array([grey[0, 0], grey[0, -1], grey[-1, 0], grey[-1, -1]])
    grey = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return 255 - grey if np.median(corners) < 128 else grey


def otsu(grey: np.ndarray) -> int:
    """The threshold that parts the histogram best."""
    n = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = n.sum() - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(spread)))


def _shifted(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def kernel(size: int, round_: bool = False) -> list[tuple[int, int]]:
    """Offsets of a square or an ellipse."""
    r = size // 2
    grid = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    return [(y, x) for y, x in grid if abs(x) <= round(np.sqrt(max(0, r * r - y * y)))] if round_ else grid


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([_shifted(mask, y, x, False) for y, x in offsets])


def erode(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([_shifted(mask, y, x, True) for y, x in offsets])


def walls(grey: np.ndarray) -> np.ndarray:
    """Strokes below the threshold, made one pixel thicker."""
    return dilate(grey <= otsu(grey), kernel(3))


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in reading order, 0 elsewhere, by runs joined between rows."""
    h, w = mask.shape
    parent: list[int] = [0]

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros((h, w), np.int64)
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            above = {top(int(i)) for i in np.unique(out[y - 1, a:b]) if i} if y else set()
            name = min(above) if above else len(parent)
            if not above:
                parent.append(name)
            for i in above:
                parent[i] = name
            out[y, a:b] = name
    roots = np.array([top(i) for i in range(len(parent))])
    _, dense = np.unique(roots, return_inverse=True)
    return dense[out]


def seeds(x: int, y: int, h: int, w: int, window: int = WINDOW, step: int = STEP) -> list[tuple[int, int]]:
    """A grid of places around a point, the point first."""
    reach = range(-window, window + 1, step)
    return [(y, x)] + [(y + dy, x + dx) for dy in reach for dx in reach if (dy or dx) and 0 <= y + dy < h and 0 <= x + dx < w]


def region(labels: np.ndarray, x: int, y: int, min_area: int = MIN_AREA, window: int = WINDOW, step: int = STEP) -> np.ndarray | None:
    """The largest free component of ``min_area`` pixels or more around a point."""
    h, w = labels.shape
    sizes = np.bincount(labels.ravel())
    hit = list(dict.fromkeys(int(labels[p]) for p in seeds(x, y, h, w, window, step) if 0 <= p[0] < h and 0 <= p[1] < w and labels[p]))
    hit = [k for k in hit if sizes[k] >= min_area]
    return labels == max(hit, key=lambda k: sizes[k]) if hit else None


def leaks(mask: np.ndarray, max_share: float = MAX_SHARE) -> bool:
    """A region that touches an edge of the image or covers too much of it."""
    return bool(mask[0].any() or mask[-1].any() or mask[:, 0].any() or mask[:, -1].any() or mask.mean() > max_share)


def xywh(mask: np.ndarray) -> tuple[int, int, int, int]:
    ys, xs = np.nonzero(mask)
    return int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)


def filled(box: tuple[int, int, int, int], h: int, w: int) -> np.ndarray:
    """A mask of the whole box (x, y, w, h)."""
    out = np.zeros((h, w), bool)
    out[box[1] : box[1] + box[3], box[0] : box[0] + box[2]] = True
    return out


def iou_xywh(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0, w) * max(0, h)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if shared and union else 0.0


def corners(mask: np.ndarray) -> int:
    """Corners of a region's outline: rows and columns where its extents jump by more than ``CORNER`` of its size; 4 for a rectangle."""
    x, y, w, h = xywh(mask)
    part = mask[y : y + h, x : x + w]
    rows, columns = part.any(axis=1), part.any(axis=0)
    left, right = part.argmax(axis=1)[rows], w - part[:, ::-1].argmax(axis=1)[rows]
    top, bottom = part.argmax(axis=0)[columns], h - part[::-1].argmax(axis=0)[columns]
    jumps = sum(int((np.abs(np.diff(e)) > max(1, CORNER * 2 * (w + h))).sum()) for e in (left, right, top, bottom))
    return 4 + jumps


def rectangles(labels: np.ndarray, min_area: int = MIN_AREA, extent: float = EXTENT, same: float = SAME_BOX, max_share: float = MAX_SHARE) -> list[tuple[int, int, int, int]]:
    """Boxes of free components that are rectangles; near copies keep the largest.

    Components stand in for traced outlines: a region of four corners that
    fills ``extent`` of its bounding box is a rectangle.
    """
    found = []
    for k in range(1, int(labels.max()) + 1):
        mask = labels == k
        n = int(mask.sum())
        if n > min_area:
            box = xywh(mask)
            if n > extent * box[2] * box[3] and not leaks(mask, max_share) and corners(mask) == 4:
                found.append(box)
    kept: list[tuple[int, int, int, int]] = []
    for box in sorted(found, key=lambda b: -b[2] * b[3]):
        if all(iou_xywh(box, other) <= same for other in kept):
            kept.append(box)
    return kept


def reconcile(grey: np.ndarray, points: list[tuple[str, int, int]], min_area: int = MIN_AREA, max_share: float = MAX_SHARE) -> list[dict]:
    """A box and its filled mask for each point: its free region, else the smallest rectangle around it, else needs_review without either."""
    labels = label(~walls(grey))
    boxes = rectangles(labels, min_area, max_share=max_share)
    out = []
    for name, x, y in points:
        mask = region(labels, x, y, min_area)
        around = sorted((b for b in boxes if b[0] <= x < b[0] + b[2] and b[1] <= y < b[1] + b[3]), key=lambda b: b[2] * b[3])
        if mask is not None and not leaks(mask, max_share):
            box, source = xywh(mask), "flood"
        elif around:
            box, source = around[0], "contour"
        else:
            box, source = None, "needs_review"
        out.append({"id": name, "box": box, "mask": filled(box, *grey.shape) if box else None, "source": source, "iou": iou_xywh(box, around[0]) if box and around else None})
    return out


def fill(mask: np.ndarray) -> tuple[np.ndarray, bool]:
    """A mask without holes and specks, and whether opening (by a plus of three pixels) was kept: it must leave half of the closed mask."""
    round5, plus3 = kernel(5, True), kernel(3, True)
    closed = erode(dilate(mask, round5), round5)
    opened = dilate(erode(closed, plus3), plus3)
    keep = bool(closed.any()) and opened.sum() >= 0.5 * closed.sum()
    return (opened, True) if keep else (closed, False)
