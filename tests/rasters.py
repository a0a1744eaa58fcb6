"""Small rasters and a naive NumPy model, for tests only."""

from __future__ import annotations

import numpy as np

BPP = {"Gray8": 1, "Rgb8": 3, "Rgba8": 4}


def lcg_bytes(count: int, state: int = 12345) -> list[int]:
    out = []
    for _ in range(count):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(state >> 24)
    return out


def lcg(width: int, height: int, fmt: str, state: int = 12345) -> np.ndarray:
    bpp = BPP[fmt]
    return np.array(lcg_bytes(width * height * bpp, state), dtype=np.int64).reshape(height, width, bpp)


def to_df(spark, pages: dict[int, np.ndarray]):
    rows = []
    for page_id, a in pages.items():
        h, w, bpp = a.shape
        rows += [(page_id, w, h, bpp, y, [int(v) for v in a[y].reshape(-1)]) for y in range(h)]
    return spark.createDataFrame(rows, "page_id bigint, width int, height int, bpp int, y int, row array<int>")


def to_arrays(df) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    rows = sorted(df.collect(), key=lambda r: (r["page_id"], r["y"]))
    for page_id in sorted({r["page_id"] for r in rows}):
        mine = [r for r in rows if r["page_id"] == page_id]
        w, h, bpp = mine[0]["width"], mine[0]["height"], mine[0]["bpp"]
        assert [r["y"] for r in mine] == list(range(h))
        out[page_id] = np.array([r["row"] for r in mine], dtype=np.int64).reshape(h, w, bpp)
    return out


def half_away(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def byte(x):
    return np.clip(half_away(x), 0, 255).astype(np.int64)


def edge(a: np.ndarray, y: int, x: int) -> np.ndarray:
    h, w, _ = a.shape
    return a[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]


def median(a: np.ndarray, r: int) -> np.ndarray:
    out = np.empty_like(a)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            box = np.array([edge(a, y + dy, x + dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)])
            out[y, x] = np.sort(box, axis=0)[len(box) // 2]
    return out


def blur(a: np.ndarray, r: int) -> np.ndarray:
    h, w, _ = a.shape
    across = np.array([[a[y, max(0, x - r) : x + r + 1].sum(axis=0) // len(a[y, max(0, x - r) : x + r + 1]) for x in range(w)] for y in range(h)])
    return np.array([[across[max(0, y - r) : y + r + 1, x].sum(axis=0) // len(across[max(0, y - r) : y + r + 1, x]) for x in range(w)] for y in range(h)])


def sharpen(a: np.ndarray, amount: float) -> np.ndarray:
    h, w, _ = a.shape
    if h < 3 or w < 3:
        return a
    out = np.empty_like(a)
    for y in range(h):
        for x in range(w):
            around = edge(a, y, x - 1) + edge(a, y, x + 1) + edge(a, y - 1, x) + edge(a, y + 1, x)
            out[y, x] = byte((1 + amount) * a[y, x] - amount / 4 * around)
    return out


def components(ink: np.ndarray) -> set[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of glyph-sized 4-connected ink, by flood fill."""
    h, w = ink.shape
    seen = np.zeros_like(ink, dtype=bool)
    out = []
    for y in range(h):
        for x in range(w):
            if not ink[y, x] or seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                cy, cx = todo.pop()
                cells.append((cy, cx))
                for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                    if 0 <= ny < h and 0 <= nx < w and ink[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        todo.append((ny, nx))
            ys, xs = [c[0] for c in cells], [c[1] for c in cells]
            box = (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
            if 3 <= box[3] - box[1] <= max(3, h // 2) and 1 <= box[2] - box[0] <= max(1, w * 2 // 5):
                out.append(box)
    return set(out)
