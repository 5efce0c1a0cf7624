"""A small chart renderer: bar, line, pie and Gantt charts as PNG, with numpy and zlib only. Charts are bounded (100 rows), so one is drawn from one row."""

from __future__ import annotations

import datetime
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Dots for each inch, width and height in inches, colours.
DPI, WIDTH, HEIGHT = 180, 10.0, 6.0
COLOURS = np.array([(31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189), (140, 86, 75)], np.uint8)
INK, GRID, AXIS = 40, 225, 60
#: A picture is made of numbers of these colours, two to a byte in its file.
PALETTE = np.array([(255, 255, 255), *COLOURS.tolist(), (INK,) * 3, (GRID,) * 3, (AXIS,) * 3], np.uint8)
FIRST, INKED, GRIDDED, AXES = 1, 7, 8, 9
#: Letters of 14 strokes: each stroke joins two points of a grid of three by three (column, row).
STROKES = {
    "a": ((0, 0), (2, 0)), "b": ((2, 0), (2, 1)), "c": ((2, 1), (2, 2)), "d": ((0, 2), (2, 2)), "e": ((0, 1), (0, 2)), "f": ((0, 0), (0, 1)), "g": ((0, 1), (1, 1)), "h": ((1, 1), (2, 1)),
    "i": ((0, 0), (1, 1)), "j": ((1, 0), (1, 1)), "k": ((2, 0), (1, 1)), "l": ((1, 1), (0, 2)), "m": ((1, 1), (1, 2)), "n": ((1, 1), (2, 2)), "o": ((0, 2), (0, 2)),
}
LETTERS = dict(
    zip(
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ -+/.,:%()_='!?&#",
        "abcdefkl bck abdegh abcdh bcfgh acdfgh acdefgh abc abcdefgh abcdfgh abcefgh abcdhjm adef abcdjm adefgh aefgh acdefh bcefgh adjm bcde efgkn def bcefik bcefin abcdef abefgh abcdefn abefghn acdfgh ajm bcdef efkl bcefln ikln ikm adkl _ gh ghjm kl o l jm fckl kn il d dgh j jo abho acdein ghdjm".split(),
        strict=True,
    )
)


def encode(cells: np.ndarray) -> bytes:
    """A picture of numbers of ``PALETTE`` as PNG."""
    h, w = cells.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    new = np.ones(h, bool)  # most lines are as the one above: these are packed once
    new[1:] = (cells[1:] != cells[:-1]).any(axis=1)
    lines = cells[new]
    rows = np.zeros((len(lines), 1 + (w + 1) // 2), np.uint8)
    rows[:, 1:] = lines[:, ::2] << 4
    rows[:, 1 : 1 + w // 2] |= lines[:, 1::2]
    rows = rows[np.cumsum(new) - 1]
    per_metre = round(DPI / 0.0254)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 4, 3, 0, 0, 0)) + chunk(b"PLTE", PALETTE.tobytes()) + chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


@lru_cache(1024)
def _glyph(letter: str, size: int) -> np.ndarray:
    wide, thick = size // 2, max(2, size // 9)
    out = np.zeros((size + thick, wide + thick + size // 4), bool)
    for stroke in LETTERS.get(letter, "abcdef").strip("_"):
        (x0, y0), (x1, y1) = STROKES[stroke]
        for t in np.linspace(0, 1, 2 * size):
            x, y = int((x0 + (x1 - x0) * t) * wide / 2), int((y0 + (y1 - y0) * t) * size / 2)
            out[y : y + thick, x : x + thick] = True
    return out


def lettering(text: str, size: int) -> np.ndarray:
    """The marks of a text ``size`` dots high. Letters are capitals without accents; others are boxes."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()
    return np.concatenate([_glyph(c, size) for c in plain], axis=1) if plain else np.zeros((size + max(2, size // 9), 1), bool)


@dataclass
class Label:
    """A text whose middle lies at (x, y); ``upright``: it reads from below."""

    text: str
    x: int
    y: int
    size: int = 24
    upright: bool = False

    def mask(self) -> np.ndarray:
        m = lettering(self.text, self.size)
        return np.rot90(m) if self.upright else m


class Canvas:
    def __init__(self, height: float, axes: bool = True):
        self.h, self.w = int(height * DPI), int(WIDTH * DPI)
        self.cells = np.zeros((self.h, self.w), np.uint8)
        self.left, self.right, self.top, self.bottom = self.w // 7, self.w - self.w // 20, self.h // 9, self.h - self.h // 5
        self.labels: list[Label] = []
        if axes:
            self.cells[self.top : self.bottom, self.left - 3 : self.left] = AXES
            self.cells[self.bottom : self.bottom + 3, self.left : self.right] = AXES

    @property
    def image(self) -> np.ndarray:
        """The picture in red, green and blue."""
        return PALETTE[self.cells]

    def write(self, text: str | None, x: int, y: int, size: int = 24, upright: bool = False, room: int = 0) -> None:
        """A text about a point, cut to ``room`` dots."""
        if not text:
            return
        text = text.strip()
        if room and len(text) * size * 0.9 > room:
            text = text[: max(1, int(room / (size * 0.9)) - 2)] + ".."
        label = Label(text, x, y, size, upright)
        m = label.mask()
        y0, x0 = max(0, y - m.shape[0] // 2), max(0, x - m.shape[1] // 2)
        part = self.cells[y0 : y0 + m.shape[0], x0 : x0 + m.shape[1]]
        part[m[: part.shape[0], : part.shape[1]]] = INKED
        self.labels.append(label)


def number(v: float) -> str:
    return f"{v:,.0f}" if v == round(v) else f"{v:,.2f}"


def _gantt(tasks: list[tuple[str, int, int]], title: str | None) -> Canvas:
    c = Canvas(max(5.5, len(tasks) * 0.55 + 2))
    first, last = min(t[1] for t in tasks), max(t[2] for t in tasks) + 1
    step, width = (c.bottom - c.top) / len(tasks), c.right - c.left
    for d in sorted({first + (last - 1 - first) * k // 4 for k in range(5)}):
        x = int(c.left + width * (d - first) / (last - first))
        c.cells[c.top : c.bottom, x : x + 2] = GRIDDED
        c.write(datetime.date.fromordinal(d).isoformat(), x + 40, c.bottom + 40, 18)
    for i, (name, a, b) in enumerate(tasks):
        x0, x1 = (int(c.left + width * (d - first) / (last - first)) for d in (a, b + 1))
        c.cells[int(c.top + step * (i + 0.2)) : int(c.top + step * (i + 0.8)), x0 : max(x1, x0 + 1)] = FIRST
        c.write(name, c.left // 2, int(c.top + step * (i + 0.5)), 18, room=c.left - 20)
    c.write(title, c.w // 2, c.top // 2, 32, room=c.w - 100)
    c.write("Timeline", (c.left + c.right) // 2, c.h - 40)
    return c


@lru_cache(1)
def _disc(h: int, w: int) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """Middle and radius of a pie, the turn from the top on of each dot in it, and which dots these are."""
    y, x = np.mgrid[0:h, 0:w]
    cy, cx, r = int(h * 0.54), w // 2, 0.36 * h
    inside = (x - cx) ** 2 + (y - cy) ** 2 < r**2
    return cy, cx, r, np.mod(np.arctan2(cy - y[inside], x[inside] - cx) / (2 * np.pi) - 0.25, 1), inside


def _pie(names: list[str], values: np.ndarray, title: str | None) -> Canvas:
    """Slices from the top on, against the clock, each with its name and percentage."""
    c = Canvas(HEIGHT, axes=False)
    cy, cx, r, turn, inside = _disc(c.h, c.w)
    ends = np.cumsum(values) / values.sum()
    part = np.searchsorted(ends, turn, side="right").clip(0, len(values) - 1)
    c.cells[inside] = FIRST + part % len(COLOURS)
    for name, end, v in zip(names, ends, values, strict=True):
        middle = 2 * np.pi * (end - v / values.sum() / 2 + 0.25)
        place = lambda f: (int(cx + f * r * np.cos(middle)), int(cy - f * r * np.sin(middle)))  # noqa: B023, E731
        c.write(f"{100 * v / values.sum():.1f}%", *place(0.6), 20)
        c.write(name, *place(1.25), 20, room=c.w // 5)
    c.write(title, c.w // 2, c.h // 18, 32, room=c.w - 100)
    return c


def _plain(kind: str, names: list[str], values: np.ndarray, title: str | None, x_label: str | None, y_label: str | None) -> Canvas:
    c = Canvas(HEIGHT)
    low, high = min(0.0, values.min()), max(0.0, values.max())
    place = lambda v: int(c.bottom - (c.bottom - c.top) * (v - low) / ((high - low) or 1.0))
    step = (c.right - c.left) / len(values)
    centres = [int(c.left + step * (i + 0.5)) for i in range(len(values))]
    for v in np.linspace(low, high, 5):
        if kind == "Line Chart":
            c.cells[place(v) : place(v) + 2, c.left : c.right] = GRIDDED
        c.write(number(v), c.left * 2 // 3, place(v), 18, room=c.left // 2)
    if kind == "Bar Chart":
        for x, v in zip(centres, values, strict=True):
            y0, y1 = sorted((place(0.0), place(v)))
            c.cells[y0 : max(y1, y0 + 1), int(x - step * 0.4) : max(int(x + step * 0.4), int(x - step * 0.4) + 1)] = FIRST
    else:
        points = list(zip(centres, map(place, values), strict=True))
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            n = max(abs(x1 - x0), abs(y1 - y0), 1)
            for x, y in zip(np.linspace(x0, x1, n + 1).astype(int), np.linspace(y0, y1, n + 1).astype(int), strict=True):
                c.cells[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = FIRST
        for x, y in points:
            c.cells[max(0, y - 7) : y + 8, max(0, x - 7) : x + 8] = FIRST + 1
    upright = step < 120
    for x, name in zip(centres, names, strict=True):
        c.write(name, x, c.bottom + (70 if upright else 40), 18, upright, room=130 if upright else int(step))
    c.write(x_label, (c.left + c.right) // 2, c.h - 40)
    c.write(y_label, 40, (c.top + c.bottom) // 2, upright=True, room=c.bottom - c.top)
    c.write(title, c.w // 2, c.top // 2, 32, room=c.w - 100)
    return c


def draw(chart: dict) -> Canvas:
    """The picture of one validated chart, with title, names and axes."""
    if chart["tasks"] is not None:
        return _gantt([(t["task"], t["start"].toordinal(), t["end"].toordinal()) for t in chart["tasks"]], chart["title"])
    names, values = [p["category"] for p in chart["points"]], np.array([p["value"] for p in chart["points"]], float)
    if chart["chart_type"] == "Pie Chart":
        return _pie(names, values, chart["title"])
    return _plain(chart["chart_type"], names, values, chart["title"], chart["x_label"], chart["y_label"])


def chart_png(chart: dict) -> bytes:
    return encode(draw(chart).cells)
