"""Ordered folds: operators whose state depends on what they have kept so far, as plain functions over one document or page.

docspark.plans.folds runs them over all documents, one group of bounded size at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np

# Fixed values of the original behaviour.
SPACE_RATIO, CELL_GAP, BASELINE_RATIO = 0.14, 22.0, 0.5
LINE_GAP_RATIO, FONT_TOLERANCE, CODE_FONT_RATIO = 1.6, 0.18, 0.86
PROTECTED = [
    r"\$[^$\n]+\$",
    r"(?:https?://|www\.)\S+",
    r"\([A-Z][A-Za-z.'’-]*(?:,?\s*\d{4}[a-z]?(?:,?\s*pp?\.?\s*\d+(?:[-–]\d+)?)?)\)",
    r"(?:Figure|Fig\.|Plate|Table|Scheme)\s+\d+(?:\.\d+)?",
    r"pp?\.\s*\d+(?:\s*[-–]\d+)?",
    r"\[[^\]\n]*\]",
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NUMBERED_ITEM = re.compile(r"^\s*(?:\(\d+(?:\.\d+)*\)|\d+(?:\.\d+)*[.)]\s+|[a-zA-Z][.)]\s+)")
BULLET_ITEM = re.compile(r"^\s*[•●▪◦■*\-–—―·]\s*")
SECTION = re.compile(r"^\d+(?:\.\d+)+\s*[A-Z]")
FIRST_SPACING, TITLE_SIZE, TITLE_CHARS = 1.5, 15, 40
FIRST_CODE_SYMBOL, MONO_FONT = re.compile(r"[{};=()\[\]<>]|=>|::|//"), re.compile(r"Courier|Consolas|Menlo|Monaco|monospace|Code\d*$", re.I)
BATCH_LINE = re.compile(r"^\s*(\d+)\s*[.、)．]\s*(.*)$")


def join_fragments(fragments: Iterable[tuple[str, float, float]], font_size: float) -> str:
    """Text of (text, x, width) fragments on a baseline; a space only where glyphs are apart."""
    out, reach = [], None
    for text, x, width in sorted(fragments, key=lambda f: f[1]):
        word = " ".join(text.split())
        if not word:
            reach = reach if reach is None else max(reach, x + width)
            continue
        if out and x - reach > SPACE_RATIO * font_size:
            out.append(" ")
        out.append(word)
        reach = x + width
    return "".join(out)


def cells(fragments: Iterable[tuple[str, float, float]], font_size: float, gap: float = CELL_GAP) -> list[tuple[str, float]]:
    """(text, x) of the runs of fragments that gaps over `gap` part."""
    runs: list[list[tuple[str, float, float]]] = []
    reach = None
    for f in sorted(fragments, key=lambda f: f[1]):
        if reach is None or f[1] - reach > gap:
            runs.append([])
        runs[-1].append(f)
        reach = f[1] + f[2]
    return [(join_fragments(run, font_size), run[0][1]) for run in runs]


def baselines(items: Sequence[tuple[float, float, float]], ratio: float = BASELINE_RATIO) -> list[int]:
    """The line number of each (y, x, size) item: a line takes what lies near the y of its first item."""
    lines, out, first = -1, [0] * len(items), None
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1])):
        y, _, size = items[i]
        if first is None or abs(y - first[0]) >= ratio * first[1]:
            lines, first = lines + 1, (y, size)
        out[i] = lines
    return out


def cluster(xs: Iterable[float], gap: float) -> list[float]:
    """Means of the clusters of sorted values; a cluster reaches `gap` from its first member."""
    groups: list[list[float]] = []
    for x in sorted(xs):
        if groups and x - groups[-1][0] <= gap:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def paragraphs(lines: Iterable[tuple[str, float, float, int, int]], body_size: float) -> list[dict]:
    """Paragraphs of (text, size, y, page, column) lines in order: members by place, with running mean size."""
    out: list[dict] = []
    last_y, bullet = 0.0, False
    for at, (text, size, y, page, column) in enumerate(lines):
        if re.fullmatch(r"\s*[•●▪◦■*\-–—―·]+\s*", text):
            bullet = True
            continue
        text, bullet = ("• " + text if bullet else text), False
        now = out[-1] if out else None
        joins = (
            now is not None
            and (page, column) == (now["page"], now["column"])
            and min(size, now["size"]) > body_size * CODE_FONT_RATIO
            and not NUMBERED_ITEM.match(text)
            and not BULLET_ITEM.match(text)
            and not SECTION.match(text.strip())
            and last_y - y <= now["size"] * LINE_GAP_RATIO
            and min(size, now["size"]) / max(size, now["size"]) > 1 - FONT_TOLERANCE
        )
        if joins:
            now["texts"].append(text)
            now["size"] = (now["size"] + size) / 2
        else:
            out.append({"texts": [text], "size": size, "page": page, "column": column, "top_y": y, "first": at})
        last_y = y
    return out


def first_paragraphs(lines: Iterable[tuple[str, float, str, float]]) -> list[tuple[str, str]]:
    """(type, text) of the paragraphs of (text, size, font, y) lines of a page, by the first rules: title, code or body."""
    out: list[dict] = []
    for text, size, font, y in lines:
        now = out[-1] if out else None
        if now and now["y"] - y <= size * FIRST_SPACING and min(size, now["size"]) / max(size, now["size"]) > 1 - FONT_TOLERANCE:
            now["texts"].append(text)
            now["size"], now["y"] = max(size, now["size"]), y
        else:
            out.append({"texts": [text], "size": size, "font": font, "y": y})
    found = []
    for p in out:
        text = " ".join(p["texts"]).strip()
        dense = len(text) > 40 and len(FIRST_CODE_SYMBOL.findall(text)) > len(text) / 20
        kind = "title" if p["size"] >= TITLE_SIZE and 0 < len(text) <= TITLE_CHARS else "code" if MONO_FONT.search(p["font"]) or dense else "body"
        found.append((kind, text))
    return found


def case_paragraphs(spans: Iterable[tuple[str, float, float, float]]) -> list[tuple[str, int, float]]:
    """(text, lines, size) of the paragraphs of (text, y, x, size) spans of a page, for benchmark cases."""
    lines: list[list[tuple[str, float, float, float]]] = []
    for s in spans:
        if not s[0].strip():
            continue
        for line in lines:
            if abs(line[0][1] - s[1]) < 2:
                line.append(s)
                break
        else:
            lines.append([s])
    out: list[tuple[list[str], float]] = []
    before = None
    for line in sorted(lines, key=lambda x: -x[0][1]):
        y, parts = line[0][1], sorted(line, key=lambda s: s[2])
        text, size = "".join(s[0] for s in parts).strip(), parts[0][3]
        if out and before - y <= 16 and abs(size - out[-1][1]) <= 2:
            out[-1][0].append(text)
        else:
            out.append(([text], size))
        before = y
    return [(" ".join(" ".join(texts).split()), len(texts), size) for texts, size in out]


def rejoin(paras: Iterable[tuple[str, int]], most: int = 4000) -> list[tuple[str, int]]:
    """(text, page) paragraphs, those joined that a line end had split within a sentence."""
    out: list[tuple[str, int]] = []
    for text, page in paras:
        if out and out[-1][1] == page:
            before = out[-1][0].strip()
            if re.search(r"[A-Za-z0-9,;:)\]}]$", before) and re.match(r"[a-z0-9(\"'“\[]", text.strip()) and len(out[-1][0]) + len(text) < most:
                out[-1] = (f"{before} {text.strip()}", page)
                continue
        out.append((text, page))
    return out


def suppress(rects: Sequence[tuple[float, float, float, float, float]], limit: float = 0.5) -> list[int]:
    """Places of the (x, y, w, h, area) rectangles to keep: larger areas first, none that overlaps a kept one."""
    kept: list[int] = []
    for i in sorted(range(len(rects)), key=lambda i: -rects[i][4]):
        x, y, w, h, _ = rects[i]
        for k in kept:
            a, b, c, d, _ = rects[k]
            inter = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            union = w * h + c * d - inter
            if union > 0 and inter / union >= limit:
                break
        else:
            kept.append(i)
    return sorted(kept)


def merge_boxes(boxes: Iterable[tuple[float, float, float, float]], gap: float = 6.0) -> list[tuple[float, float, float, float]]:
    """Boxes (x0, y0, x1, y1) grown together until none is within `gap` of another."""
    todo, done = list(boxes), []
    while todo:
        x0, y0, x1, y1 = todo.pop()
        near = [b for b in todo + done if b[0] <= x1 + gap and x0 <= b[2] + gap and b[1] <= y1 + gap and y0 <= b[3] + gap]
        if near:
            todo, done = [b for b in todo if b not in near], [b for b in done if b not in near]
            todo.append((min(x0, *(b[0] for b in near)), min(y0, *(b[1] for b in near)), max(x1, *(b[2] for b in near)), max(y1, *(b[3] for b in near))))
        else:
            done.append((x0, y0, x1, y1))
    return sorted(done)


def placements(ops: Iterable[tuple[str, Sequence[float] | str]]) -> list[tuple[str, float, float, float, float]]:
    """(name, x, y, w, h) of each paint, after save, restore and transform operations."""
    matrix, stack, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
    for kind, value in ops:
        if kind == "save":
            stack.append(matrix)
        elif kind == "restore":
            matrix = stack.pop() if stack else matrix
        elif kind == "transform":
            a, b, c, d, e, f = value
            p, q, r, s, u, v = matrix
            matrix = (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + u, e * q + f * s + v)
        elif kind == "paint":
            a, b, c, d, e, f = matrix
            xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
            out.append((value, min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
    return out


def freeze(text: str) -> tuple[str, dict[str, str]]:
    """text with protected spans as tokens, and what each stands for. The earliest span goes first; ties go to the first pattern."""
    kept: dict[str, str] = {}
    patterns = [re.compile(p) for p in PROTECTED]
    for letter in LETTERS[: len(text)]:
        found = [m for m in (p.search(text) for p in patterns) if m]
        if not found:
            break
        m = min(found, key=lambda m: m.start())
        kept[f"§{letter}§"] = m[0]
        text = f"{text[: m.start()]}§{letter}§{text[m.end() :]}"
    return text, kept


def restore(text: str, kept: dict[str, str]) -> str:
    return re.sub("§[A-Z]§", lambda m: kept.get(m[0], m[0]), text)


def split_batch(out: str, n: int) -> list[str] | None:
    """The n parts of a numbered answer, none empty; else None. Repeated or foreign numbers continue the part before."""
    parts: dict[int, list[str]] = {}
    last = None
    for line in out.split("\n"):
        m = BATCH_LINE.match(line)
        if m and 1 <= int(m[1]) <= n and int(m[1]) not in parts:
            last = int(m[1])
            parts[last] = [m[2].strip()]
        elif m:
            if last is not None and m[2].strip():
                parts[last].append(m[2].strip())
            else:
                last = None
        elif last is not None and line.strip():
            parts[last].append(line.strip())
    whole = [" ".join(parts.get(k, [])).strip() for k in range(1, n + 1)]
    return whole if all(whole) else None


def wrap(atoms: Iterable[tuple[str, bool]], size: float, width: float) -> list[str]:
    """Lines of (text, space after) atoms; a wide character counts 1, others 0.5 of the size. A newline atom ends a line."""
    lines, line, used, space = [], "", 0.0, False
    for text, after in atoms:
        if text == "\n":
            lines.append(line)
            line, used, space = "", 0.0, False
            continue
        need = sum(size if ord(c) >= 0x2E80 else size / 2 for c in text)
        gap = size / 2 if space and line else 0.0
        if line and used + gap + need > width:
            lines.append(line)
            line, used, gap = "", 0.0, 0.0
        line += (" " if gap else "") + text
        used, space = used + gap + need, after
    return [*lines, line] if line else lines


def paginate(heights: Iterable[float], page: float) -> list[int]:
    """The page (from 0) of each block: a block that would cross the end starts a new page."""
    at, used, out = 0, 0.0, []
    for h in heights:
        if used and used + h > page:
            at, used = at + 1, 0.0
        used += h
        out.append(at)
    return out


def eta(progress: Iterable[tuple[float, float]], keep: float = 0.7) -> list[float | None]:
    """Seconds left after each (seconds, percent), from a running mean of seconds per percent; None where it isn't shown."""
    mean, last, out = None, None, []
    for now, percent in progress:
        if last is not None and percent > last[1]:
            rate = (now - last[0]) / (percent - last[1])
            mean = rate if mean is None else keep * mean + (1 - keep) * rate
        elif last is not None:
            mean = None
        last = (now, percent)
        out.append(mean * (100 - percent) if mean is not None and 5 < percent < 100 else None)
    return out


def best_chain(edges: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The heaviest chain of (i, j, weight) edges in which both i and j grow. Prefix maxima over j make it n log n."""
    order = sorted(edges, key=lambda e: (e[0], e[1]))
    ranks = {j: k + 1 for k, j in enumerate(sorted({e[1] for e in order}))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)
    best, before = [0.0] * len(order), [-1] * len(order)
    k = 0
    while k < len(order):
        end = k
        while end < len(order) and order[end][0] == order[k][0]:
            at, found = ranks[order[end][1]] - 1, (0.0, -1)
            while at > 0:
                found = max(found, tree[at], key=lambda x: x[0])
                at -= at & -at
            best[end], before[end] = found[0] + order[end][2], found[1]
            end += 1
        for e in range(k, end):  # edges of one i don't follow each other
            at = ranks[order[e][1]]
            while at <= len(ranks):
                if best[e] > tree[at][0]:
                    tree[at] = (best[e], e)
                at += at & -at
        k = end
    out, e = [], max(range(len(order)), key=lambda e: best[e]) if order else -1
    while e >= 0:
        out.append(order[e])
        e = before[e]
    return out[::-1]


def align(similarity: np.ndarray, gap: float = -0.2, least: float = 0.55) -> list[tuple[int, int, float]]:
    """Monotone alignment by dynamic programming; matches under `least` are left out of the result."""
    n, m = similarity.shape
    score, move = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), dtype=np.int8)
    score[:, 0], score[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    move[1:, 0], move[0, 1:] = 1, 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (score[i - 1, j] + gap, score[i, j - 1] + gap, score[i - 1, j - 1] + similarity[i - 1, j - 1])
            k = int(np.argmax(options))
            score[i, j], move[i, j] = options[k], k + 1
    out, i, j = [], n, m
    while i or j:
        if move[i, j] == 3:
            i, j = i - 1, j - 1
            if similarity[i, j] >= least:
                out.append((i, j, float(similarity[i, j])))
        elif move[i, j] == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def notices(messages: Iterable[str], keep: int = 5) -> list[str]:
    """The last distinct messages, each at its first place."""
    return list(dict.fromkeys(messages))[-keep:]


def ink_percent(pixels: np.ndarray, dark: float = 160.0) -> float:
    """Share of pixels (height x width x channels) whose mean colour is dark; too small a box counts as full."""
    if pixels.shape[0] < 2 or pixels.shape[1] < 2:
        return 100.0
    return float(np.mean(pixels[..., :3].mean(axis=2) < dark) * 100)


def png_of_flate(data: bytes, width: int, height: int) -> bytes | None:
    """A PNG of a deflated stream of 8-bit RGB rows; None if the stream has another size."""
    try:
        raw = zlib.decompress(data)
    except zlib.error:
        return None
    if width < 1 or height < 1 or len(raw) != width * height * 3:
        return None
    rows = b"".join(b"\0" + raw[i : i + width * 3] for i in range(0, len(raw), width * 3))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


Fold = Callable
