"""A parser for files.read_items: text items and images of plain PDF files, without a library.

It reads objects, object streams and Flate streams, walks the page tree, and replays the text and image operators of each
page's content and forms. Texts are decoded by a font's ToUnicode map, else as Windows Latin; encryption, other filters and
glyph widths of a font program are not read: a width is that of the font's Widths, else half the size for a character.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEPTH = 12


class Ref(int):
    """The number of an object."""


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, u, v = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + u, e * q + f * s + v)


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    unescape = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", unescape, token[1:-1], flags=re.S)


def values(data: bytes) -> Iterator[object]:
    """The values and words of a content stream or object, arrays and dictionaries as lists and dicts."""
    stack: list[list] = [[]]
    marks: list[bytes] = []
    for m in TOKEN.finditer(data):
        token, value = m[0], None
        if token[:1] == b"%":
            continue
        if token in (b"<<", b"["):
            stack.append([])
            marks.append(token)
            continue
        if token in (b">>", b"]"):
            if not marks:
                continue
            items = stack.pop()
            value = items if marks.pop() == b"[" else dict(zip(items[::2], items[1::2], strict=False))
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))
        elif token[:1] in b"(<":
            value = _string(token)
        else:
            try:
                value = float(token) if b"." in token else int(token)
            except ValueError:
                value = Word(token.decode("latin-1"))
                if value == "R" and len(stack[-1]) > 1 and all(isinstance(x, int) for x in stack[-1][-2:]):
                    number = stack[-1][-2]
                    del stack[-1][-2:]
                    value = Ref(number)
        if len(stack) == 1 and not (isinstance(value, Word) or isinstance(value, (dict, list))):
            stack[0].append(value)
        elif len(stack) == 1:
            yield from stack[0]
            stack[0].clear()
            yield value
        else:
            stack[-1].append(value)
    yield from stack[0]


class Document:
    """The objects of a PDF by number, each read once."""

    def __init__(self, data: bytes):
        self.data, self.at, self.read = data, {}, {}
        for m in OBJECT.finditer(data):  # of a number that occurs again the last counts
            self.at[int(m[1])] = m.end()
        for number in list(self.at):
            value = self.object(number)
            if isinstance(value, tuple) and value[0].get("Type") == "ObjStm":
                self._unpack(value)

    def _unpack(self, stream: tuple) -> None:
        head, body = stream[0], self.content(stream)
        pairs = [int(x) for x in body[: self.get(head["First"])].split()]
        for k, (number, start) in enumerate(zip(pairs[::2], pairs[1::2], strict=False)):
            end = pairs[2 * k + 3] if 2 * k + 3 < len(pairs) else len(body)
            if number not in self.at:
                found = list(values(body[head["First"] + start : head["First"] + end]))
                self.read[number] = found[0] if found else None

    def object(self, number: int) -> object:
        """A value, or (dict, raw bytes) of a stream."""
        if number not in self.read:
            self.read[number] = None
            at = self.at.get(number)
            if at is not None:
                end = self.data.find(b"endobj", at)
                start = self.data.find(b"stream", at, end if end >= 0 else len(self.data))
                found = list(values(self.data[at : start if start >= 0 else end]))
                value = found[0] if found else None
                if start >= 0 and isinstance(value, dict):
                    begin = start + 6 + (2 if self.data[start + 6 : start + 8] == b"\r\n" else 1)
                    size = self.get(value.get("Length"))
                    if not isinstance(size, int) or self.data[begin + size : begin + size + 20].lstrip()[:9] != b"endstream":
                        size = self.data.find(b"endstream", begin) - begin
                    value = (value, self.data[begin : begin + size])
                self.read[number] = value
        return self.read[number]

    def get(self, value: object) -> object:
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                break
            value = self.object(value)
        return value

    def content(self, stream: object) -> bytes:
        head, raw = stream
        filters = self.get(head.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode":
                return b""
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit."""
        roots = [v for v in map(self.object, self.at) if isinstance(v, dict) and v.get("Type") == "Catalog"] + [v for v in self.read.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(node: object, given: dict, depth: int) -> None:
            node = self.get(node)
            if isinstance(node, dict) and depth < 4 * DEPTH:
                given = given | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
                if "Kids" in node:
                    for kid in self.get(node["Kids"]):
                        walk(kid, given, depth + 1)
                else:
                    out.append(given | node)

        if roots:
            walk(roots[-1].get("Pages"), {}, 0)
        return out


def _unicode_map(data: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        codes = [_string(x) for x in re.findall(rb"<[0-9A-Fa-f\s]*>", block)]
        out |= {a: text(b) for a, b in zip(codes[::2], codes[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, first in re.findall(rb"(<[0-9A-Fa-f]+>)\s*(<[0-9A-Fa-f]+>)\s*(<[0-9A-Fa-f]+>)", block):
            a, b, c = _string(low), _string(high), _string(first)
            start = int.from_bytes(a, "big")
            for code in range(start, min(int.from_bytes(b, "big"), start + 0xFFFF) + 1):
                out[code.to_bytes(len(a), "big")] = text(c[:-2] + ((int.from_bytes(c[-2:], "big") + code - start) & 0xFFFF).to_bytes(2, "big"))
    return out


class Font:
    def __init__(self, doc: Document, spec: dict):
        self.name = str(doc.get(spec.get("BaseFont")) or "")
        to_unicode = doc.get(spec.get("ToUnicode"))
        self.map = _unicode_map(doc.content(to_unicode)) if isinstance(to_unicode, tuple) else {}
        self.bytes = 2 if spec.get("Subtype") == "Type0" else 1
        self.unicode = str(doc.get(spec.get("Encoding")) or "").endswith(("UCS2-H", "UTF16-H"))  # codes are characters
        self.first, self.widths = doc.get(spec.get("FirstChar")) or 0, [doc.get(x) for x in doc.get(spec.get("Widths")) or []]

    def decode(self, raw: bytes) -> str:
        if self.unicode and not self.map:
            return raw.decode("utf-16-be", "replace")
        codes = [raw[i : i + self.bytes] for i in range(0, len(raw), self.bytes)]
        return "".join(self.map.get(c, c.decode("cp1252", "replace") if self.bytes == 1 else "") for c in codes)

    def width(self, raw: bytes) -> float:
        """In units of the size."""
        total = 0.0
        for i in range(0, len(raw), self.bytes):
            k = int.from_bytes(raw[i : i + self.bytes], "big") - self.first
            total += self.widths[k] / 1000 if self.bytes == 1 and 0 <= k < len(self.widths) and isinstance(self.widths[k], (int, float)) else 0.5
        return total


class Page:
    """What a page shows: items (text, x, y, width, size, font) and images (name, matrix, stream)."""

    def __init__(self, doc: Document, page: dict):
        self.doc, self.items, self.images = doc, [], []
        parts = doc.get(page.get("Contents"))
        streams = [doc.get(x) for x in parts] if isinstance(parts, list) else [parts]
        body = b"\n".join(doc.content(x) for x in streams if isinstance(x, tuple))
        self.run(body, doc.get(page.get("Resources")) or {}, IDENTITY, 0)

    def show(self, raw: bytes) -> None:
        if self.font is None:
            return
        place = times(self.text, self.matrix)
        width = self.font.width(raw) * self.size
        size = abs(self.size * (place[3] or place[1]))
        self.items.append((self.font.decode(raw), place[4], place[5], width * abs(place[0] or place[1]), size, self.font.name))
        self.text = times((1, 0, 0, 1, width, 0), self.text)

    def run(self, body: bytes, resources: dict, matrix: Matrix, depth: int) -> None:
        fonts = {k: self.doc.get(v) for k, v in (self.doc.get(resources.get("Font")) or {}).items()}
        objects = self.doc.get(resources.get("XObject")) or {}
        made: dict[str, Font] = {}
        stack, args = [], []
        self.matrix, self.text, self.line, self.font, self.size, self.leading = matrix, IDENTITY, IDENTITY, None, 0.0, 0.0
        for value in values(body):
            if not isinstance(value, Word):
                args.append(value)
                continue
            numbers = [x for x in args if isinstance(x, (int, float))]
            try:
                self.step(str(value), args, numbers, stack, fonts, made, objects, resources, depth)
            except (IndexError, TypeError, ValueError, KeyError):
                pass  # an operator with wrong operands is passed over
            args = []

    def step(self, op, args, numbers, stack, fonts, made, objects, resources, depth) -> None:
        if op == "q":
            stack.append((self.matrix, self.font, self.size, self.leading))
        elif op == "Q" and stack:
            self.matrix, self.font, self.size, self.leading = stack.pop()
        elif op == "cm":
            self.matrix = times(tuple(numbers[-6:]), self.matrix)
        elif op == "BT":
            self.text = self.line = IDENTITY
        elif op == "Tf":
            name = args[-2]
            if name not in made and isinstance(fonts.get(name), dict):
                made[name] = Font(self.doc, fonts[name])
            self.font, self.size = made.get(name), float(args[-1])
        elif op == "TL":
            self.leading = float(args[-1])
        elif op in ("Td", "TD"):
            if op == "TD":
                self.leading = -float(args[-1])
            self.text = self.line = times((1, 0, 0, 1, args[-2], args[-1]), self.line)
        elif op == "Tm":
            self.text = self.line = tuple(numbers[-6:])
        elif op in ("T*", "'", '"'):
            self.text = self.line = times((1, 0, 0, 1, 0, -self.leading), self.line)
            if op != "T*":
                self.show(args[-1])
        elif op == "Tj":
            self.show(args[-1])
        elif op == "TJ":
            for part in args[-1]:
                if isinstance(part, bytes):
                    self.show(part)
                else:
                    self.text = times((1, 0, 0, 1, -part / 1000 * self.size, 0), self.text)
        elif op == "Do":
            found = self.doc.get(objects.get(args[-1]))
            if isinstance(found, tuple) and found[0].get("Subtype") == "Image":
                self.images.append((str(args[-1]), self.matrix, found))
            elif isinstance(found, tuple) and found[0].get("Subtype") == "Form" and depth < DEPTH:
                kept = (self.matrix, self.text, self.line, self.font, self.size, self.leading)
                inner = tuple(float(x) for x in self.doc.get(found[0].get("Matrix")) or IDENTITY)
                self.run(self.doc.content(found), self.doc.get(found[0].get("Resources")) or resources, times(inner, self.matrix), depth + 1)
                self.matrix, self.text, self.line, self.font, self.size, self.leading = kept


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of files.ITEM: page, seq, text, x, y, width, font size, font name."""
    doc = Document(data)
    for k, page in enumerate(doc.pages()):
        for seq, (text, x, y, width, size, font) in enumerate(Page(doc, page).items):
            yield k + 1, seq, text, x, y, width, size, font


def images(data: bytes) -> Iterator[tuple]:
    """Embedded images as page, name, x, y, w, h, kind, bytes: JPEG as it is, 8-bit RGB as PNG; others are left out.

    An image that a page shows again is given once, where it is shown first.
    """
    from docspark.operators.folds import png_of_flate

    doc = Document(data)
    for k, page in enumerate(doc.pages()):
        seen = set()
        for name, (a, b, c, d, e, f), (head, raw) in Page(doc, page).images:
            if name in seen:
                continue
            seen.add(name)
            kind, content = None, None
            if head.get("Filter") == "DCTDecode":
                kind, content = "jpeg", raw
            elif head.get("Filter") == "FlateDecode" and head.get("ColorSpace") == "DeviceRGB" and head.get("BitsPerComponent") == 8 and "DecodeParms" not in head:
                kind, content = "png", png_of_flate(raw, head.get("Width", 0), head.get("Height", 0))
            if content:
                xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
                yield k + 1, name, min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), kind, content
