"""Secret scans: rules, and a character CNN in numpy over every candidate and what surrounds it.

Batches are screened as bytes: only texts with a run of hex digits, an AKIA, a colon or equals sign, or a run of token
characters that may be a candidate are looked at further. Candidates are the rules' findings and all other such runs. The
network reads characters before, of and after a candidate; it is trained on labelled findings, its scores are calibrated
on findings that training has not seen, and its threshold is the highest at which those keep the wanted recall. Rules'
findings stay whatever it says; its word on them is told beside them.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import append_columns, fresh

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "learned")
#: What the network judges beside the rules' findings: runs of LEAST token characters or more that have a digit and a
#: letter, or small letters and a capital that is not their first, or stand after a colon or an equals sign.
LEAST = 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
GIVEN = re.compile(r"[:=][\x20\"']{0,3}$")
BEFORE, INSIDE, AFTER = 20, 44, 8
LENGTH = BEFORE + INSIDE + AFTER
SYMBOLS = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:\"'@,;()[]{}<>|\n"
DIMS, WIDTH, FILTERS = 8, 5, 24
#: Share of secrets that the threshold must keep. It is set where calibration findings lose half of what may be lost.
RECALL = 0.98
FINDINGS, SEED = 6000, 10

_HEX_BYTE = np.zeros(256, dtype=bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_DIGIT_BYTE, _UPPER_BYTE, _LOWER_BYTE = (np.array([chr(b) in x for b in range(256)]) for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

Finding = tuple[str, str, str, int]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[Finding]:
    """n findings (before, candidate, after, label), half of them secrets, made by rule from a seed."""
    r = random.Random(seed)
    syllables = ["the", "ion", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    text = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    full = lower + lower.upper() + digits
    cased = lambda: "".join(word().capitalize() for _ in range(r.randint(2, 4)))
    common = ["get", "set", "is", "has", "by", "to", "from", "of", "user", "name", "id", "value", "list", "item", "find", "all", "identity", "service", "request", "response", "handler", "factory", "manager", "count", "index", "query", "test", "string", "file", "path", "error"]
    camel = lambda: "".join(r.choice(common).capitalize() for _ in range(r.randint(3, 5)))
    secret = [
        lambda: text(full, 20, 44), lambda: text(full + "+/", 40, 60) + r.choice(["", "=", "=="]), lambda: text(digits + "ABCDEF", 24, 64), lambda: text(digits + "abcdef", 24, 64),
        lambda: text(lower, 2, 4) + r.choice("_-") + text(full, 24, 40), lambda: "A" + text(lower.upper(), 3, 3) + text(lower.upper() + digits, 16, 24), lambda: text(full + "_-", 22, 50), lambda: text(full, 12, 16),
    ]
    plain = [
        lambda: text(digits, 16, 19), lambda: word() + "-" + word() + "-" + text(digits, 1, 4) + "-" + word() + word(), lambda: word().upper() + "_" + text(digits, 8, 8) + "_" + text(digits, 6, 6),
        lambda: (word() + word() + word() + word() + word())[:30] + text(digits, 1, 3), lambda: "/".join([word(), word(), text(digits, 4, 4), text(digits, 2, 2), word(), word()]), lambda: r.choice(full) * r.randint(16, 40) + r.choice(digits),
        lambda: "/".join(word() for _ in range(r.randint(5, 14))) + "/" + text(digits, 1, 4) + "/" + "/".join(word() for _ in range(r.randint(2, 8))),
        lambda: "-" * r.randint(14, 30) + text(digits, 1, 2), lambda: "=" * r.randint(14, 30) + text(digits, 1, 2) + word(), lambda: "_".join(word() for _ in range(5)) + text(digits, 1, 2), lambda: (word() + text(digits, 1, 1)) * r.randint(4, 8),
        lambda: f"{text(digits, 4, 4)}-{text(digits, 2, 2)}-{text(digits, 2, 2)}T{text(digits, 2, 2)}", cased, lambda: cased() + text(digits, 1, 2), camel, lambda: r.choice(common) + camel(), lambda: camel() + text(digits, 1, 2), lambda: word() + cased(), lambda: "".join(word() for _ in range(6))[:28], lambda: "/".join(word() for _ in range(r.randint(3, 16))),
    ]
    named = ["key", "auth", "bearer", "credential", "private_key", "access", "client", "pwd", "Authorization"]
    out: list[Finding] = []
    for i in range(n):
        label = i % 2
        lead = words(r.randint(0, 5))
        if label and r.random() < 0.6:
            lead += f" {r.choice(named)}{r.choice([' = ', ': ', '=', ' ', ' is '])}{r.choice(['', chr(34), chr(39)])}"
        elif not label and r.random() < 0.5:
            lead += f" {word()}{r.choice([' = ', ': ', ' ', ' is ', ' | '])}"
        else:
            lead += " "
        out.append((lead, r.choice(secret if label else plain)(), r.choice(["", '"', " ", ". ", "\n", ", "]) + words(r.randint(0, 3)), label))
    return [x for x in out if len(x[1]) >= LEAST]


_CODE = {c: i + 1 for i, c in enumerate(SYMBOLS)}


def encode(findings: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each place, and whether it is inside the candidate. Of a long candidate, its head and tail are read:
    scores are of windows() of it, which are never long."""
    codes, inside = np.zeros((len(findings), LENGTH), dtype=np.int64), np.zeros((len(findings), LENGTH), dtype=np.float32)
    for i, (before, core, after, *_) in enumerate(findings):
        if len(core) > INSIDE:
            core = core[: INSIDE // 2] + core[-(INSIDE // 2) :]
        line = before[-BEFORE:].rjust(BEFORE) + core
        codes[i, : len(line)] = [_CODE.get(c, 0) for c in line]
        inside[i, BEFORE : len(line)] = 1
        for k, c in enumerate(after[: LENGTH - len(line)][:AFTER]):
            codes[i, len(line) + k] = _CODE.get(c, 0)
    return codes, inside


def windows(findings: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    """Findings whose candidates have INSIDE characters at most, and the place of the finding that each is part of.

    Of a long candidate these are overlapping windows, half a window apart, the last one at its end.
    """
    out, owner = [], []
    for i, (before, core, after, *_) in enumerate(findings):
        last = max(0, len(core) - INSIDE)
        for at in [*range(0, last, INSIDE // 2), last]:
            end = at + INSIDE
            out.append(((before + core[max(0, at - BEFORE) : at])[-BEFORE:], core[at:end], (core[end : end + AFTER] + after)[:AFTER]))
            owner.append(i)
    return out, np.array(owner, dtype=np.int64)


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over the candidate, and a logistic unit; then a Platt scale."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def layers(self, codes: np.ndarray, inside: np.ndarray):
        x = np.concatenate([self.embed[codes], inside[:, :, None]], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, -1)
        h = np.maximum(cols @ self.kernel + self.shift, 0)
        share = inside[:, WIDTH // 2 : LENGTH - WIDTH // 2, None]
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], 1)[:, 0], (h * share).sum(axis=1)], axis=1)
        return cols, h, share, top, pooled, pooled @ self.out + self.bias

    def margins(self, findings: list[tuple]) -> np.ndarray:
        """The highest margin of each finding's windows. So many findings are cut into windows at once that memory is bounded."""
        out = np.full(len(findings), -np.inf)
        lo = 0
        while lo < len(findings):
            hi, size = lo, 0
            while hi < len(findings) and (hi == lo or size + len(findings[hi][1]) <= 512 * INSIDE):
                size += len(findings[hi][1])
                hi += 1
            parts, owner = windows(findings[lo:hi])
            for i in range(0, len(parts), 512):
                np.maximum.at(out, lo + owner[i : i + 512], self.layers(*encode(parts[i : i + 512]))[-1])
            lo = hi
        return out

    def score(self, findings: list[tuple]) -> np.ndarray:
        """Calibrated probabilities; of a long candidate, that of its window with the highest."""
        if not findings:
            return np.zeros(0)
        margin = self.margins(findings)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -35, 35)))


def gradients(net: Network, codes: np.ndarray, inside: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss, by each of the network's parameters."""
    cols, h, share, top, pooled, margin = net.layers(codes, inside)
    d = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label) / len(codes)
    grads = {"out": pooled.T @ d, "bias": d.sum()}
    dh = d[:, None, None] * net.out[None, None, FILTERS:] * share
    peak = np.zeros_like(h)
    np.put_along_axis(peak, top[:, None, :], (d[:, None] * net.out[None, :FILTERS])[:, None, :], 1)
    dh = (dh + peak) * (h > 0)
    grads["shift"] = dh.sum(axis=(0, 1))
    flat = dh.reshape(-1, FILTERS)
    grads["kernel"] = cols.reshape(len(flat), -1).T @ flat
    back = (flat @ net.kernel.T).reshape(len(codes), LENGTH - WIDTH + 1, WIDTH, DIMS + 1)
    grads["embed"] = np.zeros_like(net.embed)
    for k in range(WIDTH):
        np.add.at(grads["embed"], codes[:, k : k + LENGTH - WIDTH + 1], back[:, :, k, :DIMS])
    return grads


def train(findings: list[Finding], epochs: int = 5, seed: int = SEED, recall: float = RECALL) -> Network:
    """A network of labelled findings: four fifths are learned from, one fifth calibrates the scores and the threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    cut = len(findings) * 4 // 5
    label = np.array([f[3] for f in findings], dtype=np.float32)
    # a label holds for each window, since made candidates are secrets, or plain, from end to end
    parts, owner = windows([findings[i] for i in order[:cut]])
    learned = label[order[:cut]][owner]
    codes, inside = encode(parts)
    normal = lambda *shape: (rng.standard_normal(shape) * (2 / shape[0]) ** 0.5).astype(np.float32)
    net = Network(normal(len(SYMBOLS) + 1, DIMS) * 3, normal((DIMS + 1) * WIDTH, FILTERS), np.zeros(FILTERS, dtype=np.float32), normal(2 * FILTERS), 0.0)
    names = ("embed", "kernel", "shift", "out")
    mean, square, step = {k: 0.0 for k in (*names, "bias")}, {k: 0.0 for k in (*names, "bias")}, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(parts))
        for lo in range(0, len(parts), 64):
            i = shuffled[lo : lo + 64]
            grads = gradients(net, codes[i], inside[i], learned[i])
            step += 1
            for name, g in grads.items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - 0.01 * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8))
    rest = order[cut:]
    margin, y = net.margins([findings[i] for i in rest]), label[rest]
    a, b = 1.0, 0.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        v = p * (1 - p) + 1e-9
        hess = np.array([[np.sum(v * margin * margin) + 1e-6, np.sum(v * margin)], [np.sum(v * margin), np.sum(v) + 1e-6]])
        move = np.linalg.solve(hess, np.array([np.sum((p - soft) * margin), np.sum(p - soft)]))
        a, b = a - move[0], b - move[1]
    net.scale = (float(a), float(b))
    known = np.sort(1 / (1 + np.exp(-np.clip(a * margin[y == 1] + b, -35, 35))))
    net.threshold = float(known[int(np.floor((1 - recall) / 2 * len(known)))]) if len(known) else 0.5
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the rules' findings, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _judged(text: str, a: int, b: int) -> bool:
    if b - a < LEAST:
        return False
    s = text[a:b]
    digit, upper, lower = (any(c in x for c in s) for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return (digit and (upper or lower)) or (lower and any("A" <= c <= "Z" for c in s[1:])) or bool((upper or lower) and GIVEN.search(text, max(0, a - 4), a))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs for the network to judge beside the rules' findings, or what these leave of them, in pieces as long as a run must be."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), reach)
        while k < len(spans) and spans[k][0] < m.end():
            if _judged(text, at, spans[k][0]):
                out.append((at, spans[k][0]))
            reach = max(reach, spans[k][2])
            at = max(at, reach)
            k += 1
        if _judged(text, at, m.end()):
            out.append((at, m.end()))
    return out


def _runs(raw: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(member[raw].view(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    return start[end - start >= least], end[end - start >= least]


def suspects(texts: list[bytes]) -> list[int]:
    """The texts that may have a finding or a candidate."""
    buf = b" ".join([b"", *texts, b""])
    raw = np.frombuffer(buf, dtype=np.uint8)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    start, end = _runs(raw, _TOKEN_BYTE, LEAST)
    among = lambda member, a: (lambda total: total[end] - total[a])(np.concatenate([[0], np.cumsum(member[raw], dtype=np.int64)]))
    some = (among(_DIGIT_BYTE, start) > 0) | ((among(_UPPER_BYTE, start + 1) > 0) & (among(_LOWER_BYTE, start) > 0)) if len(start) else np.zeros(0, dtype=bool)
    runs = np.concatenate([_runs(raw, _HEX_BYTE, 16)[0], start[some]])
    found = set((np.searchsorted(starts, runs, "right") - 1).tolist())
    found.update(i for i, t in enumerate(texts) if b"AKIA" in t or b"=" in t or b":" in t)
    return sorted(found)


FIELDS = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_spans", T.StringType()), ("spans", T.StringType()), ("n_confirmed", T.LongType()), ("score", T.DoubleType())]


def find(docs: DataFrame, net: Network | None = None, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the number of findings by rule, and base_spans and spans as text (kind:start:end, comma-joined).

    Starts and ends count code points, the end exclusive. The network adds spans of kind learned where no rule matches.
    n_confirmed counts the rules' findings that it takes for secrets too, and score is its highest score in the text (null
    without a candidate); of an assignment it judges the value. Returns the frame and the names of these columns, which differ only where docs has such a name. A null or empty
    text has no findings. Whole texts are scanned, however long; repeated rows are scanned each for itself.
    """
    names = {k: fresh(docs, k) for k, _ in FIELDS}
    sent = docs.sparkSession.sparkContext.broadcast(net or train(labelled_findings()))
    line = lambda spans: ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)

    def make():
        net = sent.value

        def scan(_, texts):
            counts = [[0] * len(texts) for _ in range(3)]
            base, every = [""] * len(texts), [""] * len(texts)
            confirmed, best = [0] * len(texts), [None] * len(texts)
            at, rows, spans = [], [], {}
            for i in suspects(texts):
                t = texts[i].decode()
                spans[i] = base_spans(t)
                for _, k, _ in spans[i]:
                    counts[k][i] += 1
                base[i] = line(spans[i])
                judged = [(start, end, k, ASSIGN.match(t, start).start(2) if k == 0 else start) for start, k, end in spans[i]]
                for start, end, k, value in [*judged, *((a, b, 3, a) for a, b in candidates(t, spans[i]))]:
                    at.append((i, start, end, k))
                    rows.append((t[max(0, value - BEFORE) : value], t[value:end], t[end : end + AFTER]))
            for (i, start, end, k), p in zip(at, net.score(rows).tolist(), strict=True):
                best[i] = max(p, best[i] or 0.0)
                if p >= net.threshold:
                    if k == 3:
                        spans[i].append((start, 3, end))
                    else:
                        confirmed[i] += 1
            for i, found in spans.items():
                every[i] = line(sorted(found))
            return [*counts, base, every, confirmed, best]

        return scan

    return append_columns(docs, text, [T.StructField(names[k], kind) for k, kind in FIELDS], make), names


def redact(docs: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """docs with each finding, rule's or network's, replaced by mark; n_chars follows the text where it changes.

    Of findings that overlap the first counts, and the other's rest goes with it. Null and empty texts and texts without
    findings stay as they are, no row goes, and equal texts get equal results.
    """
    out, names = find(docs)
    new = fresh(out, "clean_text")
    spans = out.columns.index(names["spans"])

    def make():
        def cut(batch, texts):
            clean = []
            for text, found in zip(texts, batch.column(spans).to_pylist(), strict=True):
                t = text.decode()
                if found:
                    pieces, at = [], 0
                    for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in found.split(",")):
                        if start >= at:
                            pieces += [t[at:start], mark]
                        at = max(at, end)
                    t = "".join([*pieces, t[at:]])
                clean.append(t)
            return [clean]

        return cut

    out = append_columns(out, "text", [T.StructField(new, T.StringType())], make)
    changed = F.col(names["spans"]) != ""
    out = out.withColumn("text", F.when(changed, F.col(new)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
