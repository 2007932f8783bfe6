"""Personal data: rules, and a skip-chain conditional random field over the candidates of each document.

A node is a candidate: a match of a rule that passes its test, what such matches leave of one that fails, or a word that
looks like a number or an address. Its label is O or a kind. Neighbours in the text are linked, and so are all candidates
of the same digits, or of the same name before the @, however far apart: each with the entity's hub, which is its first
mention that passes a rule, else its first mention. So evidence has one step to go, however many mentions there are.
Messages are passed over this loopy graph until they settle, and what a document shows plainly in one place is found in
the others too. What passes a rule keeps its label. Weights are learned by pseudo-likelihood from documents that are made
by rule from a seed.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import append_columns, fresh

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # O comes first
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits is matched from its first digit or not at all, so scans take time in proportion to the text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\s,;|<>\"']+")
DIGIT = re.compile(r"[0-9]")
SEPARATORS, TOKEN = " ().-", re.compile(r"[^ ]+")
#: Digits of a kind, at most.
MOST_DIGITS = {1: 12, 2: 19, 3: 15}
#: Digits of a word that make it a candidate.
MANY = 7
NEAR = 80
ROUNDS, SETTLED = 30, 1e-4
DOCS, SEED, EPOCHS, RATE, DECAY = 500, 1, 200, 0.5, 1e-3

Span = tuple[int, int, int]  # kind, start, end


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not LOCAL_END.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # the next name starts after this match, or after this @
        done = m.end() if m else at + 1
        at = text.find("@", done)


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """What the rules find, by kind, then start; and what they match but drop."""
    good: list[Span] = [(0, a, b) for a, b in _emails(text)]
    bad: list[Span] = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            passed = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
            (good if passed else bad).append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) > 6:
                (good if 16 <= len(digits) <= 19 and luhn(digits) else bad).append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            (good if 8 <= len(DIGIT.findall(m[0])) <= 15 else bad).append((3, m.start(), m.end()))
    return good, bad


@dataclass
class Graph:
    start: list[int]
    end: list[int]
    clamp: list[int]  # label that a rule gives, or -1
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


FEATURES = 40
_CUES = {"mail": 0, "email": 0, "e-mail": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "credit": 2, "account": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}


def _features(text: str, start: int, end: int, matched: dict[int, bool]) -> list[int]:
    """Which of FEATURES hold for a candidate. matched: kinds whose rule matches here, and whether its test passes."""
    s = text[start:end]
    digits = sum(c in "0123456789" for c in s)
    on = [0]
    on += [1 + 2 * k + passed for k, passed in matched.items()]
    on.append(9 + min(6, int(np.searchsorted([7, 8, 11, 16, 17, 20], digits, "right"))))
    on += [16 + i for i, c in enumerate("@.+-( :/") if c in s]
    dots = s.count(".")
    on.append(24 + min(dots, 4))
    on.append(29 + (digits == len(s)))
    if any(c.isalpha() for c in s):
        on.append(31)
    for word in text[max(0, start - 30) : start].lower().replace(":", " ").replace("=", " ").split()[-2:]:
        if word in _CUES:
            on.append(32 + _CUES[word])
    return on


def pieces(text: str, good: list[Span], bad: list[Span]) -> list[Span]:
    """What the passing matches leave of the failing ones, in parts that have MANY digits or more, and no more than their
    kind has unless they are one word; without separators at their ends."""
    taken = sorted({(a, b) for _, a, b in good})
    starts = [a for a, _ in taken]
    out = []
    for kind, a, b in bad:
        at = a
        cuts = []
        for x, y in taken[max(0, bisect.bisect_left(starts, a) - 1) :]:
            if x >= b:
                break
            if y > at:
                cuts.append((at, min(x, b)))
                at = max(at, y)
        cuts.append((at, b))
        for lo, hi in cuts:
            part: tuple[int, int, int] | None = None
            for m in TOKEN.finditer(text, lo, hi):
                n = len(DIGIT.findall(m[0]))
                if part and part[2] + n > MOST_DIGITS[kind]:
                    out += _trimmed(text, kind, *part)
                    part = None
                part = (part[0], m.end(), part[2] + n) if part else (m.start(), m.end(), n)
            if part:
                out += _trimmed(text, kind, *part)
    return out


def _trimmed(text: str, kind: int, lo: int, hi: int, digits: int) -> list[Span]:
    while lo < hi and text[lo] in SEPARATORS:
        lo += 1
    while lo < hi and text[hi - 1] in SEPARATORS:
        hi -= 1
    return [(kind, lo, hi)] if digits >= MANY else []


def _keys(s: str) -> list[str]:
    """What makes two candidates mentions of one entity."""
    if "@" in s:
        return ["@" + s.split("@")[0].lower()]
    digits = "".join(c for c in s if c in "0123456789")
    keys = ["#" + digits, "+" + digits[-10:]] if len(digits) > 9 else ["#" + digits]
    if s.count(".") == 3:
        keys.append("." + ".".join(s.split(".")[:3]))
    return keys


def graph(text: str, good: list[Span], bad: list[Span]) -> Graph:
    spans: dict[tuple[int, int], dict[int, bool]] = {}
    for passed, found in ((True, good), (False, pieces(text, good, bad))):
        for kind, a, b in found:
            spans.setdefault((a, b), {}).setdefault(kind, passed)
    nodes, reach = [], -1
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= reach or any(spans[a, b].values()):
            nodes.append((a, b))
            reach = max(reach, b)
    taken, k, more, reach = sorted(nodes), 0, [], -1
    for m in WORD.finditer(text):
        word = m[0]
        if "@" in word or (len(word) >= MANY and len(DIGIT.findall(word)) >= MANY):
            while k < len(taken) and taken[k][0] < m.end():
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= m.start():
                a, b = m.start(), m.start() + len(word.rstrip(".:)!?"))
                if b > a:
                    more.append((a, b))
    nodes = sorted(taken + more)
    g = Graph([a for a, _ in nodes], [b for _, b in nodes], [], [], [], [])
    mentions: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(nodes):
        matched = spans.get((a, b), {})
        g.clamp.append(next((1 + kind for kind in range(4) if matched.get(kind)), -1))
        g.features.append(_features(text, a, b, matched))
        if i and a - g.end[i - 1] < NEAR:
            g.chain.append((i - 1, i))
        for key in _keys(text[a:b]):
            mentions.setdefault(key, []).append(i)
    links = set()
    for own in mentions.values():
        hub = next((i for i in own if g.clamp[i] >= 0), own[0])
        links.update((hub, i) for i in own if i != hub)
    g.skip = sorted(links)
    return g


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs of each node, by sum-product messages over chain and skip links, in rounds until they settle."""
        n = len(g.start)
        score = np.array([self.unary[f].sum(axis=0) for f in g.features]).reshape(n, LABELS)
        for i, label in enumerate(g.clamp):
            if label >= 0:
                score[i] = -50.0
                score[i, label] = 0.0
        links = [*g.chain, *g.skip]
        if not links:
            return _softmax(score)
        edge = np.array(links)
        pair = np.exp(np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)]))
        source, target = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(source)), len(links))
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            total = score.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, pair) + 1e-30)
            new = 0.5 * (new - new.max(axis=1, keepdims=True)) + 0.5 * message
            moved = np.abs(new - message).max()
            message = new
            if moved < SETTLED:
                break
        total = score.copy()
        np.add.at(total, target, message)
        return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def labelled_documents(n: int = DOCS, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """n documents with their personal data, made by rule: plain forms, and later forms of the same data that no rule passes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("aeiourstnlmdc", k=r.randint(2, 8)))
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def card() -> str:
        s = digits(15)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def plain(kind: int) -> str:
        if kind == 0:
            return f"{word()}.{digits(2)}@{word()}.{r.choice(['com', 'org', 'net'])}"
        if kind == 1:
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == 2:
            return card()
        return f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"

    def changed(kind: int, s: str) -> str:
        if kind == 0:
            return s.split("@")[0] + "@" + word()
        if kind == 1:
            return s + ":" + digits(4) if r.random() < 0.5 else s.rsplit(".", 1)[0] + "." + str(r.randint(256, 999))
        if kind == 2:
            return ".".join(s[i : i + 4] for i in range(0, 16, 4))
        return "".join(c for c in s if c in "0123456789")[-10:]

    def unlike() -> str:
        """Numbers and names that are nobody's, though they look like the later forms."""
        four = [digits(4) for _ in range(4)]
        return r.choice([
            digits(16), digits(8), digits(r.randint(9, 15)), digits(10), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", "@" + word(), word() + "@" + word(), f"{digits(3)}.{digits(3)}.{digits(3)}", digits(24),
            f"{r.randint(256, 999)}.{digits(2)}.{digits(2)}.{digits(2)}", ".".join(four), "-".join(four), f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"v{digits(1)}.{digits(2)}.{digits(6)}",
        ])

    out = []
    for _ in range(n):
        text, spans, known = "", [], []
        # now and then one entity is mentioned many times
        many = r.random() < 0.15
        for _ in range(r.randint(4, 14) if not many else r.randint(10, 60)):
            text += " ".join(word() for _ in range(r.randint(0 if many else 1, 9))) + " "
            what = r.random()
            kind = r.randrange(4)
            if what < (0.4 if not many else 0.05) or (many and not known):
                s = plain(kind)
                if r.random() < 0.4:
                    text += r.choice([c for c, k in _CUES.items() if k == kind]) + r.choice([" ", ": "])
                known.append((kind, s))
            elif what < (0.6 if not many else 0.9) and known:
                kind, s = r.choice(known)
                s = changed(kind, s) if r.random() < 0.7 else s
            else:
                kind, s = -1, unlike()
                if r.random() < 0.3:
                    text += r.choice(["order ", "build ", "version ", "id ", "ref: ", "no. ", "page "])
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + " "
        out.append((text, spans))
    return out


def train(docs: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> Field:
    """The field that makes each node's true label likely, given the true labels of its neighbours."""
    rows, owners, truth, chain, skip = [], [], [], [], []
    for text, spans in docs:
        g = graph(text, *matches(text))
        base = len(truth)
        for a, b, f in zip(g.start, g.end, g.features, strict=True):
            truth.append(next((1 + k for k, x, y in spans if x < b and a < y), 0))
            rows += f
            owners += [len(truth) - 1] * len(f)
        chain += [(base + i, base + j) for i, j in g.chain]
        skip += [(base + i, base + j) for i, j in g.skip]
    n, y = len(truth), np.array(truth)
    x = np.zeros((n, FEATURES))
    x[owners, rows] = 1
    hot = np.eye(LABELS)[y]
    links = [np.array(e, dtype=np.int64).reshape(-1, 2) for e in (chain, skip)]
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    for _ in range(epochs):
        score = x @ field.unary
        for e, w in zip(links, (field.chain, field.skip), strict=True):
            np.add.at(score, e[:, 1], w[y[e[:, 0]]])
            np.add.at(score, e[:, 0], w.T[y[e[:, 1]]])
        d = (hot - _softmax(score)) / n * 20
        for e, w in zip(links, (field.chain, field.skip), strict=True):
            w += RATE * (hot[e[:, 0]].T @ d[e[:, 1]] + d[e[:, 0]].T @ hot[e[:, 1]] - DECAY * w)
        field.unary += RATE * (x.T @ d - DECAY * field.unary)
    return field


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """What the rules find, and what the field adds where no rule of that kind found anything."""
    good, bad = matches(text)
    g = graph(text, good, bad)
    if not g.start:
        return good, []
    belief = field.marginals(g)
    label = belief.argmax(axis=1)
    return good, [(int(k) - 1, a, b) for a, b, k, c, p in zip(g.start, g.end, label, g.clamp, belief.max(axis=1), strict=True) if k and c < 0 and p > 0.5]


_NUMBER_BYTE = np.zeros(256, dtype=bool)
_NUMBER_BYTE[list(b"0123456789@")] = True
FIELDS = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_spans", T.StringType()), ("spans", T.StringType())]


def find(docs: DataFrame, field: Field | None = None, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the number of findings by rule, and base_spans and spans as text (kind:start:end, comma-joined).

    Starts and ends count code points, the end exclusive; spans are sorted by kind as listed, then start. The field adds
    spans of the same kinds. Returns the frame and the names of these columns, which differ only where docs has such a
    name. A null or empty text has no findings. Whole texts are scanned; repeated rows are scanned each for itself.
    """
    names = {k: fresh(docs, k) for k, _ in FIELDS}
    sent = docs.sparkSession.sparkContext.broadcast(field or train(labelled_documents()))

    def make():
        field = sent.value

        def scan(_, texts):
            counts = [[0] * len(texts) for _ in KINDS]
            base, every = [""] * len(texts), [""] * len(texts)
            buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts])
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(_NUMBER_BYTE[buf]), "right")).tolist():
                good, more = spans_of(texts[i].decode(), field)
                for k, _, _ in good:
                    counts[k][i] += 1
                base[i], every[i] = line(good), line(good + more)
            return [*counts, base, every]

        return scan

    return append_columns(docs, text, [T.StructField(names[k], kind) for k, kind in FIELDS], make), names


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; n_chars follows the text.

    Of spans that overlap the first counts, and the other's rest goes with it. Null and empty texts and texts without
    findings stay as they are, no row goes, and equal texts get equal results.
    """
    out, names = find(docs)
    new = fresh(out, "clean_text")
    at = out.columns.index(names["spans"])

    def make():
        def cut(batch, texts):
            clean = []
            for text, found in zip(texts, batch.column(at).to_pylist(), strict=True):
                t = text.decode()
                if found:
                    pieces, done = [], 0
                    for a, b, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in found.split(",")):
                        if a >= done:
                            pieces += [t[done:a], f"<{kind}>"]
                        done = max(done, b)
                    t = "".join([*pieces, t[done:]])
                clean.append(t)
            return [clean]

        return cut

    out = append_columns(out, "text", [T.StructField(new, T.StringType())], make)
    changed = F.col(names["spans"]) != ""
    out = out.withColumn("text", F.when(changed, F.col(new)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
