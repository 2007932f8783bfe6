"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram of letters is the product of its letters' vectors, the k-th one
permuted k times (binding keeps order); a text is the sum of its n-grams' vectors (bundling), and so is a language of
its texts. A text's language is that of the prototype with the largest cosine. n-grams of a batch share one matrix of
vectors, so bundling is one product of counts and vectors.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import append_columns, fresh, ship, texts_of
from docspark.llm.toxicity import held_out

DIMS, NGRAM, SYMBOLS = 1024, 3, 4096
#: Letters under this code point have a symbol of their own.
OWN = 0x250
#: Labelled texts that are learned from, at most about, in equal parts for each language: those whose id's hash is under the
#: share that gives so many.
TRAIN_ROWS = 40_000
UNKNOWN = "und"
#: Entries of the matrix of counts that are made at once.
_COUNTS = 8 << 20

_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol, 0 for what is not a letter; and the vectors of the symbols, for each place in an n-gram.

    Lower-case letters under OWN have symbols of their own, and a letter's case does not matter; all others are hashed
    into the rest, of which there are far more than a language beyond the large scripts has letters.
    """
    if not _TABLES:
        symbol = np.zeros(0x110000, dtype=np.uint16)
        own: dict[str, int] = {}
        low_letters = [chr(cp) for cp in range(OWN) if unicodedata.category(chr(cp))[0] == "L" and chr(cp).lower()[:1] == chr(cp)]
        for c in low_letters:
            own[c] = len(own) + 1
        rest = len(own) + 1
        for cp in range(0x110000):
            c = chr(cp)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()[:1]
                symbol[cp] = own.get(low) or rest + (ord(low) * 2654435761 >> 7) % (SYMBOLS - rest)
        rng = np.random.default_rng(7)
        letters = rng.choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMS))
        order = rng.permutation(DIMS)
        places = [letters]
        for _ in range(NGRAM - 1):
            places.append(places[-1][:, order])
        _TABLES[:] = [symbol, np.stack(places)]
    return _TABLES[0], _TABLES[1]


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vectors of some texts (texts x DIMS), and whether each has a letter.

    What is not a letter parts words; n-grams take one such gap on either side of a word.
    """
    symbol, places = tables()
    joined = "\x00" + "\x00".join(texts) + "\x00"
    codes = symbol[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
    keep = np.flatnonzero((codes[1:] != 0) | (codes[:-1] != 0)) + 1  # one gap after each word
    codes = codes[keep].astype(np.int64)
    text = np.searchsorted(ends, keep, "right") - 1
    letters = np.bincount(text[codes != 0], minlength=len(texts)) > 0
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    if len(codes) == 0:
        return out, letters
    before = np.concatenate([[0], codes[:-1]])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = 0
    after = np.concatenate([codes[1:], [0]])
    gram = (before * SYMBOLS + codes) * SYMBOLS + after
    some = np.flatnonzero(codes != 0)  # the middle of an n-gram is a letter
    gram, text = gram[some], text[some]
    if len(gram) == 0:
        return out, letters
    grams, place = np.unique(gram, return_inverse=True)
    vectors = (places[2][grams // SYMBOLS**2] * places[1][grams // SYMBOLS % SYMBOLS] * places[0][grams % SYMBOLS]).astype(np.float32)
    step = max(1, _COUNTS // len(grams))
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    for lo in range(0, len(texts), step):
        hi = min(len(texts), lo + step)
        own = slice(first[lo], first[hi])
        counts = np.bincount((text[own] - lo) * len(grams) + place[own], minlength=(hi - lo) * len(grams)).astype(np.float32)
        out[lo:hi] = counts.reshape(hi - lo, len(grams)) @ vectors
    return out, letters


@dataclass
class Profiles:
    """Languages in order, their unit prototypes, and the mean direction that is taken off texts and prototypes."""

    languages: list[str]
    prototypes: np.ndarray
    centre: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors, letters = bundles(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        vectors = vectors / norm - self.centre
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cosine = vectors @ self.prototypes.T
        best = cosine.argmax(axis=1)
        names = [self.languages[k] if some else UNKNOWN for k, some in zip(best, letters, strict=True)]
        return names, np.where(letters, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0).astype(np.float64)


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Profiles:
    """Profiles of the languages of docs(doc_id, text, lang): rows with a text and lang whose id is not held out.

    Unit vectors of texts are rounded to whole numbers before they are summed up, so sums don't depend on their order.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    # ids and languages only are counted; there is a prototype for each language, so their number is small
    counts = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id")).groupBy("lang").agg(F.count("*").alias("rows_of_lang"))
    many = counts.count()
    share = counts.select(F.col("lang"), (F.lit(float(1 << 30)) * most / (F.col("rows_of_lang") * max(1, many))).alias("share"))
    labelled = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("share"))

    def bundle(batches):
        for batch in batches:
            texts, langs = [t.decode() for t in texts_of(batch.column(0))], np.array(batch.column(1).to_pylist(), dtype=object)
            sums: dict[str, tuple[np.ndarray, int]] = {}
            for lo in range(0, len(texts), 256):
                vectors, letters = bundles(texts[lo : lo + 256])
                whole = np.rint(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) * 2**20).astype(np.int64)
                for lang in set(langs[lo : lo + 256][letters]):
                    own = letters & (langs[lo : lo + 256] == lang)
                    old = sums.get(lang, (0, 0))
                    sums[lang] = (old[0] + whole[own].sum(axis=0), old[1] + int(own.sum()))
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0].tolist() for v in sums.values()], pa.list_(pa.int64())), pa.array([v[1] for v in sums.values()], pa.int64())], ["lang", "vector", "n"])

    ship(spark)
    parts = labelled.select("text", "lang").mapInArrow(bundle, "lang string, vector array<long>, n long")
    # a row for each language and place of the vector: as many as the sample has languages, whatever the input's size
    rows = parts.select("lang", "n", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    many: dict[str, int] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r.lang, np.zeros(DIMS))[r["at"]] = r.x
        many[r.lang] = r.n
    languages = sorted(found)
    if not languages:
        return Profiles([], np.zeros((0, DIMS)), np.zeros(DIMS))
    means = np.stack([found[x] / many[x] / 2**20 for x in languages])
    centre = means.mean(axis=0) if len(languages) > 1 else np.zeros(DIMS)
    prototypes = means - centre
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return Profiles(languages, prototypes.astype(np.float32), centre.astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with each text's language and score (0 to 1), and the names of these columns (lang_pred, lang_score).

    A text that is null or has no letter is `und`, with score 0; so is every text if nothing was learned. Whole texts
    are read; only texts are read. Equal texts get equal results; ties go to the language first in order.
    """
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        return lambda _, texts: list(sent.value.predict([t.decode() for t in texts]))

    return append_columns(docs, text, [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())], make), name, score
