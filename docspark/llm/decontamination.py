"""Benchmark decontamination: texts are scanned for the word windows of test items.

Up to PART_BYTES of items, an index of their windows is broadcast: sorted hashes with the place of each window in one
buffer of normalised words, so that each hit is verified word by word where the text lies. Of more items only a bitmap of
hashes, of a fixed size, is broadcast; the windows that it lets through are joined with the items' windows by shuffle,
on their words, and what they hit is joined with the texts, of which only those that may have a hit are dealt out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.cluster import ship
from docspark.llm.common import CHUNK_BYTES, Tables, append_columns, batches_of, fresh, give_back, in_bitmap, slices, stored, texts_of, words_of

#: Bytes of benchmark text whose index, about five times as large, is broadcast.
PART_BYTES = 8 << 20
#: Bits of the gate that is broadcast for more text, as a power of two.
GATE_BITS = 27
#: A word before lower-casing.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _chunks(texts: list[bytes]):
    """Ranges of texts of about CHUNK_BYTES."""
    lo = room = 0
    for i, t in enumerate(texts):
        room += len(t)
        if room > CHUNK_BYTES or i + 1 == len(texts):
            yield lo, i + 1
            lo, room = i + 1, 0


def _windows(w, n: int):
    """(size, first word, text, hash) of the windows of some texts: arrays, for each size."""
    short = np.unique(w.counts[(w.counts > 0) & (w.counts < n)]).tolist()
    for size in [*short, n]:
        at, text = w.windows(size)
        if size < n:  # a text of so few words is one window
            own = w.counts[text] == size
            at, text = at[own], text[own]
        yield size, at, text, w.window_hash(at, size)


class WindowIndex:
    """For each window length sorted hashes, the places of their windows in a buffer of normalised words, and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.names = [name for name, _ in items]
        pieces, found = [], {}
        room = 0
        for lo, hi in _chunks([t for _, t in items]):
            w = words_of([t for _, t in items[lo:hi]])
            size = w.end - w.start
            start = room + np.cumsum(size + 1) - (size + 1)  # words are parted by one space here
            piece = b"".join(w.word(i) + b" " for i in range(len(size)))
            for k, at, text, h in _windows(w, n):
                found.setdefault(k, []).append((h, start[at], start[at + k - 1] + size[at + k - 1], text + lo))
            pieces.append(piece)
            room += len(piece)
        self.buf = b"".join(pieces)
        self.by_length = {}
        for k, parts in found.items():
            h, start, end, item = (np.concatenate([p[c] for p in parts]) for c in range(4))
            if len(h):
                order = np.argsort(h, kind="stable")
                gate = np.zeros(1 << 16, dtype=bool)
                gate[(h >> np.uint64(48)).astype(np.int64)] = True
                self.by_length[k] = (h[order], start[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32), gate)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Words of each text, the indexes of those inside an occurrence of a window, and the items found."""
        w = words_of(texts)
        hit: list[set[int]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for size, (known, start, end, item, gate) in self.by_length.items():
            at, text = w.windows(size)
            h = w.window_hash(at, size)
            some = np.flatnonzero(gate[(h >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(known, h[some]), np.searchsorted(known, h[some], "right")
            for k, a, b in zip(some[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                i, t = int(at[k]), int(text[k])
                own = b" ".join(w.word(j) for j in range(i, i + size))
                same = [self.names[item[j]] for j in range(a, b) if self.buf[start[j] : end[j]] == own]
                if same:
                    first = i - int(w.first[t])
                    hit[t].update(range(first, first + size))
                    items[t].update(x for x in same if x is not None)
        return w.counts, [sorted(x) for x in hit], [sorted(x) for x in items]


def _in_one_pass(docs: DataFrame, items: DataFrame, n: int, text: str, names: dict[str, str]) -> DataFrame:
    """items, (item, t), are of a checked size."""
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r["item"], bytes(r.t)) for r in items.toLocalIterator()], n))
    fields = [T.StructField(names["n_words"], T.LongType()), T.StructField(names["hits"], T.ArrayType(T.IntegerType())), T.StructField(names["items"], T.ArrayType(T.StringType()))]
    return append_columns(docs, text, fields, lambda: lambda _, texts: list(index.value.scan(texts)))


def _by_join(docs: DataFrame, items: DataFrame, n: int, text: str, names: dict[str, str]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)

    def window_rows(batches):
        for batch in batches:
            for part in slices(batch, 1):
                own, w = part.column(0).to_pylist(), words_of(texts_of(part.column(1)))
                for size, at, of, h in _windows(w, n):
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(at), pa.int32()), pa.array(h.view(np.int64)), pa.array([b" ".join(w.word(j) for j in range(i, i + size)) for i in at.tolist()], pa.binary()), pa.array([own[t] for t in of.tolist()], pa.string())], ["size", "h", "words", "item"])

    def candidate_rows(batches):
        bits, lengths = gate.value
        for batch in batches:
            for part in slices(batch, 1):
                w = words_of(texts_of(part.column(1)))
                for size in lengths:
                    at, of = w.windows(size)
                    h = w.window_hash(at, size)
                    place = (h >> np.uint64(64 - GATE_BITS)).astype(np.int64)
                    some = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    at, of = at[some], of[some]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array([size] * len(at), pa.int32()), pa.array(at - w.first[of], pa.int32()), pa.array([b" ".join(w.word(j) for j in range(i, i + size)) for i in at.tolist()], pa.binary())], ["key", "size", "at", "words"])
        give_back()

    with Tables(spark) as tables, batches_of(spark, 500):
        windows = tables.stored(items.mapInArrow(window_rows, "size int, h long, words binary, item string").distinct(), "windows")
        lengths = sorted(r.size for r in windows.select(F.col("size").alias("size")).distinct().collect())  # n at most
        place = F.shiftrightunsigned("h", 64 - GATE_BITS) + 1
        rows = windows.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
        bits = np.zeros(1 << (GATE_BITS - 3), dtype=np.uint8)
        for r in rows.toLocalIterator():  # 2**GATE_BITS bits, whatever the items' size
            bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        gate = spark.sparkContext.broadcast((bits, lengths))
        keyed = docs.select(F.unhex(F.md5(text)).alias("key"), F.col(text).alias("t")).where("t is not null")
        seen = tables.stored(keyed.mapInArrow(candidate_rows, "key binary, size int, at int, words binary").distinct(), "candidates")
        found = seen.join(windows.drop("h"), ["size", "words"]).groupBy("key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
        found = stored(found, "hits")
        gate.unpersist()
    bits, part, on = in_bitmap(found)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(text)).alias("key"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    row = row.join(bits, part == F.col("bits_part"), "left").withColumn("maybe", F.coalesce(on, F.lit(False)))
    none = {"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    hit = row.where("maybe").join(found, "key", "left").select("row.*", F.col("n").alias(names["n_words"]), *(F.coalesce(k, v).alias(names[k]) for k, v in none.items()))
    return hit.union(row.where("not maybe").select("row.*", F.col("n").alias(names["n_words"]), *(v.alias(names[k]) for k, v in none.items())))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", part_bytes: int = PART_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, hits (sorted word indexes inside an occurrence of a benchmark window) and items (sorted ids).

    Returns the frame and the names that these columns have there; they differ only where docs has such a name.
    A window is n consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs of
    ASCII letters (lower-cased), digits and characters beyond ASCII. A null or empty text has no words and no hits; so
    has every text if benchmark is empty. An item with a null text has no windows; one with a null id marks words but is
    not listed. Repeated rows are scanned each for itself.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    names = {k: fresh(docs, k) for k in ("n_words", "hits", "items")}
    return (_in_one_pass if total <= part_bytes else _by_join)(docs, items, n, text, names), names


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs whose text holds no benchmark window, as they are.

    Null and empty texts stay, repeated rows stay or go together, and all stay if benchmark is empty.
    """
    out, names = scan(docs, benchmark, n)
    return out.where(F.size(names["hits"]) == 0).drop(*names.values())


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with each run of hit words, and what stands between them, replaced by a line end; n_chars follows the text.

    Other rows, null and empty texts among them, stay as they are; no row goes, and equal texts get equal results.
    """
    out, names = scan(docs, benchmark, n)
    keep = fresh(out, "kept_text")
    hits = out.columns.index(names["hits"])

    def make():
        def cut(batch, texts):
            new = []
            for text, hit in zip(texts, batch.column(hits).to_pylist(), strict=True):
                if hit:
                    w = words_of([text])
                    raw, at, pieces = w.buf[1:-1], 0, []
                    for k, i in enumerate(hit):
                        if not k or hit[k - 1] != i - 1:
                            pieces.append(raw[at : w.start[i] - 1])
                        at = int(w.end[i]) - 1
                    text = b"\n".join([*pieces, raw[at:]])
                new.append(text.decode())
            return [new]

        return cut

    cut = append_columns(out, "text", [T.StructField(keep, T.StringType())], make)
    changed = cut.withColumn("text", F.when(F.size(names["hits"]) > 0, F.col(keep)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(names["hits"]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
