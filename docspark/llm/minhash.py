"""Near-duplicates by ProbMinHash over shingles of five words, as sets and weighted by their counts.

1. Equal texts are one node, named by the text's MD5. A task sketches each of its texts once.
2. Each node gets a signature: every distinct shingle, weighted by its count, is a Poisson process of that rate whose
   arrivals fall on random registers; a register keeps its earliest arrival. A process ends once its time passes the
   latest register, so most shingles arrive once or twice. Two registers agree with the probability Jaccard similarity.
   A text in which a shingle repeats gets a second signature, with each shingle's weight 1, whose registers agree with
   the Jaccard similarity of the sets; for other texts the two are the same.
3. Nodes with an equal band of registers share a bucket. Band rows are dealt out once, by ranges of (band, node), so that
   a large bucket is many tasks' rows; only rows of shared buckets go on. A bucket's leader is the member that shares most
   buckets with others, so a group of copies is compared with its centre, not pair by pair. Leader pairs are verified.
4. Members of a bucket that are still in different components are compared in blocks of bounded size, by signature and
   then exactly; a pair of blocks gives one link for each two components. So a bucket loses no link, however large.
5. Connected components of the links are the classes.

Texts and sketches that are wanted again are found by a bitmap of their nodes' hashes, of a bounded size, that is sent to
all tasks; only what it lets through is dealt out and joined. Nothing else is broadcast but what Spark finds small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.cluster import ship
from docspark.llm.common import CHUNK_BYTES, Tables, Words, append_columns, fresh, give_back, in_bitmap, mix64, slices, texts_of, words_of
from docspark.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Bytes of a sketch of one signature.
SKETCH_BYTES = 2 * REGISTERS
#: A pair is verified if at least this share of registers agrees: over four standard deviations below THRESHOLD.
SCREEN = 0.64
#: Bytes of signatures or shingles that are compared with each other at once, and blocks that one task compares with one block.
REST_BYTES, ALL_BYTES, LOT = 2 << 20, 1 << 18, 64
#: Rows of an Arrow batch: of pairs of blocks, and of pairs of texts.
PAIR_ROWS, TEXT_ROWS = 8, 1000
#: Texts whose keys a task remembers, so as not to sketch copies of them again.
REMEMBERED = 1 << 17
NODE = T.BinaryType()
_DOC_BITS = 12
_MASK = np.uint64((1 << (64 - _DOC_BITS)) - 1)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, sorted. A text of fewer words, but not none, is one shingle."""
    at, text = w.windows(size)
    h = w.window_hash(at, size)
    for t in np.flatnonzero((w.counts > 0) & (w.counts < size)).tolist():
        k = int(w.counts[t])
        text, h = np.append(text, t), np.append(h, w.window_hash(w.first[t : t + 1], k) + np.uint64(k))
    key = np.sort((text.astype(np.uint64) << np.uint64(64 - _DOC_BITS)) | (h & _MASK))
    new = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0) if len(key) else np.zeros(0, dtype=np.int64)
    return (key[new] >> np.uint64(64 - _DOC_BITS)).astype(np.int64), key[new] & _MASK, np.diff(np.append(new, len(key)))


def signatures(texts: int, owner: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, texts x m: the hash of the shingle that came first on each register (0: no shingle)."""
    first = np.full(texts * m, np.inf)
    who = np.zeros(texts * m, dtype=np.uint64)
    state, time, rate = mix64(h + np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(h)), weight.astype(np.float64)
    while len(h):
        state = mix64(state + np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        place = mix64(state ^ np.uint64(0x2545F4914F6CDD1D))
        at = owner * m + ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sooner = np.flatnonzero(time < first[at])
        np.minimum.at(first, at[sooner], time[sooner])
        won = sooner[time[sooner] == first[at[sooner]]]
        who[at[won]] = h[won]
        alive = time < first.reshape(texts, m).max(axis=1)[owner]
        owner, h, state, time, rate = owner[alive], h[alive], state[alive], time[alive], rate[alive]
    return who.reshape(texts, m)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard and probability Jaccard similarity of two texts' sorted distinct shingles and counts."""
    (ha, xa), (hb, xb) = a, b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    n, union = len(ia), len(ha) + len(hb) - len(ia)
    if xa.max() == xb.max() == 1:
        return n / union, n / union
    only_b = np.ones(len(hb), dtype=bool)
    only_b[ib] = False
    x = np.concatenate([xa, np.zeros(int(only_b.sum()))]).astype(np.float64)
    y = np.zeros(len(x))
    y[ia] = xb[ib]
    y[len(xa) :] = xb[only_b]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    both = np.flatnonzero((x > 0) & (y > 0))
    last = np.searchsorted(ratio, ratio[both], "right") - 1
    return n / union, float(np.sum(1 / (below[last] / x[both] + above[last] / y[both])))


def _signed(texts: list[bytes]) -> tuple[list, list]:
    """Bands and sketch of each text, both None for a text without a word. A sketch is 16 bits of each register.

    Where a shingle repeats, bands and sketch of the sets follow those of the weighted shingles.
    """
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def banded(who):
        band = np.zeros((len(who), BANDS), dtype=np.uint64) + salt
        for k in range(ROWS):
            band = mix64(band * np.uint64(0xD6E8FEB86659FD93) + who[:, k::ROWS])
        return band.view(np.int64), mix64(who).astype(np.uint16)

    bands, sketches = [], []
    for lo in range(0, len(texts), 1 << _DOC_BITS):
        part = texts[lo : lo + (1 << _DOC_BITS)]
        w = words_of(part)
        owner, h, count = shingles(w)
        band, short = banded(signatures(len(part), owner, h, count))
        some = w.counts > 0
        own = [x.tolist() if k else None for x, k in zip(band, some, strict=True)]
        sketched = [x.tobytes() if k else None for x, k in zip(short, some, strict=True)]
        several = np.unique(owner[count > 1])
        if len(several):
            held = np.isin(owner, several)
            band, short = banded(signatures(len(several), np.searchsorted(several, owner[held]), h[held], np.ones(int(held.sum()))))
            for t, x, b in zip(several.tolist(), short, band, strict=True):
                own[t] += b.tolist()
                sketched[t] += x.tobytes()
        bands += own
        sketches += sketched
    return bands, sketches


def _sketch(texts: DataFrame) -> DataFrame:
    """(key, text) -> (key, bands, sketch) of texts with a word. Copies that one task has are sketched once."""
    schema = T.StructType([T.StructField("key", NODE), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 1):
                keys, own = part.column(0).to_pylist(), texts_of(part.column(1))
                new = []
                for i, k in enumerate(keys):
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                bands, sketches = _signed([own[i] for i in new])
                rows = [(keys[i], b, x) for i, b, x in zip(new, bands, sketches, strict=True) if x is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["key", "bands", "sketch"])
        give_back()

    ship(texts.sparkSession)
    return texts.select("key", "text").mapInArrow(run, schema)


def _shared_rows(batches):
    """Of rows (band, key) in order, those of bands with two keys or more, once each; and all of the first and last band,
    which may go on in the next task's rows. Of a band's rows, one at most is held back.

    near is the number of a band's keys in a row's batch, so of most bands the size.
    """
    held, last = None, None  # a band's only row so far; (band, key) of the row before
    schema = pa.schema([("band", pa.int64()), ("key", pa.binary()), ("near", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        band, keys = np.asarray(batch.column(0)), batch.column(1)
        key = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint64).reshape(-1, 2)
        new_band = np.diff(band, prepend=band[:1]) != 0
        new_band[0] = last is None or last[0] != band[0]
        new = new_band | np.concatenate([[False], (key[1:] != key[:-1]).any(axis=1)])
        new[0] = last is None or last != (band[0], key[0].tobytes())
        run = np.cumsum(new_band)  # 0: the band of the batch before goes on
        at = np.flatnonzero(new)
        own = run[at]
        many = np.bincount(own, minlength=int(run[-1]) + 1)[own]
        keep = (many > 1) | (own == 0)
        if last is None:
            keep |= own == 1
        if held is not None and (own == 0).any():
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.binary()), pa.array([1], pa.int64())], schema=schema)
        if (own == 0).any() or run[-1] > 0:
            held = None
        if len(at) and not keep[-1] and own[-1] == run[-1]:
            held = (int(band[at[-1]]), key[at[-1]].tobytes())
        last = (band[-1], key[-1].tobytes())
        if keep.any():
            places = pa.array(at[keep], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), keys.take(places), pa.array(many[keep], pa.int64())], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.binary()), pa.array([1], pa.int64())], schema=schema)
    give_back()


def _held(sketches: DataFrame) -> DataFrame:
    """(key, bands, weight) of nodes that share a band, with those that they share and a few more; an exchange by ranges, one by key.

    weight grows with the others that a node shares bands with; only the choice of leaders depends on it.
    """
    ship(sketches.sparkSession)
    rows = sketches.select(F.explode("bands").alias("band"), "key").repartitionByRange("band", "key").sortWithinPartitions("band", "key")
    shared = rows.mapInArrow(_shared_rows, T.StructType([T.StructField("band", T.LongType()), T.StructField("key", NODE), T.StructField("near", T.LongType())]))
    # a node has 2 * BANDS bands at most
    return shared.groupBy("key").agg(F.collect_set("band").alias("bands"), F.sum("near").alias("weight"))


def _among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df(key, ...) whose key is in a stored table, and a few others that its bitmap lets through; once each."""
    bits, part, on = in_bitmap(keys)
    return df.join(bits, (part == F.col("bits_part")) & on).drop("bits_part", "bits").dropDuplicates(["key"])


def _verified(pairs: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """Of stored pairs(key, leader, ...) of nodes, those whose texts are similar enough."""
    found = tables.stored(_among(texts, _ends(pairs)), "texts")
    both = pairs.join(found.select(F.col("key"), F.col("text").alias("text_u")), "key").join(found.select(F.col("key").alias("leader"), F.col("text").alias("text_v")), "leader").select(*pairs.columns, "text_u", "text_v")
    n = len(pairs.columns)

    def verify(batches):
        for batch in batches:
            keep = []
            at, room = 0, 0
            left, right = texts_of(batch.column(n)), texts_of(batch.column(n + 1))
            for i in range(len(left)):
                room += len(left[i]) + len(right[i])
                if room > CHUNK_BYTES or i + 1 == len(left) or i + 1 - at == 1 << (_DOC_BITS - 1):
                    m = i + 1 - at
                    owner, h, count = shingles(words_of(left[at : i + 1] + right[at : i + 1]))
                    first = np.searchsorted(owner, np.arange(2 * m + 1))
                    own = lambda t: (h[first[t] : first[t + 1]], count[first[t] : first[t + 1]])  # noqa: B023, E731
                    keep += [max(similarities(own(t), own(m + t))) >= THRESHOLD - 1e-9 for t in range(m)]
                    at, room = i + 1, 0
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(range(n)))
        give_back()

    ship(pairs.sparkSession)
    return both.mapInArrow(verify, pairs.schema)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("key", "leader")).alias("key"))


def _block_pairs(members: DataFrame, tables: Tables) -> DataFrame:
    """For members(band, key, root, main, sketch, ...) rows (band, some, all, main), lists of members of bounded bytes.

    Every member outside its bucket's main component meets every member of the bucket, itself too. The former are in
    blocks of REST_BYTES, the latter in blocks of ALL_BYTES that are dealt out once for each block of the former, in
    lots of LOT blocks, so that a large bucket is many small tasks' work.
    """
    payload = [c for c in members.columns if c not in ("band", "key", "root", "main")]
    size = sum((F.size(c) * 8 if c == "bands" else F.octet_length(c) for c in payload), F.lit(64))
    away = F.col("root") != F.col("main")
    blocks = members.groupBy("band").agg(F.ceil(F.sum(size) / ALL_BYTES).cast("int").alias("alls"), F.ceil(F.sum(F.when(away, size)) / REST_BYTES).cast("int").alias("rests")).where("rests > 0")
    members = members.join(tables.stored(blocks, "blocks"), "band")
    member = F.struct("key", "root", *payload)
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    lots = F.ceil(F.first("alls") / LOT).cast("int").alias("lots")
    every = members.groupBy("band", dealt("alls").alias("block")).agg(F.collect_list(member).alias("all"), F.first("rests").alias("n"), F.first("main").alias("main"), lots)
    every = every.withColumn("lot", F.pmod("block", "lots")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rest = members.where(away).groupBy("band", dealt("rests").alias("b")).agg(F.collect_list(member).alias("some"), lots)
    rest = rest.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return every.join(rest, ["band", "b", "lot"]).select("band", "some", "all", "main")


def _sides(batch: pa.RecordBatch, row: int):
    """The two lists of members of a row of _block_pairs, and their roots as numbers."""
    both = [batch.column(k).slice(row, 1).flatten() for k in (1, 2)]
    number: dict[bytes, int] = {}
    roots = [np.array([number.setdefault(n, len(number)) for n in x.field("root").to_pylist()]) for x in both]
    return both, roots


def _near(both: list, roots: list[np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members in different components whose signatures, weighted or of the sets, agree on SCREEN of the
    registers or more.

    A pair that shares several bands is a pair in the smallest of them only, whichever of the two comes first.
    """
    sides = []
    for x in both:
        # a lone sketch is that of the sets too
        raw = np.frombuffer(b"".join(k if len(k) > SKETCH_BYTES else k + k for k in x.field("sketch").to_pylist()), dtype=np.uint16).reshape(len(x), 2, REGISTERS)
        bands = np.array([k if len(k) > BANDS else k + k for k in x.field("bands").to_pylist()], dtype=np.int64).reshape(len(x), 2, BANDS)
        sides.append((raw, bands))
    (a, bands_a), (b, bands_b) = sides
    weighted, sets = (np.ascontiguousarray(b[:, k]) for k in (0, 1))
    repeats_a, repeats_b = ((x[:, 0] != x[:, 1]).any(axis=1) for x in (a, b))
    several = np.flatnonzero(repeats_b)
    found = []
    for row, own, root, repeats in zip(a, bands_a, roots[0], repeats_a, strict=True):
        agree = np.count_nonzero(weighted == row[0], axis=1)
        if repeats:
            agree = np.maximum(agree, np.count_nonzero(sets == row[1], axis=1))
        elif len(several):
            agree[several] = np.maximum(agree[several], np.count_nonzero(sets[several] == row[1], axis=1))
        near = np.flatnonzero((agree >= SCREEN * REGISTERS) & (roots[1] != root))
        if len(near):
            other = bands_b[near]
            shared = (other == own) | (other[:, ::-1] == own)
            near = near[np.where(shared, own, np.iinfo(np.int64).max).min(axis=(1, 2)) == band]
        found.append(near)
    return np.repeat(np.arange(len(a)), [len(x) for x in found]), np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _suspects(batches):
    """Members that have a near pair in a bucket, whichever the partner: no more rows than members of the blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            both, roots = _sides(batch, row)
            for x, i in zip(both, _near(both, roots, batch.column(0)[row].as_py()), strict=True):
                at = pa.array(np.unique(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[row], len(at)), x.field("key").take(at), x.field("root").take(at), pa.repeat(batch.column(3)[row], len(at))], ["band", "key", "root", "main"])
    give_back()


def common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 11) -> np.ndarray:
    """How many elements each set of a shares with each of b, by products of 0/1 matrices of so many columns."""
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), dtype=np.float32)

    def cells(sets, flat):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        held = shared[at] == flat if len(shared) else np.zeros(len(flat), dtype=bool)
        return owner[held], at[held]

    sides = [cells(a, left), cells(b, right)]
    for lo in range(0, len(shared), columns):
        one = []
        for sets, (owner, at) in zip((a, b), sides, strict=True):
            own = (at >= lo) & (at < lo + columns)
            m = np.zeros((len(sets), columns), dtype=np.float32)
            m[owner[own], at[own] - lo] = 1
            one.append(m)
        out += one[0] @ one[1].T
    return out


def _exact(batches):
    """Links between components, verified; of links that join the same two components in a pair of blocks, one."""
    for batch in batches:
        for row in range(batch.num_rows):
            both, roots = _sides(batch, row)
            i, j = _near(both, roots, batch.column(0)[row].as_py())
            if not len(i):
                continue
            sets = [[np.frombuffer(h, dtype=np.uint64) for h in x.field("shingles").to_pylist()] for x in both]
            counts = [[np.frombuffer(c, dtype=np.uint32) if c else np.ones(len(s), dtype=np.uint32) for c, s in zip(x.field("counts").to_pylist(), side, strict=True)] for x, side in zip(both, sets, strict=True)]
            ui, uj = np.unique(i), np.unique(j)
            shared = common([sets[0][k] for k in ui], [sets[1][k] for k in uj])[np.searchsorted(ui, i), np.searchsorted(uj, j)]
            size = [np.array([len(x) for x in side]) for side in sets]
            alike = shared / (size[0][i] + size[1][j] - shared)
            parent = list(range(1 + max(roots[0].max(), roots[1].max())))

            def top(k):
                while parent[k] != k:  # noqa: B023
                    parent[k] = parent[parent[k]]  # noqa: B023
                    k = parent[k]  # noqa: B023
                return k

            keep = []
            many = [np.array([c.max(initial=1) > 1 for c in side]) for side in counts]
            for n in np.flatnonzero((alike >= THRESHOLD - 1e-6) | many[0][i] | many[1][j]).tolist():
                k, m = int(i[n]), int(j[n])
                x, y = top(int(roots[0][k])), top(int(roots[1][m]))
                if x != y and max(similarities((sets[0][k], counts[0][k]), (sets[1][m], counts[1][m]))) >= THRESHOLD - 1e-9:
                    parent[x] = y
                    keep.append(n)
            u, v = both[0].field("key").take(pa.array(i[keep], pa.int64())), both[1].field("key").take(pa.array(j[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])
    give_back()


def _in_blocks(buckets: DataFrame, sketches: DataFrame, roots: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame | None:
    """Verified links (u, v) between members of one bucket that are in different components; None if there is none to look at.

    buckets(band, key, weight, leader) has the members of buckets of three or more. A bucket whose members are all in
    one component is done. Else its members outside the leader's component meet all members, in blocks: first by
    signature, then, those that have a near pair, by all their shingles.
    """
    ship(buckets.sparkSession)
    named = tables.stored(buckets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "named")
    open_ = named.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(F.struct("weight", "key", "root")).alias("top")).where("least <> most").select("band", F.col("top.root").alias("main"))
    # leader pairs are verified already
    members = tables.stored(named.join(open_, "band").where("key <> leader").select("band", "key", "root", "main"), "members")
    if members.isEmpty():
        return None
    signed = tables.stored(_among(sketches, members.select("key")), "signed")
    schema = T.StructType([T.StructField("band", T.LongType()), *(T.StructField(c, NODE) for c in ("key", "root", "main"))])
    seen = _block_pairs(_placed(members, signed), tables).mapInArrow(_suspects, schema)
    seen = tables.stored(tables.stored(seen, "suspects", PAIR_ROWS).distinct(), "suspects")
    if seen.isEmpty():
        return None
    words = [T.StructField("shingles", T.BinaryType()), T.StructField("counts", T.BinaryType())]

    def make():
        def sets(_, texts):
            owner, h, count = shingles(words_of(texts))
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            counts = [count[first[t] : first[t + 1]].astype(np.uint32) for t in range(len(texts))]
            # counts that are all 1 are left out
            return [[h[first[t] : first[t + 1]].tobytes() for t in range(len(texts))], [c.tobytes() if c.max(initial=1) > 1 else b"" for c in counts]]

        return sets

    found = append_columns(_among(texts, seen.select("key")).select("key", "text"), "text", words, make).drop("text")
    full = _placed(seen, signed.join(tables.stored(found, "sets"), "key"))
    return _block_pairs(full, tables).mapInArrow(_exact, T.StructType([T.StructField("u", NODE), T.StructField("v", NODE)]))


def _placed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members(band, key, root, main) with what nodes(key, ...) has; joined by node, of which each has 2 * BANDS places at most."""
    places = members.groupBy("key").agg(F.collect_list(F.struct("band", "root", "main")).alias("places"))
    own = [c for c in nodes.columns if c != "key"]
    return places.join(nodes, "key").select("key", *own, F.explode("places").alias("x")).select("x.band", "key", "x.root", "x.main", *own)


def _classes_of_texts(docs: DataFrame) -> DataFrame:
    """key, class_of_key and keeper of the texts that occur twice or have a near-duplicate. Stored.

    key is the MD5 of a text, class_of_key the smallest doc_id of its class (null if none has one), and keeper whether the
    text is the one of that id that stays.
    """
    with Tables(docs.sparkSession) as tables:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("key"), "text").where(F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
        sketches = tables.stored(_sketch(texts), "sketches")
        held = tables.stored(_held(sketches), "held")
        rows = held.select("key", "weight", F.explode("bands").alias("band"))
        buckets = rows.groupBy("band").agg(F.max(F.struct("weight", "key")).alias("top"), F.count("*").alias("size")).where("size > 1")
        led = tables.stored(rows.join(buckets, "band").select("band", "key", "weight", F.col("top.key").alias("leader"), F.col("top.weight").alias("leader_weight"), "size"), "led")
        pairs = tables.stored(led.where("key <> leader").select("key", "leader", "leader_weight").distinct(), "pairs")
        links = tables.stored(_verified(pairs, texts, tables), "verified", TEXT_ROWS)
        # nodes that are linked to the same leader are in one component; all that this spares is comparisons
        centres = links.groupBy("key").agg(F.max(F.struct("leader_weight", "leader"))["leader"].alias("root"))
        more = _in_blocks(led.where("size > 2").drop("size", "leader_weight"), sketches, centres, texts, tables)
        links = links.select(F.col("key").alias("u"), F.col("leader").alias("v"))
        if more is not None:
            links = links.union(tables.stored(more, "more", PAIR_ROWS))
        roots = components(links, tables).withColumnRenamed("node", "key")
        counted = texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        nodes = tables.stored(counted.join(roots, "key", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "key")), "nodes")
        first = nodes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")).select("root", F.col("x.doc_id").alias("class_of_key"), F.col("x.key").alias("first"))
        return tables.result(nodes.join(first, "root").select("key", "class_of_key", (F.col("key") == F.col("first")).alias("keeper")), "classes")


def _with_classes(docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose text is in named, with what named has on it; and all others. Only the former are dealt out."""
    bits, part, on = in_bitmap(named)
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select(row, F.unhex(F.md5("text")).alias("key")).join(bits, part == F.col("bits_part"), "left").withColumn("maybe", F.coalesce(on, F.lit(False)))
    found = keyed.where("maybe").select("row", "key").join(named, "key", "left")
    rest = keyed.where("not maybe").select("row.*")
    return found, rest


def classes(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the smallest doc_id of each row's class of near-duplicates, and that column's name (class_id).

    Texts are linked if the Jaccard similarity of their shingles, as sets or weighted by counts (probability Jaccard),
    is 0.8 or more; a class is a connected component. Words are runs of ASCII letters (case aside), digits and
    characters beyond ASCII. Equal texts are one class, whatever they hold, but for null texts and texts without a
    word: each of those rows is alone and keeps its own doc_id as class. Null ids count as absent: a class has the
    smallest id that is not null, else null. An empty table gives an empty table.
    """
    name = fresh(docs, "class_id")
    found, rest = _with_classes(docs, _classes_of_texts(docs))
    found = found.select("row.*", F.when(F.col("keeper").isNull(), F.col("row.doc_id").cast("long")).otherwise(F.col("class_of_key")).alias(name))
    return found.union(rest.withColumn(name, F.col("doc_id").cast("long"))), name


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id; of rows that repeat its id and text, one.

    Rows alone in their class, null texts and texts without a word stay as they are. In a class without any doc_id one row
    of the text whose MD5 is smallest stays. An empty table gives an empty table; columns pass through.
    """
    found, rest = _with_classes(docs, _classes_of_texts(docs))
    alone = found.where("keeper is null").select("row.*")
    # equal texts are in one task already, where they were joined by their key
    first = found.where(F.col("keeper") & F.col("row.doc_id").cast("long").eqNullSafe(F.col("class_of_key"))).dropDuplicates(["key"]).select("row.*")
    return rest.union(alone).union(first)
