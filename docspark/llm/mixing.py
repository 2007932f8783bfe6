"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the whole by weight, at most MOST times its size; what is cut off is shared by weight
among the others. A document expects c * w copies, w being the weight of its size class and c the source's factor, at
which the expected words meet the target; no document gets more than MOST copies. The whole part of the expectation is
allocated for certain. The rest p is its inclusion odds in a sample of fixed size, counted in words: documents are
ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first in that order are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import Tables, fresh, stored

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: A document of 2**k words or more, up to the next power of two, is in class k; those of small classes weigh less.
CLASS_WEIGHTS = (0.25, 0.5, 0.5, 0.75, 0.75)
#: A source's ranks are summed up in slots of the logarithm of the odds, so many for each unit and so many in all, and those
#: of the slot where the wanted words are reached in so many finer ones; only rows of one of these are put in order.
SLOTS_PER_UNIT, SLOTS, FINE = 8, 8 * 160, 4096
#: Tables of sources with names of up to so many bytes, and up to so many rows, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 100_000


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(0).cast("int")


def class_weight(k: Column) -> Column:
    out = F.lit(1.0)
    for i, w in reversed(list(enumerate(CLASS_WEIGHTS))):
        out = F.when(k == i, w).otherwise(out)
    return out


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts), F.lit(SEED))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / 4503599627370496.0


def numbered(df: DataFrame, order: Column, tables: Tables) -> DataFrame:
    """df with its rows' places from 0 in an order (place). Tasks have ranges of it, and the driver their numbers of rows."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    parts = tables.stored(parts, "places")
    before, total = {}, 0
    for r in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task
        before[r.part] = total
        total += r.n
    first = F.element_at(F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values()))), F.col("part")) if before else F.lit(0)
    return parts.withColumn("place", (first + F.col("at")).cast("long")).drop("part", "at")


def targets(sizes: DataFrame, tables: Tables, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """For sizes(source, source_size): the target of each source.

    Words are shared at a level by weight. A source whose cap is under its share stops at it, which raises the level for
    the others; so rounds of sums over all sources follow until no further source stops. No task sees all sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    out = numbered(sizes, F.col("source").asc_nulls_last(), tables).withColumn("weight", weight).drop("place")
    out = tables.stored(out.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("fill", F.col("cap") / F.col("weight")), "weights")
    level, stopped = 0.0, -1
    while True:
        full = F.col("fill") < level
        zero = F.lit(0.0)
        r = out.agg(F.count(F.when(full, 1)).alias("n"), F.count("*").alias("all"), F.sum("source_size").cast("double").alias("words"), F.coalesce(F.sum(F.when(full, F.col("cap"))), zero).alias("capped"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), zero).alias("open")).first()
        if r.n == stopped or r.n == r["all"]:
            break
        stopped, level = r.n, (share * r.words - r.capped) / r.open
    level = float("inf") if r.n == r["all"] else level
    return out.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def factors(classes: DataFrame, most: int = MOST) -> DataFrame:
    """For classes(source, k, words) with the source's target: the factor of each source.

    c is where sum(words * min(most, c * w)) meets the target. Classes of larger weight reach `most` at smaller c.
    """
    classes = classes.groupBy("source", "target", class_weight(F.col("k")).alias("w")).agg(F.sum("words").cast("double").alias("words"))
    above = Window.partitionBy("source").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.desc("w")).rowsBetween(0, Window.unboundedFollowing)
    out = classes.withColumns({"full": F.coalesce(F.sum("words").over(above), F.lit(0.0)), "open": F.sum(F.col("words") * F.col("w")).over(below)})
    out = out.withColumn("c", (F.col("target") - most * F.col("full")) / F.nullif("open", F.lit(0.0)))
    return out.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("c") * F.col("w") <= most, F.col("c"))), F.lit(float("inf"))).alias("c"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of a stored table, by source; null matches null."""
    named = sources.withColumnRenamed("source", "named")
    size = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    if size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        named = F.broadcast(named)
    return rows.join(named, rows.source.eqNullSafe(F.col("named")), "left").drop("named")


def _reached(slots: DataFrame, slot: str) -> DataFrame:
    """For slots(source, <slot>, words, want, before): the slot of each source where the wanted words are reached, and the words before it."""
    below = Window.partitionBy("source").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(below), F.lit(0)))
    return slots.where("before < want and before + words >= want").select("source", F.col(slot).alias(f"{slot}_cut"), F.col("before").alias(f"{slot}_before"))


def _allocation(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows of (doc_id, source, text_key, size); and each source's target, factor, wanted words and where they are reached."""
    slim = stored(sized(docs).select("doc_id", "source", "text_key", "size"), "sizes")
    classes = tables.stored(slim.groupBy("source", size_class(F.col("size")).alias("k")).agg(F.sum("size").alias("words")), "classes")
    sources = tables.stored(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), tables), "targets")
    factor = factors(_with_sources(classes, sources.select("source", "target")))
    sources = tables.stored(_with_sources(factor, sources), "factors")
    slots = ranked(slim, sources).groupBy("source", "slot").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("whole_words"), F.max("target").alias("target"))
    slots = tables.stored(slots, "slots")
    want = slots.groupBy("source").agg((F.max("target") - F.sum("whole_words")).alias("want"))
    sources = tables.stored(_with_sources(want, sources), "wants")
    slots = _with_sources(slots.where("slot is not null").select("source", "slot", "words"), sources.select("source", "want")).withColumn("before", F.lit(0).cast("long"))
    # in all slots but the one where the wanted words are reached, the choice is the same for each row
    sources = _with_sources(sources, tables.stored(_reached(slots, "slot"), "cuts")).withColumn("slot_cut", F.coalesce("slot_cut", F.when(F.col("want") <= 0, -1).otherwise(SLOTS)))
    sources = tables.stored(sources, "cut")
    fine = ranked(slim, sources).where("slot = slot_cut").groupBy("source", "fine").agg(F.sum("size").alias("words"), F.max("want").alias("want"), F.max("slot_before").alias("before"))
    return slim, stored(_with_sources(sources, tables.stored(_reached(fine, "fine"), "fine-cuts")), "sources")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text_key": F.md5(F.coalesce("text", F.lit(""))), "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})


def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with what their source has, their certain copies (whole), their odds, and the slots of these."""
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(MOST)), F.col("c") * class_weight(size_class(F.col("size"))))).otherwise(0.0)
    rows = _with_sources(rows, sources).withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    u = uniform(F.col("doc_id"), F.col("text_key"))
    rows = rows.withColumn("odds", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    scale = (F.ln("odds") + 80) * SLOTS_PER_UNIT
    return rows.withColumns({"slot": F.floor(scale).cast("int"), "fine": F.floor((scale - F.floor(scale)) * FINE).cast("int")})


def _decided(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Ranked rows with whether the sample takes them (more). near tells of the rows of the fine slot where a source's words are reached.

    Of equal rows (doc_id, source and text) there, as many are taken as the wanted words hold; which ones does not matter.
    """
    keys = ("doc_id", "source", "text_key")
    here = F.coalesce((F.col("slot") == F.col("slot_cut")) & (F.col("fine") == F.col("fine_cut")), F.lit(False))
    before = F.coalesce((F.col("slot") < F.col("slot_cut")) | ((F.col("slot") == F.col("slot_cut")) & (F.col("fine") < F.col("fine_cut"))), F.lit(False))
    named = near.withColumnsRenamed({k: f"near_{k}" for k in keys})
    match = lambda df: df.doc_id.eqNullSafe(F.col("near_doc_id")) & df.source.eqNullSafe(F.col("near_source")) & (df.text_key == F.col("near_text_key"))
    if near.count() <= BROADCAST_ROWS:  # about a row for each source
        rows = rows.join(F.broadcast(named), match(rows), "left")
    else:
        close = rows.where(here)
        rows = close.join(named, match(close), "left").unionByName(rows.where(~here), allowMissingColumns=True)
    rows = rows.drop(*(f"near_{k}" for k in keys))
    plain = F.when(here, F.coalesce(F.col("takes") > 0, F.lit(False))).otherwise(before).cast("long")
    if near.where("takes > 0 and takes < many").isEmpty():
        return rows.withColumn("more", plain).drop("takes", "many")
    partly = here & F.coalesce((F.col("takes") > 0) & (F.col("takes") < F.col("many")), F.lit(False))
    # equal rows of which some are taken: numbered within each task that has some, then over tasks
    some = stored(rows.where(partly).withColumn("part", F.spark_partition_id()), "equal")
    counts = some.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    counts = counts.withColumnsRenamed({k: f"near_{k}" for k in (*keys, "part")})
    some = some.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.lit(1))))
    some = some.join(counts, match(some) & (some.part == F.col("near_part")))
    some = some.withColumn("more", (F.col("ahead") + F.col("number") <= F.col("takes")).cast("long")).drop("takes", "many", "part", "number", "ahead", *(f"near_{k}" for k in (*keys, "part")))
    return rows.where(~partly).withColumn("more", plain).drop("takes", "many").unionByName(some)


def _near(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """Of the rows of the fine slots where words are reached, each kind (doc_id, source, text_key), its number of rows and how many are taken."""
    kinds = ranked(slim, sources).where("slot = slot_cut and fine = fine_cut").groupBy("doc_id", "source", "text_key").agg(F.count("*").alias("many"), *(F.max(c).alias(c) for c in ("size", "odds", "want", "fine_before")))
    order = Window.partitionBy("source").orderBy("odds", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("ahead", F.col("fine_before") + F.coalesce(F.sum(F.col("size") * F.col("many")).over(order), F.lit(0)))
    first = F.col("ahead") + F.col("size") / 2.0 <= F.col("want")
    takes = F.least(F.col("many"), F.floor((F.col("want") - F.col("ahead") - F.col("size") / 2.0) / F.col("size")) + 1)
    return kinds.select("doc_id", "source", "text_key", "many", F.when(first, F.greatest(takes, F.lit(1))).otherwise(0).cast("long").alias("takes"))


def allocate(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, copies and taken of each row of docs.

    size counts the words of the whole text; a null text has none and gets no copies. A null source is a source of its
    own, after all others. Rows that repeat doc_id, source and text rank together, and as many of them are taken as the
    wanted words hold, no matter which. An empty table gives an empty table. Other columns are not read.
    """
    with Tables(docs.sparkSession) as tables:
        slim, sources = _allocation(docs, tables)
        out = _decided(ranked(slim, sources), stored(_near(slim, sources), "near")).withColumn("copies", F.col("whole") + F.col("more"))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with the number of copies of each (copies; _copies if docs has that).

    Copies are those of allocate(), row by row. Texts are not moved: a row's copies follow from its own columns and its
    source's; only for the few rows of the slot where a source's words are reached is the choice looked up.
    """
    name, row = fresh(docs, "copies"), fresh(docs, "whole_row")
    with Tables(docs.sparkSession) as tables:
        slim, sources = _allocation(docs, tables)
        inner = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", "text")
        rows = _decided(ranked(sized(inner).drop("text"), sources), stored(_near(slim, sources), "near"))
    return rows.withColumn("all_copies", F.col("whole") + F.col("more")).where("all_copies > 0").select(f"{row}.*", F.col("all_copies").alias(name))
