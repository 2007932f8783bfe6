"""Near-duplicates whose shingles are alike as sets, but not in how often they occur."""

import random

import numpy as np
import pyarrow as pa

from docspark.llm import minhash
from docspark.llm.common import in_bitmap, words_of


def copies(seed, times):
    """A text of 150 words and a line of 12, so many times."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    text, line = " ".join(word() for _ in range(150)), " ".join(word() for _ in range(12))
    return [f"{text}\n" + "\n".join([line] * n) for n in times]


def test_links_of_sets_have_candidates(spark):
    times = [1, 12, 40]
    owner, h, count = minhash.shingles(words_of([x.encode() for x in copies(0, times)]))
    own = lambda t: (h[owner == t], count[owner == t])
    jaccard, probability = minhash.similarities(own(0), own(2))
    assert jaccard >= 0.8 and probability < 0.4
    rows = [(10 * k + i, text) for k in range(12) for i, text in enumerate(copies(k, times))]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert all(r.class_id == r.doc_id // 10 * 10 for r in got)


def test_blocks_screen_by_sets_too(spark):
    texts = copies(1, [1, 12, 40]) + copies(2, [1])
    bands, sketches = minhash._signed([t.encode() for t in texts])
    side = pa.array([{"sketch": x, "bands": b} for x, b in zip(sketches, bands, strict=True)])
    roots = np.arange(len(texts))
    met = []
    for band in {b for x in bands for b in x}:
        i, j = minhash._near([side, side], [roots, roots], band)
        met += list(zip(i.tolist(), j.tolist(), strict=True))
    # each pair of the first three in one bucket only, in both orders
    assert sorted(met) == [(i, j) for i in range(3) for j in range(3) if i != j]


def test_shared_rows_of_any_cut_into_tasks_and_batches():
    r = random.Random(5)
    for _ in range(200):
        rows = sorted((r.randrange(12), bytes([r.randrange(3)]) * 16) for _ in range(r.randrange(1, 40)))
        cuts = sorted(r.randrange(len(rows) + 1) for _ in range(r.randrange(4)))
        got = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            task = rows[lo:hi]
            inner = sorted(r.randrange(len(task) + 1) for _ in range(r.randrange(5)))
            batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in x], pa.int64()), pa.array([k for _, k in x], pa.binary())], ["band", "key"]) for x in (task[i:j] for i, j in zip([0, *inner], [*inner, len(task)], strict=True))]
            out = [(b, k) for x in minhash._shared_rows(batches) for b, k in zip(*(c.to_pylist() for c in x.columns[:2]), strict=True)]
            assert len(out) == len(set(out)) and set(out) <= set(task)
            got += out
        keys = {b: {k for x, k in rows if x == b} for b, _ in rows}
        many = {(b, k) for b, own in keys.items() if len(own) > 1 for k in own}
        assert many <= set(got)
        if not cuts:
            edges = {rows[0][0], rows[-1][0]}
            assert set(got) == {(b, k) for b, k in rows if (b, k) in many or b in edges}


def test_bitmap_keeps_what_it_has(spark):
    keys = spark.range(5000).selectExpr("unhex(md5(cast(id as string))) as key")
    some = spark.range(0, 5000, 7).selectExpr("unhex(md5(cast(id as string))) as key")
    bits, part, on = in_bitmap(some)
    let = keys.join(bits, (part == bits.bits_part) & on)
    assert 715 <= let.count() < 760
    assert 715 <= minhash._among(keys.union(keys), some).count() < 760
