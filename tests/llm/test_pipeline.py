import os

from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import decontamination, minhash, toxicity
from docspark.llm.common import shared_dir
from tests.llm.conftest import LONG, SF
from tests.llm.test_operators import plain_classes, plain_secrets


def test_stages_take_effect_and_chain(spark, docs, labels):
    model = toxicity.train(docs, labels)
    score = model.scorer()
    rows = {r.doc_id: r.text for r in docs.collect()}
    civil = {k: t for k, t in rows.items() if score([t.encode()])[0] < 0.5}
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(civil)
    out = corpus_pipeline.drop_near_duplicates(spark, out, SF)
    leaders = {k for k, c in plain_classes(civil).items() if k == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == leaders
    out = corpus_pipeline.drop_contaminated(spark, out, SF)
    hit = decontamination.scan(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet"))[0].where(F.size("hits") > 0)
    clean = leaders - {r.doc_id for r in hit.collect()}
    assert {r.doc_id for r in out.collect()} == clean
    out = corpus_pipeline.redact_secrets(spark, out, SF)
    after = {r.doc_id: r for r in out.collect()}
    assert set(after) == clean and out.columns == docs.columns
    assert all(plain_secrets(r.text) == [] and r.n_chars == len(r.text) for r in after.values())
    assert all(after[k].text == rows[k] for k in clean if not plain_secrets(rows[k]) and "=" not in rows[k])
    mixed = {r.doc_id: r.copies for r in corpus_pipeline.mix_sources(spark, out, SF).collect()}
    assert set(mixed) <= clean and set(mixed.values()) <= {1, 2}
    assert {r.doc_id: r.copies for r in corpus_pipeline.run(spark, SF).collect()} == mixed


def test_stages_on_odd_rows(spark, odd, nothing):
    rows = [tuple(r) for r in odd.collect()]
    stages = dict(corpus_pipeline.STAGES)
    got = {name: stage(spark, odd, SF) for name, stage in stages.items()}
    assert all(out.columns == odd.columns for name, out in got.items() if name != "mixing") and got["mixing"].columns == [*odd.columns, "copies"]
    same = lambda out, want: sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    # nothing in these rows is toxic; what the benchmark holds is not in them
    assert same(got["toxicity"], rows) and same(got["decontamination"], rows)
    kept = [tuple(r) for r in got["near_dedup"].collect()]
    assert set(kept) <= set(rows) and sum(r[1] == LONG for r in kept) == 1 and sum(r[1] is None for r in kept) == 2 and {r[1] for r in kept} >= {"", " \n\t ", "###", "one", "é"}
    clean = {(r.doc_id, r.text) for r in got["secrets"].collect()}
    assert got["secrets"].count() == len(rows) and (10, "[redacted]' [redacted] [redacted]") in clean and all(plain_secrets(t or "") == [] for _, t in clean)
    assert {t for k, t in clean if k == 6} == {LONG} and (0, None) in clean
    mixed = [r for r in got["mixing"].collect()]
    assert mixed and {r.copies for r in mixed} <= {1, 2} and all((r.text or "").split() for r in mixed)
    for name, stage in stages.items():
        assert stage(spark, nothing, SF).collect() == [], name


def test_intermediate_tables_go(spark, docs):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    minhash.classes(docs)[0].count()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left == {"classes"}
