"""Folds, validators and translators against plain loops that are written another way."""

import functools
import http.server
import itertools
import random
import threading
import time
import zlib

import numpy as np
import pytest

from docspark.operators import folds, translate
from docspark.operators.control import EnginePool, JobManager
from docspark.plans import catalog, translations
from docspark.plans import folds as plans
from docspark.sources import compose, download, files, logs, pdf

SF = "/root/testdata/sf0.001"


def view(spark, sql):
    return plans.view(spark, SF, sql)


def test_fragments_and_cells_are_those_of_the_plain_functions(spark):
    lines = view(spark, "select doc_id, seq, text, font_size, x from v_lines").collect()
    want, cells = {}, []
    for r in lines:
        parts = [(p, r.x + 30 * k + (40 if k % 7 == 3 else 0), 5.0 * len(p)) for k, p in enumerate(r.text.split(" "))]
        want[r.doc_id, r.seq] = folds.join_fragments(parts, r.font_size)
        cells += [(r.doc_id, r.seq, text, x) for text, x in folds.cells(parts, r.font_size)]
    assert {(r.doc_id, r.seq): r.line for r in plans.QUERIES["c01_join_fragments"](spark, SF).collect()} == want
    assert sorted(map(tuple, plans.QUERIES["f03_cells"](spark, SF).collect())) == sorted(cells)


def test_layout_and_jobs_are_those_of_the_plain_functions(spark):
    lines = view(spark, "select doc_id, seq, text, font_size from v_lines").orderBy("doc_id", "seq").collect()
    docs = {k: list(g) for k, g in itertools.groupby(lines, lambda r: r.doc_id)}
    wrapped = {k: sum(len(folds.wrap([(w, True) for w in r.text.split()], 10.0, 400.0)) for r in g) for k, g in docs.items()}
    assert {r.doc_id: r.lines for r in plans.QUERIES["f11_wrapped"](spark, SF).collect()} == wrapped
    pages = {k: max(folds.paginate([r.font_size * 1.6 for r in g], 700.0)) + 1 for k, g in docs.items()}
    assert {r.doc_id: r.pages for r in plans.QUERIES["f10_pages"](spark, SF).collect()} == pages
    events = view(spark, "select job_id, ts, seq, progress, status from v_job_events").orderBy("job_id", "ts", "seq").collect()
    etas, notices = {}, set()
    for job, g in itertools.groupby(events, lambda r: r.job_id):
        g = list(g)
        etas |= {(job, r.seq): e for r, e in zip(g, folds.eta([(r.ts.timestamp(), r.progress) for r in g]), strict=True)}
        notices |= {(job, k, x) for k, x in enumerate(folds.notices([r.status for r in g]))}
    got = {(r.job_id, r.seq): r.eta for r in plans.QUERIES["f14_eta"](spark, SF).collect()}
    assert got.keys() == etas.keys() and all((got[k] is None) == (etas[k] is None) and (got[k] is None or got[k] == pytest.approx(etas[k], abs=1e-3)) for k in got)
    assert {tuple(r) for r in plans.QUERIES["f21_notices"](spark, SF).collect()} == notices


def test_merged_boxes_are_components_that_do_not_touch():
    r = random.Random(3)
    for _ in range(40):
        boxes = [(x, y, x + r.randrange(1, 30), y + r.randrange(1, 30)) for x, y in ((r.randrange(200), r.randrange(200)) for _ in range(r.randrange(1, 14)))]
        apart = set(boxes)
        while True:  # any two that are near are one, until none is
            near = next(((a, b) for a, b in itertools.combinations(sorted(apart), 2) if a[0] <= b[2] + 6 and b[0] <= a[2] + 6 and a[1] <= b[3] + 6 and b[1] <= a[3] + 6), None)
            if near is None:
                break
            apart = apart - set(near) | {tuple(f(p) for f, p in zip((min, min, max, max), zip(*near, strict=True), strict=True))}
        assert folds.merge_boxes(boxes) == sorted(apart)


def test_alignment_has_the_best_score():
    rng = np.random.default_rng(5)
    for _ in range(25):
        s = rng.random((int(rng.integers(1, 6)), int(rng.integers(1, 6))))
        n, m = s.shape

        @functools.cache
        def best(i, j, s=s, n=n, m=m):
            if i == n or j == m:
                return -0.2 * (n - i + m - j)
            return max(s[i, j] + best(i + 1, j + 1), -0.2 + best(i + 1, j), -0.2 + best(i, j + 1))

        pairs = folds.align(s, least=-1.0)
        total = sum(x for _, _, x in pairs) - 0.2 * (n + m - 2 * len(pairs))
        assert total == pytest.approx(best(0, 0)) and all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(pairs))
        assert [p for p in pairs if p[2] >= 0.55] == folds.align(s)


def test_paragraphs_of_the_first_rules_and_of_cases():
    lines = [("A Title", 16.0, "F", 700.0), ("body of a text", 10.0, "F", 680.0), ("that goes on", 10.0, "F", 666.0), ("x = y;", 10.0, "Courier", 600.0)]
    assert folds.first_paragraphs(lines) == [("title", "A Title"), ("body", "body of a text that goes on"), ("code", "x = y;")]
    spans = [("one ", 700.0, 0.0, 10.0), ("two", 699.0, 30.0, 10.0), (" ", 690.0, 0.0, 10.0), ("three", 686.0, 0.0, 10.0), ("four", 660.0, 0.0, 10.0), ("five", 650.0, 0.0, 14.0)]
    assert folds.case_paragraphs(spans) == [("one two three", 2, 10.0), ("four", 1, 10.0), ("five", 1, 14.0)]


# --- Validation -----------------------------------------------------------------------------------------------------
CASES = [
    ("keep §A§ and §B§", "§A§ 保留", "keep x and y", "x 保留"), ("none", "有 §A§", "none", "有 §A§"), ("§A§", "§A§ §A§", "x", "x x"), ("§G§ and §Z§", "§Z§ §Q§", "g and z", "z q"), ("x", " ", "x", " "), ("x", "", "x", ""),
    ("a", "b", "Two deals of $4,000,000 and $9,000,000 were closed.", "两笔交易总额为 400万 与 900万。"), ("a", "b", "A ratio of 3.7 and 2.4 in zone 47 with group 12.", "该地区的比率优于千分比。"), ("a", "b", "Wait for 30 seconds and 5 tries.", "Wait for seconds and tries."),
    ("a", "b", "Chapter 12 is about caches in some depth.", "第十二章讲解了缓存机制的细节。"), ("a", "b", "A sentence that is long enough to want some translation work done.", "A sentence that is long enough to want some translation work done."),
    ("a", "b", "short", "x" * 40), ("a", "b", "long " * 40, "短"), ("a", "b", "text of some words", "译文 </think> 内容"), ("a", "b", "1 2 3 4 5 6 7", "七"), ("a", "b", "words " * 30, "Latin words that stay as they are in a long line of output " * 2),
]


def test_validator_is_that_of_the_translator(spark):
    r = random.Random(11)
    tokens = ["§A§", "§B§", "§K§", "§Z§", "1,000", "2.5", "42", "3000", "汉字", "内容", "万", "words", "more", "these", "Words", "5K", " ", "</think>", "\n", "."]
    made = ["".join(r.choice(tokens) + r.choice(["", " "]) for _ in range(r.randrange(14))) for _ in range(1200)]
    rows = CASES + [tuple(r.choice(made) for _ in range(4)) for _ in range(400)] + [(a, a, b, b) for a, b in zip(made[:60], made[60:120], strict=True)]
    df = spark.createDataFrame([(k, f"u{k}", k, None, 1, *x) for k, x in enumerate(rows)], "doc_id long, unit_id string, block_no long, item_no long, page long, masked string, raw string, full_source string, restored string")
    got = {x.doc_id: x.reasons for x in catalog.run("h05_all_reasons", spark, {"v_attempts": df}).collect()}
    spark.catalog.dropTempView("v_attempts")
    for k, (masked, raw, source, restored) in enumerate(rows):
        assert got[k] == ";".join(translate.check_output(masked, raw) + translate.check_restored(source, restored)), rows[k]


def test_batches_and_cells_fall_back(spark):
    class Careless(translations.Filler):
        def translate(self, text):
            return "" if "lose" in text and "\n" in text else super().translate(text)

    batches = spark.createDataFrame([("a", ["The first one of these texts.", "And a second text here."]), ("b", ["To lose a line of the text.", "And another of them here."]), ("c", ["Only one text for this."])], "batch string, sources array<string>")
    rows = {(r.batch, r.place): r for r in translate.translate_batches(batches, Careless).collect()}
    assert rows["a", 0].batched and rows["a", 1].ok and not rows["b", 0].batched and rows["b", 1].ok and not rows["c", 0].batched and len(rows) == 5
    tables = spark.createDataFrame([(1, ["Name", "x", " Value of it ", ""]), (2, ["to lose", "other"])], "id long, cells array<string>")
    cells = {r.id: r for r in translate.translate_cells(tables, Careless).collect()}
    assert cells[1].cells[1] == "x" and cells[1].cells[3] == "" and "译" in cells[1].cells[0] and (cells[1].batches, cells[1].alone) == (1, 0) and (cells[2].batches, cells[2].alone) == (0, 1)
    assert translate.numbered_cells("1. a\n1. b\nx\n3) c\n2.", 3) == {0: "b", 2: "c"}


@pytest.mark.parametrize("name", sorted(translations.QUERIES))
def test_translation_queries(spark, name):
    rows = translations.QUERIES[name](spark, SF).collect()
    assert rows
    if name == "j02_translations":
        assert 0 < sum(r.ok for r in rows) < len(rows) and all(r.ok == (r.reasons == "") for r in rows)
    if name == "j14_batches":
        assert any(r.batched for r in rows) and any(not r.batched for r in rows)


# --- Files, logs and control ----------------------------------------------------------------------------------------
def small_pdf():
    body = b"q 1 0 0 1 10 20 cm BT /F1 12 Tf 100 700 Td (Big \\(Lake\\)) Tj 0 -14 Td [(Second) -300 <6c696e65>] TJ ET Q q 50 0 0 40 72 300 cm /Im1 Do Q /Fm1 Do"
    pixels = zlib.compress(bytes(range(48)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /Im1 6 0 R /Fm1 7 0 R >> >> >>",
        b"<< /Length 8 0 R /Filter /FlateDecode >>\nstream\n" + zlib.compress(body) + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
        b"<< /Type /XObject /Subtype /Image /Width 4 /Height 4 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % len(pixels) + pixels + b"\nendstream",
        b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /Length 40 >>\nstream\nBT /F1 10 Tf 1 0 0 1 50 60 Tm (in form) Tj ET\nendstream", b"%d" % len(zlib.compress(body)),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, x) for k, x in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


def test_pdf_items_and_images(spark, tmp_path):
    items = list(pdf.parse(small_pdf()))
    assert [(i[2], i[3], i[4], i[6], i[7]) for i in items] == [("Big (Lake)", 110.0, 720.0, 12.0, "Courier"), ("Second", 110.0, 706.0, 12.0, "Courier"), ("line", pytest.approx(110 + 36 + 3.6), 706.0, 12.0, "Courier"), ("in form", 55.0, 65.0, 10.0, "Courier")]
    (page, name, x, y, w, h, kind, content), = pdf.images(small_pdf())
    assert (page, name, x, y, w, h, kind) == (1, "Im1", 72, 300, 50, 40, "png") and content[:4] == b"\x89PNG"
    (tmp_path / "a.pdf").write_bytes(small_pdf())
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    rows = files.read_items(spark, str(tmp_path), lambda: pdf.parse, page_limit=1).collect()
    assert sorted(r.str for r in rows if r.str) == ["Big (Lake)", "Second", "in form", "line"]
    assert files.read_images(spark, str(tmp_path), lambda: pdf.images).where("kind = 'png'").count() == 1


def test_stale_logs_are_kept_apart(spark, tmp_path):
    for version in (3, 4):
        logs.append_results(spark.createDataFrame([(f"b{version}", "z")], "unit_id string, text string"), str(tmp_path / "log"), version)
    assert logs.archive_stale(spark, str(tmp_path / "log"), 4) == ["capture_version=3.stale"] and logs.archive_stale(spark, str(tmp_path / "log"), 4) == []
    assert [r.unit_id for r in logs.read_results(spark, str(tmp_path / "log" / "capture_version=4")).collect()] == ["b4"]
    assert logs.archive_stale(spark, str(tmp_path / "none"), 4) == []


def test_saves_are_coalesced(tmp_path):
    seen = []
    saver = logs.Debounced(lambda: seen.append(1), 0.05)
    for _ in range(20):
        saver.touch()
    assert seen == []
    time.sleep(0.3)
    assert seen == [1]
    saver.touch()
    saver.flush()
    saver.flush()
    assert seen == [1, 1]
    manager = JobManager(str(tmp_path), lambda job, report: None)
    manager.add("a", "x")
    manager.flush()
    assert list(logs.load_snapshot(str(tmp_path / "jobs.json"))) == ["a"]
    (tmp_path / "out").write_text("x")
    assert logs.assert_written(str(tmp_path / "out")) == 1
    with pytest.raises(OSError, match="no output"):
        logs.assert_written(str(tmp_path / "missing"))


def test_one_engine_at_a_time():
    made, closed = [], []
    pool = EnginePool(lambda *key: made.append(key) or key, closed.append)
    assert pool.get("m", "gpu", 4) is pool.get("m", "gpu", 4) and pool.get("m", "cpu", 4) == ("m", "cpu", 4)
    pool.release()
    assert made == [("m", "gpu", 4), ("m", "cpu", 4)] == closed


def test_flate_png_is_the_pixels():
    rows = bytes(range(48))
    png = folds.png_of_flate(zlib.compress(rows), 4, 4)
    data = png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8]
    raw = zlib.decompress(data)
    assert b"".join(raw[k * 13 + 1 : k * 13 + 13] for k in range(4)) == rows


def test_composed_pages_are_read_again():
    page = compose.Composer()
    page.block("heading", 1, "Chapter (one)")
    page.block("paragraph", 0, "Some words of a paragraph 和一些中文 that goes on. " * 60)
    page.block("list-item", 0, "", ["first", "second"])
    page.block("code", 0, "def f(x):\n    return x")
    page.block("table", 0, "", cells=[["Name", "Value"]] + [[f"row {k}", "words of a cell " * 4] for k in range(30)])
    data = page.bytes()
    items = list(pdf.parse(data))
    text = " ".join(i[2] for i in items)
    assert compose.is_pdf(data) and not compose.is_pdf(data[:-30]) and len(page.pages) > 2
    assert "Chapter (one)" in text and text.count("paragraph") == 60 and text.replace(" ", "").count("一些中文") == 60 and "def f(x):" in text and "second" in text
    assert sum(i[2] == "Name" for i in items) == len({i[0] for i in items if i[2].startswith("row ")})
    assert all(compose.MARGIN - 1 <= i[4] <= compose.HEIGHT - compose.MARGIN for i in items)


def test_long_texts_are_split():
    seen = []

    class Noted:
        def translate(self, text):
            seen.append(text)
            return text.upper()

    text = " ".join(f"Sentence number {k} of a long text." for k in range(400))
    assert translate.Splitting(Noted()).translate(text) == text.upper()
    assert len(seen) > 2 and all(len(x) // 3 <= 1800 for x in seen) and all(x.endswith(".") for x in seen)


def test_download_goes_on_and_promotes(tmp_path):
    data, asked = bytes(range(256)) * 40, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers.get("Range"))
            start = int(asked[-1][6:-1]) if asked[-1] and "whole" not in self.path else 0
            if start >= len(data):
                self.send_error(416)
                return
            self.send_response(206 if start else 200)
            if start:
                self.send_header("Content-Range", f"bytes {start}-{len(data) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(data) - start))
            self.end_headers()
            self.wfile.write(data[start:])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        for k, (path, before) in enumerate((("/a", data[:1000]), ("/whole", data[:1000]), ("/b", data + b"more"))):
            target = tmp_path / f"f{k}"
            (tmp_path / f"f{k}.part").write_bytes(before)
            assert download.download(base + path, str(target), least=10) == len(data) and target.read_bytes() == data
        assert asked[0] == "bytes=1000-" and download.download(base + "/a", str(tmp_path / "f0"), least=10) == len(data)
        with pytest.raises(OSError, match="bytes of"):
            download.download(base + "/a", str(tmp_path / "g"), least=10**6)
        seen = []
        models = download.Models(str(tmp_path / "m"), {"x": base + "/x", "y": base + "/y"}, lambda *a: seen.append(a), least=10)
        with pytest.raises(download.Canceled):
            models.fetch("x", stop=lambda: True)
        models.fetch("x")
        models.fetch("y")
        assert models.default == "x" and models.status("y") == "available" and seen[-1] == ("y", "available", 100.0)
        models.remove("x")
        assert models.default == "y" and models.status("x") == "not-downloaded"
        with pytest.raises(ValueError, match="not available"):
            models.set_default("x")
    finally:
        server.shutdown()
