"""Golden cases of the rules: what once went wrong and must not again."""

import numpy as np
import pytest

from docspark.functions import text as t
from docspark.operators import folds
from docspark.operators.translate import Echo, check_output, check_restored, translate


@pytest.fixture(scope="module")
def ask(spark):
    def value(function, text, *rest, **columns):
        row = spark.createDataFrame([(text, *columns.values())], ["t", *columns])
        return row.select(t.apply(function, "t", *columns, *rest)).first()[0]

    return value


def test_batch_parts():
    assert folds.split_batch("1. eins\n2. zwei", 2) == ["eins", "zwei"]
    assert folds.split_batch("1. eins\n2.", 2) is None and folds.split_batch("1. eins", 2) is None
    assert folds.split_batch("1. eins\nweiter\n2. zwei", 2) == ["eins weiter", "zwei"]
    assert folds.split_batch("2. zwei\n1. eins", 2) == ["eins", "zwei"]
    assert folds.split_batch("1. A\n1. B\n2. C", 2) == ["A B", "C"]


def test_numbers():
    assert check_restored("Two deals of $4,000,000 and $9,000,000 were closed.", "两笔交易总额为 400万 与 900万。") == []
    assert any(r.startswith("number-dropped") for r in check_restored("A ratio of 3.7 and 2.4 in zone 47 with group 12.", "该地区的比率优于千分比。"))
    assert any(r.startswith("number-dropped") for r in check_restored("Wait for 30 seconds and 5 tries.", "Wait for seconds and tries."))
    assert check_restored("Chapter 12 is about caches in some depth.", "第十二章讲解了缓存机制的细节。") == []


def test_tokens_and_leaks():
    assert check_output("keep §A§ and §B§", "§A§ 保留") == ["sentinel-lost:§B§"]
    assert check_output("none", "有 §A§") == ["sentinel-extra:§A§"] and check_output("§A§", "§A§ §A§") == ["sentinel-extra:§A§"]
    assert check_output("§A§", "保留 §A§") == [] and check_output("x", " ") == ["empty"]
    source = "A sentence that is long enough to want some translation work done."
    assert check_restored(source, "一句话还没有翻译完 §A§") == ["sentinel-leak"] and check_restored(source, source)[0] == "echo"


def test_garbage(ask):
    assert ask(t.garbage, "bad ������ text") and ask(t.garbage, " abc")
    assert not ask(t.garbage, "one � in a long line of otherwise clean words") and not ask(t.garbage, "   ")


def test_fragments():
    assert folds.join_fragments([("Big", 0, 20), ("Lake", 26, 24)], 10) == "Big Lake"
    assert folds.join_fragments([("Creat", 0, 40), ("ed", 41, 8)], 10) == "Created"
    assert folds.join_fragments([("Row ", 0, 30), ("s", 31, 4)], 10) == "Rows"
    assert folds.cells([("a", 0, 5), ("b", 6, 5), ("c", 60, 5)], 10) == [("ab", 0), ("c", 60)]


@pytest.mark.parametrize(("text", "y", "want"), [("16 | Chapter 1: Data", 42, True), ("数据|5", 40, True), ("16", 42, True), ("iv", 585, True), ("mill", 300, False), ("civic", 300, False), ("x is a | b here", 300, False), ("plain body text of a page", 30, False)])
def test_furniture(ask, text, y, want):
    assert ask(t.running_furniture, text, y=float(y), height=612.0) is want


def test_page_numbers(ask):
    for text in ("Civic center opens", "Mill lane", "the value was 3"):
        assert ask(t.strip_page_numbers, text) == text
    assert ask(t.strip_page_numbers, "xiv available for all") == "available for all" and ask(t.strip_page_numbers, "6 Leadership") == "Leadership"
    assert ask(t.strip_page_numbers, "b" * 70 + " words 6") == "b" * 70 + " words"


@pytest.mark.parametrize(("text", "size", "want"), [("%sql SELECT 1", 8.5, True), ("+----+----+ | a |", 8.5, True), ("scala> val x = 1", 8.5, True), ("/dbfs/mnt/lake/x", 8.5, True), ("A unified view of all the data.", 10.5, False), ("You should select what fits.", 10.5, False)])
def test_code(ask, text, size, want):
    assert ask(t.looks_like_code, text, "'F2'", str(size), "10.5", "false") is want


def test_lines_and_labels(ask, spark):
    joined = lambda lines: spark.createDataFrame([(lines,)], "x array<string>").select(t.apply(t.join_lines, "x")).first()[0]
    assert joined(["com-", "monly"]) == "commonly" and joined(["a lake", "house"]) == "a lake house" and joined(["well-", "Known"]) == "well- Known"
    assert ask(t.clean_translation, "译文：数据") == "数据" and ask(t.clean_translation, "Translation: a b") == "a b"
    assert ask(t.heading_number, "1212.1Overview") == "12.1Overview" and ask(t.expand_glossary, "an EM, EMs and THEME (EM)") == "an Engineering Manager (EM), Engineering Managers (EMs) and THEME (Engineering Manager (EM))"


def test_overlaps():
    same = [(79.9, 277.8, 344.6, 324.5, 216029.0), (79.9, 277.8, 344.6, 324.5, 121342.0)]
    assert folds.suppress(same) == [0] and folds.suppress([(50, 100, 100, 100, 1.0), (210, 100, 100, 100, 1.0)]) == [0, 1]
    assert folds.merge_boxes([(0, 0, 10, 10), (12, 0, 20, 10), (100, 0, 110, 10)]) == [(0, 0, 20, 10), (100, 0, 110, 10)]


def test_other_folds():
    assert folds.cluster([1, 2, 30, 31, 33, 62], 30) == [pytest.approx((1 + 2 + 30 + 31) / 4), pytest.approx((33 + 62) / 2)]
    masked, kept = folds.freeze("See https://a.b/c [1] and Figure 6.1 for $x+y$")
    assert masked == "See §A§ §B§ and §C§ for §D§" and folds.restore(masked, kept).endswith("$x+y$")
    assert folds.eta([(0, 0), (10, 10), (20, 20)])[-1] == pytest.approx(80) and folds.eta([(0, 10), (5, 10)]) == [None, None]
    assert folds.paginate([300, 300, 300], 700) == [0, 0, 1] and folds.wrap([("aa", True), ("bb", True), ("cc", False)], 10, 30) == ["aa bb", "cc"]
    assert folds.best_chain([(0, 0, 1.0), (0, 5, 3.0), (1, 1, 1.5), (2, 2, 1.0)]) == [(0, 0, 1.0), (1, 1, 1.5), (2, 2, 1.0)]
    assert folds.align(np.array([[0.9, 0.0], [0.0, 0.8]])) == [(0, 0, 0.9), (1, 1, 0.8)]
    assert folds.rejoin([("it goes", 1), ("on here.", 1), ("New", 1)]) == [("it goes on here.", 1), ("New", 1)]
    assert folds.placements([("save", ()), ("transform", (2, 0, 0, 3, 5, 7)), ("paint", "i"), ("restore", ()), ("paint", "j")]) == [("i", 5, 7, 2, 3), ("j", 0, 0, 1, 1)]
    assert folds.png_of_flate(b"x", 1, 1) is None and folds.notices("abcabcdef") == list("bcdef") and folds.ink_percent(np.zeros((1, 5, 3))) == 100.0


def test_best_chain_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        edges = sorted((int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, 9, 14), rng.integers(0, 9, 14), rng.integers(1, 9, 14), strict=True))
        best = [e[2] for e in edges]
        for k, e in enumerate(edges):
            best[k] += max([best[m] for m in range(k) if edges[m][0] < e[0] and edges[m][1] < e[1]], default=0)
        assert sum(e[2] for e in folds.best_chain(edges)) == max(best)


def test_translate(spark):
    class Upper:
        def translate(self, text):
            return "汉字译文内容" * (len(text) // 12) + text[text.find("§") : text.rfind("§") + 1]

    units = spark.createDataFrame([(1, "See [1] for a longer explanation of things."), (2, "See [1] for a longer explanation of things."), (3, "Some other sentence without tokens in it, which is long enough.")], "id long, source string")
    out = {r.id: r for r in translate(units, Upper).collect()}
    assert out[1].ok and out[1].text == out[2].text and "[1]" in out[1].text
    failed = {r.id: r for r in translate(units, Echo).collect()}
    assert not failed[3].ok and failed[3].text == failed[3].source and "echo" in failed[3].reasons
    cached = translate(units, Echo, cache=translate(units, Upper).select("key", "text").withColumnRenamed("text", "translated"))
    assert all(r.ok for r in cached.collect())
