"""Predicates and rewrites of lines and paragraphs, as SQL expressions over a text column.

Each function takes a dialect and the SQL of its inputs and gives SQL. `apply` gives Spark columns. None needs a UDF,
so they stay inside whole-stage code generation, and filters that use them are pushed to where their columns arise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.dialect import SPARK, Spark

# What the patterns and limits of the original behaviour are.
BULLET = "•●▪◦■"
GLYPHS = "•▪■□●◦☐☒▸▹"
LIST_NUMBERED = r"^\s*(?:\([0-9]+(?:\.[0-9]+)*\)|[0-9]+(?:\.[0-9]+)*[.)]\s+|[a-zA-Z][.)]\s+)"
LIST_BULLET = r"^\s*[•●▪◦■*\-–—―·]\s*"
BULLET_ONLY = r"^\s*[•●▪◦■*\-–—―·]+\s*\z"
SECTION_HEADING = r"^[0-9]+(?:\.[0-9]+)+\s*[A-Z]"
ASCII_DUMP = r"^\s*[+][-+=|]{3,}|^\s*[|][-+=| ]{3,}\s*[|]"
MAGIC_CELL = r"(?i)^\s*%\s*(?:sql|python|pyspark|scala|r|md|sh|bash|run)(?:[^A-Za-z0-9_]|\z)"
REPL_PROMPT = r"(?i)^\s*(?:scala|python|py|spark|sql|jupyter|in|out)\s*(?:\[[0-9]*\])?\s*>"
PATH_LINE = r"^\s*[~.]?/[A-Za-z0-9_./@+-]{4,}\s*\z"
MONO_FONT = r"(?i)Courier|Consolas|Menlo|Monaco|monospace|Code[0-9]*\z"
CODE_SYMBOL = r"[{};=\[\]<>|+%#]|=>|::|//|->|--"
SQL_WORD = r"(?i)(?:^|[^A-Za-z0-9_])(?:SELECT|FROM|WHERE|INSERT|INTO|CREATE|DROP|ALTER|MERGE|UPDATE|DELETE|GROUP BY|ORDER BY)(?:[^A-Za-z0-9_]|\z)"
PYTHON_LINE = r"^\s*(?:import |from \S+ import|def [A-Za-z0-9_]+\(|print\(|return |class [A-Za-z0-9_]+)"
FORMULA_SYMBOL = r"[∑∫√∞≈≠≤≥±×÷∂∆∏]"
CODE_FONT_RATIO = 0.86
CJK_WIDE = "⺀-⻿⼀-⿟　-〿一-鿿가-힯\uf900-\ufaff︰-﹏＀-￯"
HAN = "㐀-䶿一-鿿\uf900-\ufaff"
GARBAGE = "[\ufffd\ue000-\uf8ff\ufff0-\uffff]"
GLOSSARY = {
    "EM": "Engineering Manager (EM)", "EMs": "Engineering Managers (EMs)", "IC": "Individual Contributor (IC)", "ICs": "Individual Contributors (ICs)",
    "VP": "Vice President (VP)", "OKR": "Objectives and Key Results (OKR)", "OKRs": "Objectives and Key Results (OKRs)", "KPI": "Key Performance Indicator (KPI)",
    "KPIs": "Key Performance Indicators (KPIs)", "ROI": "Return on Investment (ROI)", "SRE": "Site Reliability Engineer (SRE)", "SREs": "Site Reliability Engineers (SREs)",
    "PR": "Pull Request (PR)", "PRs": "Pull Requests (PRs)", "CI": "Continuous Integration (CI)", "CD": "Continuous Deployment (CD)",
}
MAGNITUDE, MARKER_LEAK = r"万|亿|千|[KMBT](?:[^A-Za-z0-9_]|\z)|百分", r"(?i)</?think|<system|assistant:|```|\x22schema_version\x22"
#: SQL strings.
EMPTY, SPACE, COMMA, SEMICOLON, EMPTY_REASON, QUOTE = "''", "' '", "','", "';'", "'empty'", "'"
NUMBER, LATIN_WORD = r"[0-9]+(?:[.,][0-9]+)*", r"[A-Za-z][A-Za-z\x27’-]{3,}"


def trim(d: Spark, t: str) -> str:
    return d.sub(t, r"^\s+|\s+\z")


def collapse(d: Spark, t: str) -> str:
    return trim(d, d.sub(t, r"\s+", " "))


def near_edge(d: Spark, y: str, height: str, band: str) -> str:
    return f"({y} <= {height} * {band} or {y} >= {height} * (1 - {band}))"


def header_band(d: Spark, y: str, height: str) -> str:
    return f"({y} >= {height} * 0.91)"


def footer_band(d: Spark, y: str, height: str) -> str:
    return f"({y} <= {height} * 0.09)"


def running_furniture(d: Spark, t: str, y: str, height: str, band: str = "0.12") -> str:
    shape = " or ".join(d.like(trim(d, t), p) for p in (r"^[0-9]{1,4}\s*\|\s*\S", r"\S\s*\|\s*[0-9]{1,4}\z", r"^[0-9]{1,4}\z", r"(?i)^[ivxlcdm]{1,7}\z"))
    return f"({near_edge(d, y, height, band)} and ({shape}))"


def toc_title(d: Spark, t: str) -> str:
    return d.like(trim(d, t), r"(?i)^(?:brief\s+contents|contents|table\s+of\s+contents)\s*\z")


def toc_entry(d: Spark, t: str) -> str:
    s = trim(d, t)
    shapes = (r"\.{3,}\s*[0-9]+\s*\z", r"^\s*[0-9]+(?:\.[0-9]+){0,2}\s*[A-Z\x22\x27]", r"[A-Za-z)\]\x27\x22]\s*[0-9]{1,3}\s*\z")
    return f"({d.length(s)} between 1 and 140 and ({' or '.join(d.like(s, p) for p in shapes)}))"


def roman(d: Spark, t: str) -> str:
    u = f"upper({t})"
    return f"({d.like(u, r'^[MDCLXVI]{2,7}\z')} and {d.like(u, r'^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\z')})"


def strip_page_numbers(d: Spark, t: str) -> str:
    s = trim(d, t)
    lead = d.ext(s, r"^([MDCLXVImdclxvi]{2,7})\s+", 1)
    s = f"(case when {lead} <> '' and {roman(d, lead)} then {d.sub(s, r'^[MDCLXVImdclxvi]{2,7}\s+')} else {s} end)"
    s = d.sub(s, r"^[0-9]{1,3}\s+([A-Z])", "\\1")
    return trim(d, f"(case when {d.length(s)} > 60 then {d.sub(s, r'\s+[0-9]{1,3}\s*\z')} else {s} end)")


def heading_number(d: Spark, t: str) -> str:
    p = r"^([0-9]{1,2})([0-9]{1,2}\.[0-9]+(?:\.[0-9]+)?)([A-Z])"
    a, b = d.ext(t, p, 1), d.ext(t, p, 2)
    return f"(case when {a} <> '' and {d.starts(b, a)} then {d.sub(t, p, r'\2\3')} else {t} end)"


def empty_furniture(d: Spark, t: str) -> str:
    return f"(not {d.like(t, '[A-Za-z0-9]')})"


def split_heading(d: Spark, t: str, part: str) -> str:
    """part: heading, body or level; null where the text is not a heading glued to a body."""
    p = r"^([0-9]+(?:\.[0-9]+)+\s*[A-Z][^.]*?)([.:]\s|\z)"
    head, rest = trim(d, d.ext(t, p, 1)), trim(d, d.sub(t, p))
    value = {"heading": head, "body": rest, "level": f"(case when {d.count(head, '[.]')} >= 3 then 3 else 2 end)"}[part]
    return f"(case when {d.like(t, p)} and {d.length(head)} <= 80 and {rest} <> '' then {value} end)"


def code_symbols(d: Spark, t: str) -> str:
    return d.count(t, CODE_SYMBOL)


def looks_like_code(d: Spark, t: str, font: str, size: str, body: str, code_font: str) -> str:
    n = code_symbols(d, t)
    dense = f"({d.length(t)} > 30 and {n} >= 3 and {n} > {d.length(t)} / 12.0)"
    small = f"({size} > 0 and {size} <= {body} * {CODE_FONT_RATIO})"
    lang = f"({small} and ({d.like(t, SQL_WORD)} or {d.like(t, PYTHON_LINE)} or {n} >= 2))"
    return "(" + " or ".join([d.like(font, MONO_FONT), code_font, dense, *(d.like(t, p) for p in (MAGIC_CELL, ASCII_DUMP, REPL_PROMPT, PATH_LINE)), lang]) + ")"


def definitive_code(d: Spark, t: str) -> str:
    return "(" + " or ".join(d.like(t, p) for p in (MAGIC_CELL, ASCII_DUMP, REPL_PROMPT)) + ")"


def clean_translation(d: Spark, t: str) -> str:
    return trim(d, d.sub(t, r"(?i)^\s*(?:译文|翻译|中文翻译|Translation|Translated)\s*[:：]\s*"))


def heading_level(d: Spark, size: str, body: str) -> str:
    r = f"({size} / cast({body} as double))"
    return f"(case when {r} >= 1.6 then 1 when {r} >= 1.35 then 2 when {r} >= 1.2 then 3 when {r} > 1.08 then 4 else 0 end)"


def formula(d: Spark, t: str) -> str:
    s, n = trim(d, t), d.count(trim(d, t), FORMULA_SYMBOL)
    return f"({d.length(s)} > 5 and {n} >= 2 and {n} > 0.08 * {d.length(s)})"


def list_item(d: Spark, t: str) -> str:
    return f"({d.like(t, LIST_NUMBERED)} or {d.like(t, LIST_BULLET)})"


def classify(d: Spark, t: str, font: str, size: str, body: str, code_font: str) -> str:
    """The first that holds: formula, code, list-item, heading by number, heading by size; else body."""
    s = trim(d, t)
    return (
        f"(case when {s} = '' then 'body' when {formula(d, t)} then 'formula' when {looks_like_code(d, s, font, size, body, code_font)} then 'code' when {list_item(d, s)} then 'list-item' "
        f"when {d.like(s, SECTION_HEADING)} and {d.length(s)} <= 90 then 'heading' when {heading_level(d, size, body)} > 0 then 'heading' else 'body' end)"
    )


def list_parts(d: Spark, t: str) -> str:
    stripped = strip_page_numbers(d, d.sub(d.sub(t, LIST_NUMBERED), LIST_BULLET))
    return d.filter(d.map(d.split(stripped, rf"\s+[{BULLET}]\s+"), "p", trim(d, "p")), "p", "p <> ''")


def garbage_ratio(d: Spark, t: str) -> str:
    s = trim(d, t)
    return f"(case when {s} = '' then 0.0 else {d.count(s, GARBAGE)} / cast({d.length(s)} as double) end)"


def garbage(d: Spark, t: str) -> str:
    return f"({garbage_ratio(d, t)} > 0.2)"


def caption_label(d: Spark, t: str) -> str:
    """A table or figure number as a label, and words that a line end split joined."""
    s = d.sub(t, r"(?i)^(?:Table|Fig(?:ure)?)\s*([0-9]+)\s*[.:]\s*", "表\\1 ")
    return d.sub(s, r"([a-z])-\s+([a-z])", "\\1\\2")


def drop_glyphs(d: Spark, t: str) -> str:
    return d.sub(t, f"[{GLYPHS}\ue000-\uf8ff]")


def drop_markers(d: Spark, t: str) -> str:
    return d.sub(t, rf"^[\s{GLYPHS}►▻*\-–—―·" + "\ue000-\uf8ff]+")


def escape(d: Spark, t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def chapter(d: Spark, t: str) -> str:
    return d.like(t, r"(?i)^(?:第\s*[0-9]+\s*章|章\s|Chapter\s*[0-9]+|Appendix(?:[^A-Za-z0-9_]|\z))")


def safe_id(d: Spark, t: str) -> str:
    return f"({t} not in ('.', '..') and {d.like(t, r'^[A-Za-z0-9_.-]+\z')})"


def despace_cjk(d: Spark, t: str) -> str:
    p = rf"([{CJK_WIDE}])[ \t]+([{CJK_WIDE}])"
    return d.sub(d.sub(t, p, "\\1\\2"), p, "\\1\\2")


def noise(d: Spark, t: str, kind: str) -> str:
    s = trim(d, t)
    shapes = {
        "numbery": (r"(?i)^[0-9\s.\-–—IVXivxlcdm]{1,10}\z", r"^[0-9]{1,3}\z", r"\.{5,}", r"(?i)^(?:第?\s*[0-9]+\s*页|page\s*[0-9]+|[0-9]+\s*/\s*[0-9]+)\z"),
        "caption": (r"(?i)^(?:图|表|Figure|Table|Listing|Exhibit)\s*[0-9.\-]", r"(?i)^(?:版权信息|作者简介|译者|目录|Contents|Table of Contents|Acknowledg|Foreword|Preface|关于|序言|前言)\z"),
        "spam": (r"(?i)z-?\s?library|singlelogin|go-to-zlibrary|libgen|annas-?archive", r"(?i)downloaded from|gateway to knowledge|Accessible for everyone", r"扫码|关注公众号|加微信|加QQ群|勘误表|读者服务", r"(?i)^[A-Za-z0-9_.-]+\.(?:se|ru|io|org)\s"),
        "furniture": (r"^[0-9]{1,4}\s*[|｜]\s*\S", r"\S\s*[|｜]\s*[0-9]{1,4}\z", r"^[0-9]{1,4}\z", r"(?i)^[ivxlcdm]{1,6}\z"),
    }[kind]
    empty = f"{s} = '' or " if kind == "numbery" else ""
    return f"({empty}{' or '.join(d.like(s, p) for p in shapes)})"


def solid_length(d: Spark, t: str) -> str:
    return d.length(d.sub(t, r"\s+"))


def latin(d: Spark, t: str) -> str:
    n = d.count(t, "[A-Za-z]")
    return f"({n} >= 12 and {n} > 0.6 * {solid_length(d, t)})"


def han(d: Spark, t: str) -> str:
    return f"({d.count(t, '[⺀-⻿⼀-⿟　-〿一-鿿\uf900-\ufaff]')} >= 8)"


def index_like(d: Spark, t: str) -> str:
    return f"({d.count(t, r'[,，]\s*[0-9][0-9\-–,，\s]{3,}')} >= 2)"


def table_like(d: Spark, t: str) -> str:
    return f"({solid_length(d, t)} > 0 and {d.count(t, '[A-Za-z][A-Za-z0-9_.]{3,}|[0-9][0-9.]*')} > 0.12 * {solid_length(d, t)})"


def rare_tokens(d: Spark, t: str) -> str:
    low = d.map(d.all(t, r"[A-Za-z][A-Za-z0-9]{4,}|[A-Za-z]*[0-9][0-9.]*[A-Za-z0-9.]*"), "m", d.sub("lower(m)", r"[._]+\z"))
    return d.distinct_sorted(d.filter(low, "m", f"({d.length('m')} >= 5 or {d.like('m', '[0-9][.][0-9]')})"))


def prose(d: Spark, t: str) -> str:
    s = trim(d, t)
    marks = ["{}", "=>", "def ", "import ", "SELECT ", "http", ".py", ".parquet", "%sql"]
    has = " or ".join(f"contains({s}, '{m}')" for m in marks)
    return f"({d.length(s)} >= 12 and not ({has}) and not (contains({s}, ', ') and {d.count(s, '[0-9]')} > {d.length(s)} * 0.15))"


def benchmark_clean(d: Spark, t: str, fixes: dict[str, str] | None = None) -> str:
    """Hyphens of line ends, spaces, continuation marks and glued chapter numbers taken out; then fixed replacements."""
    s = collapse(d, d.sub(t, r"([a-z])-\s+([a-z])", "\\1\\2"))
    s = d.sub(s, r"(?i)^\(?continued\)?\s*")
    s = d.sub(s, r"(?i)^[0-9]{1,3}(?:chapter|part)[0-9]?[a-z]?\s*")
    for wrong, right in (fixes or {}).items():
        s = f"replace({s}, '{wrong}', '{right}')"
    return trim(d, s)


def words(d: Spark, t: str) -> str:
    return d.count(t, r"\S+")


def fuzzy_key(d: Spark, t: str) -> str:
    return collapse(d, d.sub(f"lower({t})", r"[^\pL\pN\s]", " "))


def head_key(d: Spark, t: str) -> str:
    return collapse(d, d.sub(f"lower({t})", "[0-9]+", "#"))


def char_class(d: Spark, c: str) -> str:
    return f"(case when {d.like(c, '^[　-〿㐀-䶿一-鿿\uf900-\ufaff＀-￯]')} then 'cjk' else 'latin' end)"


def atoms(d: Spark, t: str) -> str:
    return d.all(t, "[　-〿㐀-䶿一-鿿\uf900-\ufaff＀-￯]|[^\\s　-〿㐀-䶿一-鿿\uf900-\ufaff＀-￯]+")


def mirror(d: Spark, t: str) -> str:
    """The address of a file at the known mirror; other addresses stay."""
    return d.sub(t, r"^https?://modelscope\.cn/models/(.+?)/resolve/master/(.+)\z", "https://hf-mirror.com/\\1/resolve/main/\\2")


def hardware_error(d: Spark, t: str) -> str:
    return d.like(t, r"(?i)device\s*lost|vk_error|vulkan|out of memory|oom|allocation.*(?:fail|error)|cu(?:da|arses)?\s*error|ggml_(?:vk|cuda)|no (?:valid\s+)?device")


def clamp100(d: Spark, n: str) -> str:
    return f"least(greatest(coalesce({n}, 0.0), 0.0), 100.0)"


def mime(d: Spark, kind: str) -> str:
    return f"(case lower({kind}) when 'png' then 'image/png' when 'webp' then 'image/webp' when 'gif' then 'image/gif' else 'image/jpeg' end)"


def data_uri(d: Spark, kind: str, t: str) -> str:
    return f"concat('data:', {mime(d, kind)}, ';base64,', {d.base64(t)})"


def expand_glossary(d: Spark, t: str) -> str:
    """Each glossary key that is a whole ASCII word, in one pass: tokens are marked first, so no expansion is expanded again."""
    keys = sorted(GLOSSARY, key=len, reverse=True)
    p = rf"(^|[^A-Za-z0-9_\x01])({'|'.join(keys)})([^A-Za-z0-9_]|\z)"  # what is marked stays as it is
    out = t
    for _ in range(2):  # neighbours share the character between them
        out = d.sub(out, p, "\\1\u0001\\2\u0002\\3")
    for k, v in GLOSSARY.items():
        out = f"replace({out}, '\u0001{k}\u0002', '{v}')"
    return out


def defects(d: Spark, t: str, kind: str) -> str:
    """furniture_leak, run_on_word (TheDataLake) or mid_word_split (Column s)."""
    end = r"(?:[^A-Za-z0-9_]|\z)"
    if kind == "mid_word_split":
        return f"({d.like(t, r'(?:^|[^A-Za-z0-9_])[A-Za-z]{3,} [a-z]{1,2}' + end)} and {d.like(t, '[A-Za-z]{3,} [a-z]' + end)})"
    return d.like(t, {"furniture_leak": r"^[0-9]{1,4}\s*\|\s*\S|\S\s*\|\s*[0-9]{1,4}\z|\|\s*第[一二三四五六七八九十0-9]+章", "run_on_word": "[a-z]{3}[A-Z][a-z]{3}"}[kind])


def caption(d: Spark, t: str, kind: str = "line") -> str:
    """line: a capital Figure with its number starts a line; figure, table: starts the text, in any case."""
    return d.like(t, {"line": r"(?m)^[ \t]*Figure[ \t]+[0-9]+[.0-9]*[ \t.:]", "figure": r"(?i)^(?:Figure|Fig\.)\s*[0-9]+", "table": r"(?i)^(?:Table|图)\s*[0-9]+[.:]"}[kind])


def residual(d: Spark, t: str, kind: str) -> str:
    return d.like(t, {"han": f"[{HAN}]", "latin": "[A-Za-z]{3,}", "english": r"(?i)(?:^|[^A-Za-z])(?:the|and|of|to|in|is|that|for|with)(?:[^A-Za-z]|\z)"}[kind])


def latin_residue(d: Spark, source: str, out: str) -> str:
    return d.filter(d.all(out, "[A-Za-z]{5,}"), "w", f"not contains(lower({source}), lower(w))")


def join_lines(d: Spark, lines: str) -> str:
    """Lines as one text; a word that is split with a hyphen before a lower-case start is joined."""
    solid = d.filter(d.map(lines, "x", trim(d, "x")), "x", "x <> ''")
    return collapse(d, d.sub(d.join(solid, d.newline), r"([A-Za-z])-\n([a-z])", "\\1\\2"))


def apply(function: Callable[..., str], *inputs: str) -> Column:
    """A Spark column of one of these functions over SQL of columns, e.g. apply(garbage_ratio, "text")."""
    return F.expr(function(SPARK, *inputs))
