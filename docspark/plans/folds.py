"""The ordered folds over whole tables.

A fold whose state is small runs inside the engine, as aggregate() over an array of its rows; the others run in Python for
each document, page, job or conversation, so no group grows with the table. A fold over single rows needs no grouping at
all. ORACLES has them in DuckDB SQL, written apart as list_reduce() over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from docspark.cluster import ship
from docspark.functions import text as t
from docspark.functions.dialect import DUCK, SPARK
from docspark.operators import folds
from docspark.plans.catalog import TABLES
from docspark.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_views(SPARK, sql)
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def native(name: str, sql: str) -> None:
    """Registers Spark SQL over the views as a query."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, sql)


def oracle(name: str, steps: dict[str, str], result: str) -> None:
    """Registers DuckDB SQL: named steps over the views, then the result."""
    ORACLES[name] = with_views(DUCK, result, steps=steps)


def grouped(name: str, sql: str, by: list[str], schema: str):
    """Registers f(rows of a group, in the order of the columns after `by`) -> rows, as a query."""

    def add(f: Callable[[pd.DataFrame], list[tuple]]):
        columns = [x.strip().split(" ")[0] for x in schema.split(",")]

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([c for c in rows.columns if c not in by], kind="stable")
            return pd.DataFrame([(*key, *out) for out in f(rows)], columns=[*by, *columns])

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = view(spark, sf_dir, sql)
            kinds = dict(df.dtypes)
            return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + schema)

        QUERIES[name] = query
        return f

    return add


LINES = "select doc_id, seq, page, text, font_size, y, x from v_lines"

# --- Fragments of a line: pieces between spaces, some moved to the right ---------------------------------------------
_SPARK_FRAGMENTS = "transform(split(text, ' '), (piece, k) -> named_struct('at', x + cast(30 * k + case when k % 7 = 3 then 40 else 0 end as double), 'piece', piece, 'width', cast(5 * length(piece) as double), 'base', y + cast(k % 3 as double)))"
_DUCK_FRAGMENTS = "list_transform(string_split(text, ' '), lambda piece, i: {'at': x + 30 * (i - 1) + case when (i - 1) % 7 = 3 then 40 else 0 end, 'piece': piece, 'width': cast(5 * length(piece) as double), 'base': y + (i - 1) % 3})"
_WORD = t.collapse(SPARK, "f.piece")
_DUCK_WORD = t.collapse(DUCK, "f.piece")

_DUCK_JOIN = f"""lambda a, f: {{'line': case when f.line = '' then a.line when a.line <> '' and f.start - a.reach > {folds.SPACE_RATIO} * f.size then a.line || ' ' || f.line else a.line || f.line end, 'start': f.start,
      'reach': case when f.line <> '' then f.reach when a.reach is null then null else greatest(a.reach, f.reach) end, 'size': f.size}}, {{'line': '', 'start': cast(0 as double), 'reach': cast(null as double), 'size': cast(0 as double)}}"""

native(
    "c01_join_fragments",
    f"""select doc_id, seq, aggregate(array_sort({_SPARK_FRAGMENTS}), named_struct('line', '', 'reach', cast(null as double)),
      (a, f) -> case when {_WORD} = '' then named_struct('line', a.line, 'reach', case when a.reach is not null then greatest(a.reach, f.at + f.width) end)
        else named_struct('line', concat(a.line, case when a.line <> '' and f.at - a.reach > {folds.SPACE_RATIO} * font_size then ' ' else '' end, {_WORD}), 'reach', f.at + f.width) end,
      a -> a.line) as line from v_lines""",
)
oracle(
    "c01_join_fragments",
    {"pieces": f"select doc_id, seq, font_size, list_sort({_DUCK_FRAGMENTS}) as fs from v_lines"},
    f"select doc_id, seq, (list_reduce(list_transform(fs, lambda f: {{'line': {_DUCK_WORD}, 'start': f.at, 'reach': f.at + f.width, 'size': font_size}}), {_DUCK_JOIN})).line as line from pieces",
)

_CELL_STATE = "named_struct('done', {done}, 'line', {line}, 'left_x', {left}, 'gap_reach', f.at + f.width, 'reach', {reach})"
_PUSHED = "case when a.left_x is null then a.done else concat(a.done, array(named_struct('cell', a.line, 'left_x', a.left_x))) end"
native(
    "f03_cells",
    f"""select doc_id, seq, c.cell, c.left_x from (select doc_id, seq, explode(aggregate(array_sort({_SPARK_FRAGMENTS}),
      named_struct('done', cast(array() as array<struct<cell: string, left_x: double>>), 'line', '', 'left_x', cast(null as double), 'gap_reach', cast(null as double), 'reach', cast(null as double)),
      (a, f) -> case when a.gap_reach is null or f.at - a.gap_reach > {folds.CELL_GAP}
          then {_CELL_STATE.format(done=_PUSHED, line=_WORD, left="f.at", reach=f"case when {_WORD} <> '' then f.at + f.width end")}
        when {_WORD} = '' then {_CELL_STATE.format(done="a.done", line="a.line", left="a.left_x", reach="case when a.reach is not null then greatest(a.reach, f.at + f.width) end")}
        else {_CELL_STATE.format(done="a.done", line=f"concat(a.line, case when a.line <> '' and f.at - a.reach > {folds.SPACE_RATIO} * font_size then ' ' else '' end, {_WORD})", left="a.left_x", reach="f.at + f.width")} end,
      a -> {_PUSHED})) as c from v_lines)""",
)
oracle(
    # gaps to what reaches furthest are those to the fragment before, since starts are in order and a run is a run of them
    "f03_cells",
    {
        "pieces": f"select doc_id, seq, font_size, unnest(list_sort({_DUCK_FRAGMENTS})) as f from v_lines",
        "ordered": f"select doc_id, seq, font_size, f.at as pos, {_DUCK_WORD} as word, f.width as width, row_number() over (partition by doc_id, seq order by f.at) as k from pieces",
        "runs": f"select *, sum(case when before is null or pos - before > {folds.CELL_GAP} then 1 else 0 end) over (partition by doc_id, seq order by k) as run from (select *, lag(pos + width) over (partition by doc_id, seq order by k) as before from ordered)",
    },
    f"""select doc_id, seq, (list_reduce(list({{'line': word, 'start': pos, 'reach': pos + width, 'size': font_size}} order by k), {_DUCK_JOIN})).line as cell, min(pos) as left_x from runs group by doc_id, seq, run""",
)

FRAGMENTS = f"select doc_id, page, seq, font_size, f.at as at, f.base as base from (select doc_id, page, seq, font_size, explode({_SPARK_FRAGMENTS}) as f from v_lines)"


@grouped("f01_baselines", FRAGMENTS, ["doc_id", "page"], "line_count long, fragments long")
def _(rows):
    return [(len(set(folds.baselines(list(zip(rows.base, rows["at"], rows.font_size, strict=True))))), len(rows))]


oracle(
    "f01_baselines",
    {"pieces": f"select doc_id, page, seq, font_size, unnest({_DUCK_FRAGMENTS}) as f from v_lines"},
    f"""select doc_id, page, (list_reduce(list({{'y': f.base, 'size': font_size, 'lines': cast(1 as bigint)}} order by f.base desc, f.at, seq, font_size),
      lambda a, e: case when abs(e.y - a.y) >= {folds.BASELINE_RATIO} * a.size then {{'y': e.y, 'size': e.size, 'lines': a.lines + 1}} else a end)).lines as line_count, count(*) as fragments from pieces group by doc_id, page""",
)


# --- Geometry -------------------------------------------------------------------------------------------------------
@grouped("e02_clusters", "select page, rect_id, x from v_rects", ["page"], "centre double")
def _(rows):
    return [(c,) for c in folds.cluster(rows.x, 30.0)]


oracle(
    "e02_clusters",
    {
        "state": """select page, list_reduce(list({'first': x, 'total': x, 'n': cast(1 as bigint), 'done': cast([] as double[])} order by x),
          lambda a, e: case when e.first - a.first <= 30 then {'first': a.first, 'total': a.total + e.first, 'n': a.n + 1, 'done': a.done} else {'first': e.first, 'total': e.first, 'n': cast(1 as bigint), 'done': list_append(a.done, a.total / a.n)} end) as s
          from v_rects group by page"""
    },
    "select page, unnest(list_append(s.done, s.total / s.n)) as centre from state",
)


@grouped("d07_suppressed", "select page, rect_id, x, y, w, h from v_rects", ["page"], "rect_id long")
def _(rows):
    keep = folds.suppress(list(zip(rows.x, rows.y, rows.w, rows.h, rows.w * rows.h, strict=True)))
    return [(int(rows.rect_id.iloc[i]),) for i in keep]


_SHARED = "greatest(cast(0 as double), least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(cast(0 as double), least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))"
oracle(
    "d07_suppressed",
    {
        "state": f"""select page, list_reduce(list([{{'rect_id': rect_id, 'x': x, 'y': y, 'w': w, 'h': h}}] order by w * h desc, rect_id),
          lambda kept, one: case when len(list_filter(kept, lambda k: list_any_value(list_transform(one, lambda r: {_SHARED} >= 0.5 * (k.w * k.h + r.w * r.h - {_SHARED}))))) = 0 then kept || one else kept end) as kept from v_rects group by page"""
    },
    "select page, unnest(list_transform(kept, lambda k: k.rect_id)) as rect_id from state",
)


@grouped("e26_components", "select page, rect_id, x, y, w, h from v_rects", ["page"], "x0 double, y0 double, x1 double, y1 double")
def _(rows):
    return folds.merge_boxes(zip(rows.x, rows.y, rows.x + rows.w, rows.y + rows.h, strict=True))


@grouped("a04_placements", "select page, rect_id, x, y, w, h from v_rects", ["page"], "name string, px double, py double, pw double, ph double")
def _(rows):
    ops = []
    for r in rows.itertuples():
        # an outer transform moves and doubles what is painted, and is undone
        ops += [("save", ()), ("transform", (2, 0, 0, 2, 10, 20)), ("save", ()), ("transform", (r.w, 0, 0, r.h, r.x, r.y)), ("paint", str(r.rect_id)), ("restore", ()), ("paint", f"{r.rect_id}-outer"), ("restore", ())]
    return folds.placements(ops)


oracle("a04_placements", {}, "select page, cast(rect_id as varchar) as name, 2 * x + 10 as px, 2 * y + 20 as py, 2 * w as pw, 2 * h as ph from v_rects union all select page, rect_id || '-outer', 10, 20, 2, 2 from v_rects")


# --- Paragraphs -----------------------------------------------------------------------------------------------------
def paragraph_rows(body_size: float):
    def rows_of(rows):
        paras = folds.paragraphs(zip(rows.text, rows.font_size, rows.y, rows.page, [0] * len(rows), strict=True), body_size)
        return [(p["first"], len(p["texts"]), p["size"], " ".join(p["texts"])) for p in paras]

    return rows_of


def paragraph_oracle(name: str, body_size: float, columns: str) -> None:
    line = "{'i': cast(row_number() over (partition by doc_id order by seq) as bigint) - 1, 'text': text, 'size': font_size, 'y': y, 'page': page}"
    mark, starts = DUCK.like("e.text", t.BULLET_ONLY), lambda x: f"({DUCK.like(x, t.LIST_NUMBERED)} or {DUCK.like(x, t.LIST_BULLET)} or {DUCK.like(t.trim(DUCK, x), t.SECTION_HEADING)})"
    para = "{{'first': e.i, 'members': cast(1 as bigint), 'size': e.size, 'page': e.page, 'body': {body}}}"
    text = "case when a.bullet then '• ' || e.text else e.text end"
    joins = (
        f"len(a.out) > 0 and a.out[-1].page = e.page and least(e.size, a.out[-1].size) > {body_size * folds.CODE_FONT_RATIO} and not a.bullet and not {starts('e.text')} and a.last_y - e.y <= a.out[-1].size * {folds.LINE_GAP_RATIO} "
        f"and least(e.size, a.out[-1].size) / greatest(e.size, a.out[-1].size) > {1 - folds.FONT_TOLERANCE}"
    )
    joined = "{'first': a.out[-1].first, 'members': a.out[-1].members + 1, 'size': (a.out[-1].size + e.size) / 2, 'page': a.out[-1].page, 'body': a.out[-1].body || ' ' || e.text}"
    empty = "cast([] as struct(first bigint, members bigint, size double, page bigint, body varchar)[])"
    blank = f"{{'i': cast(0 as bigint), 'text': '', 'size': cast(0 as double), 'page': cast(0 as bigint), 'y': cast(0 as double), 'last_y': cast(0 as double), 'bullet': false, 'out': {empty}}}"
    state = lambda last_y, bullet, out: f"{{'i': e.i, 'text': '', 'size': e.size, 'page': e.page, 'y': e.y, 'last_y': {last_y}, 'bullet': {bullet}, 'out': {out}}}"
    oracle(
        name,
        {
            "numbered": f"select doc_id, {line} as l from v_lines",
            "elements": f"select doc_id, list({{'i': l.i, 'text': l.text, 'size': l.size, 'page': l.page, 'y': l.y, 'last_y': cast(0 as double), 'bullet': false, 'out': {empty}}} order by l.i) as es from numbered group by doc_id",
            "state": f"""select doc_id, list_reduce(es, lambda a, e: case when {mark} then {state('a.last_y', 'true', 'a.out')} when {joins} then {state('e.y', 'false', f'a.out[:-2] || [{joined}]')}
              else {state('e.y', 'false', f'a.out || [{para.format(body=text)}]')} end, {blank}) as s from elements""",
        },
        f"select doc_id, {columns} from (select doc_id, unnest(s.out) as p from state)",
    )


grouped("f04_paragraphs", LINES, ["doc_id"], "first_line long, members long, size double, body string")(paragraph_rows(10.0))
paragraph_oracle("f04_paragraphs", 10.0, "p.first as first_line, p.members as members, p.size as size, p.body as body")
grouped("a17_segments", LINES, ["doc_id"], "first_line long, body string")(lambda rows: [(r[0], r[3]) for r in paragraph_rows(0.0)(rows)])
paragraph_oracle("a17_segments", 0.0, "p.first as first_line, p.body as body")


@grouped("f08_rejoined", LINES, ["doc_id"], "place long, page long, body string")
def _(rows):
    return [(k, page, text) for k, (text, page) in enumerate(folds.rejoin(zip(rows.text, rows.page, strict=True)))]


_BEFORE, _NEXT = t.trim(DUCK, "a.out[-1].text"), t.trim(DUCK, "e.out[1].text")
oracle(
    "f08_rejoined",
    {
        "state": f"""select doc_id, list_reduce(list({{'out': [{{'text': text, 'page': page}}]}} order by seq, page, text),
          lambda a, e: {{'out': case when a.out[-1].page = e.out[1].page and regexp_matches({_BEFORE}, '[A-Za-z0-9,;:)\\]}}]\\z') and regexp_matches({_NEXT}, '^[a-z0-9("\\x27“\\[]') and length(a.out[-1].text) + length(e.out[1].text) < 4000
            then a.out[:-2] || [{{'text': {_BEFORE} || ' ' || {_NEXT}, 'page': a.out[-1].page}}] else a.out || e.out end}}) as s from v_lines group by doc_id"""
    },
    "select doc_id, cast(generate_subscripts(s.out, 1) - 1 as bigint) as place, unnest(list_transform(s.out, lambda p: p.page)) as page, unnest(list_transform(s.out, lambda p: p.text)) as body from state",
)


@grouped("a22_first_extractor", "select doc_id, seq, page, text, font_size, font_name, y from v_lines", ["doc_id"], "place long, page long, type string, chars long")
def _(rows):
    out = []
    for page, part in rows.groupby("page", sort=True):
        out += [(page, *p) for p in folds.first_paragraphs(zip(part.text, part.font_size, part.font_name, part.y, strict=True))]
    return [(k, page, kind, len(text)) for k, (page, kind, text) in enumerate(out)]


@grouped("a23_case_paragraphs", "select doc_id, seq, page, text, font_size, y, x from v_lines", ["doc_id"], "place long, page long, lines long, words long, size double")
def _(rows):
    out = []
    for page, part in rows.groupby("page", sort=True):
        out += [(page, *p) for p in folds.case_paragraphs(zip(part.text, part.y, part.x, part.font_size, strict=True))]
    return [(k, page, lines, len(text.split()), size) for k, (page, text, lines, size) in enumerate(out)]


# --- Frozen spans and numbered answers ------------------------------------------------------------------------------
def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                masked, kept = folds.freeze(r.full_source)
                rows.append((r.doc_id, r.unit_id, masked, len(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "unit_id", "masked", "tokens"])

    ship(spark)
    # a unit is a row, so units are worked on where they are
    return view(spark, sf_dir, "select doc_id, unit_id, full_source from v_masked").mapInPandas(run, "doc_id long, unit_id string, masked string, tokens long")


QUERIES["f17_frozen"] = _frozen
_PATTERNS = [p.replace("'", r"\x27") for p in folds.PROTECTED]
_HIT = [f"regexp_extract(a.text, '{p}')" for p in _PATTERNS]
_AT = "list_transform([" + ", ".join(f"case when {h} = '' then cast(null as bigint) else cast(instr(a.text, {h}) as bigint) end" for h in _HIT) + "], lambda x: x)"
oracle(
    "f17_frozen",
    {
        "state": f"""select doc_id, unit_id, list_reduce(list_transform(string_split('{folds.LETTERS}', ''), lambda c: {{'text': c, 'n': cast(0 as bigint)}}),
          lambda a, e: case when list_min({_AT}) is null then a else {{'text': a.text[:list_min({_AT}) - 1] || '§' || e.text || '§' || a.text[list_min({_AT}) + length([{', '.join(_HIT)}][list_position({_AT}, list_min({_AT}))]):], 'n': a.n + 1}} end,
          {{'text': full_source, 'n': cast(0 as bigint)}}) as s from v_masked"""
    },
    "select doc_id, unit_id, s.text as masked, s.n as tokens from state",
)


@grouped("f16_batch_parts", "select conv_id, n, answer from v_answers", ["conv_id"], "parts string")
def _(rows):
    parts = folds.split_batch(rows.answer.iloc[0], int(rows.n.iloc[0]))
    return [("|".join(parts) if parts else None,)]


_NUMBERED = r"^\s*([0-9]+)\s*[.、)．]\s*(.*)$"
_PART = "{{'k': {k}, 'body': {body}}}"
_NO_PARTS = "cast([] as struct(k bigint, body varchar)[])"
_NUMBER = f"try_cast(regexp_extract(line, '{_NUMBERED}', 1) as bigint)"
_MORE = "list_transform(a.parts, lambda p: case when p.k = a.last then {'k': p.k, 'body': p.body || ' ' || e.rest} else p end)"
oracle(
    "f16_batch_parts",
    {
        "lines": "select conv_id, n, string_split(answer, chr(10)) as ls from v_answers",
        "elements": f"select conv_id, n, list_transform(ls, lambda line: {{'num': {_NUMBER}, 'rest': case when {_NUMBER} is not null then {t.trim(DUCK, f'regexp_extract(line, {t.QUOTE}{_NUMBERED}{t.QUOTE}, 2)')} else {t.trim(DUCK, 'line')} end, 'n': n, 'last': cast(null as bigint), 'parts': {_NO_PARTS}}}) as es from lines",
        "state": f"""select conv_id, n, list_reduce(es, lambda a, e: case
            when e.num between 1 and e.n and len(list_filter(a.parts, lambda p: p.k = e.num)) = 0 then {{'num': null, 'rest': '', 'n': e.n, 'last': e.num, 'parts': a.parts || [{_PART.format(k='e.num', body='e.rest')}]}}
            when e.num is not null and (a.last is null or e.rest = '') then {{'num': null, 'rest': '', 'n': e.n, 'last': cast(null as bigint), 'parts': a.parts}}
            when a.last is not null and e.rest <> '' then {{'num': null, 'rest': '', 'n': e.n, 'last': a.last, 'parts': {_MORE}}} else a end,
          {{'num': cast(null as bigint), 'rest': '', 'n': cast(0 as bigint), 'last': cast(null as bigint), 'parts': {_NO_PARTS}}}) as s from elements""",
        "whole": f"select conv_id, n, list_sort(list_transform(s.parts, lambda p: {{'k': p.k, 'body': {t.trim(DUCK, 'p.body')}}})) as ps from state",
    },
    "select conv_id, case when len(list_filter(ps, lambda p: p.body <> '')) = n then array_to_string(list_transform(ps, lambda p: p.body), '|') end as parts from whole",
)

# --- Layout ---------------------------------------------------------------------------------------------------------
_WIDE = "regexp_count(w, '[\\\\x{2E80}-\\\\x{10FFFF}]')"


def wrapped_lines(words: str, size: float, width: float) -> str:
    """Spark SQL: the lines that words take at a size and width; wide characters take the size, others half of it."""
    need = f"({size / 2} * length(w) + {size / 2} * {_WIDE})"
    return (
        f"aggregate({words}, named_struct('n', cast(0 as bigint), 'used', cast(0 as double)), (a, w) -> case when a.n = 0 then named_struct('n', cast(1 as bigint), 'used', cast({need} as double)) "
        f"when a.used + {size / 2} + {need} > {width} then named_struct('n', a.n + 1, 'used', cast({need} as double)) else named_struct('n', a.n, 'used', cast(a.used + {size / 2} + {need} as double)) end, a -> a.n)"
    )


def duck_wrapped_lines(words: str, size: float, width: float) -> str:
    need = f"({size / 2} * length(w) + {size / 2} * len(regexp_extract_all(w, '[\\x{{2E80}}-\\x{{10FFFF}}]')))"
    return (
        f"(case when len({words}) = 0 then 0 else (list_reduce(list_transform({words}, lambda w: {{'n': cast(1 as bigint), 'used': cast({need} as double)}}), lambda a, e: case when a.used + {size / 2} + e.used > {width} then {{'n': a.n + 1, 'used': e.used}} else {{'n': a.n, 'used': a.used + {size / 2} + e.used}} end)).n end)"
    )


_SPARK_WORDS, _DUCK_WORDS = "filter(split({}, r'\\s+'), w -> w <> '')", "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
native("f11_wrapped", f"select doc_id, sum({wrapped_lines(_SPARK_WORDS.format('text'), 10.0, 400.0)}) as lines from v_lines group by doc_id")
oracle("f11_wrapped", {}, f"select doc_id, cast(sum({duck_wrapped_lines(_DUCK_WORDS.format('text'), 10.0, 400.0)}) as bigint) as lines from v_lines group by doc_id")

_CELLS = "select doc_id, seq, split(text, r'\\|', -1) as cells from v_lines where font_name = 'code'"
native("e22_row_heights", f"select doc_id, seq, greatest(1, coalesce(array_max(transform(cells, c -> {wrapped_lines(_SPARK_WORDS.format('c'), 10.0, 120.0)})), 1)) * 16 + 6 as height from ({_CELLS})")
oracle("e22_row_heights", {}, f"select doc_id, seq, greatest(1, coalesce(list_max(list_transform(regexp_split_to_array(text, '\\|'), lambda c: {duck_wrapped_lines(_DUCK_WORDS.format('c'), 10.0, 120.0)})), 1)) * 16 + 6 as height from v_lines where font_name = 'code'")

native(
    "f10_pages",
    """select doc_id, aggregate(hs, named_struct('page', cast(1 as bigint), 'used', cast(0 as double)), (a, h) -> case when a.used > 0 and a.used + h.v > 700 then named_struct('page', a.page + 1, 'used', h.v) else named_struct('page', a.page, 'used', a.used + h.v) end, a -> a.page) as pages
      from (select doc_id, array_sort(collect_list(named_struct('seq', seq, 'v', font_size * cast(1.6 as double)))) as hs from v_lines group by doc_id)""",
)
oracle(
    "f10_pages",
    {"state": "select doc_id, list_reduce(list({'page': cast(1 as bigint), 'used': font_size * cast(1.6 as double)} order by seq), lambda a, h: case when a.used + h.used > 700 then {'page': a.page + 1, 'used': h.used} else {'page': a.page, 'used': a.used + h.used} end) as s from v_lines group by doc_id"},
    "select doc_id, s.page as pages from state",
)

# --- Jobs -----------------------------------------------------------------------------------------------------------
_RATE = "(e.at - a.at) / (e.progress - a.progress)"
_MEAN = f"case when a.at is null then null when e.progress > a.progress then case when a.mean is null then {_RATE} else cast(0.7 as double) * a.mean + cast(0.3 as double) * {_RATE} end end"
_LEFT = "case when {mean} is not null and e.progress > 5 and e.progress < 100 then {mean} * (100 - e.progress) end"
native(
    "f14_eta",
    f"""select job_id, o.seq, round(o.eta, 6) as eta from (select job_id, explode(aggregate(es, named_struct('at', cast(null as double), 'progress', cast(null as double), 'mean', cast(null as double), 'out', cast(array() as array<struct<seq: bigint, eta: double>>)),
      (a, e) -> named_struct('at', e.at, 'progress', e.progress, 'mean', cast({_MEAN} as double), 'out', concat(a.out, array(named_struct('seq', e.seq, 'eta', cast({_LEFT.format(mean=f'({_MEAN})')} as double))))), a -> a.out)) as o
      from (select job_id, array_sort(collect_list(named_struct('ts', ts, 'seq', seq, 'at', timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / cast(1000000 as double), 'progress', progress))) as es from v_job_events group by job_id))""",
)
oracle(
    # a running mean of rates starts anew where progress does not increase, so it is a sum over one such stretch
    "f14_eta",
    {
        "steps": "select job_id, seq, progress, epoch_us(ts) / cast(1000000 as double) as tick, lag(epoch_us(ts) / cast(1000000 as double)) over w as tick_before, lag(progress) over w as progress_before, row_number() over w as k from v_job_events window w as (partition by job_id order by ts, seq)",
        "stretches": "select *, sum(case when progress_before is null or progress <= progress_before then 1 else 0 end) over (partition by job_id order by k) as stretch, (tick - tick_before) / nullif(progress - progress_before, 0) as rate from steps",
        "places": "select *, row_number() over (partition by job_id, stretch order by k) - 1 as m, list(rate) over (partition by job_id, stretch order by k) as rates from stretches",
    },
    """select job_id, seq, round(case when m > 0 and progress > 5 and progress < 100 then list_reduce(rates[2:], lambda a, r: cast(0.7 as double) * a + cast(0.3 as double) * r) * (100 - progress) end, 6) as eta from places""",
)

native(
    "f21_notices",
    """select job_id, cast(place as bigint) as place, notice from (select job_id, slice(ns, greatest(1, size(ns) - 4), 5) as ns from (select job_id, array_distinct(transform(array_sort(collect_list(named_struct('ts', ts, 'seq', seq, 'status', status))), e -> e.status)) as ns from v_job_events group by job_id)) lateral view posexplode(ns) x as place, notice""",
)
oracle(
    "f21_notices",
    {"firsts": "select job_id, status, first_at, row_number() over (partition by job_id order by first_at desc) as back, count(*) over (partition by job_id) as n from (select job_id, status, min(row(ts, seq)) as first_at from v_job_events group by job_id, status)"},
    "select job_id, least(n, 5) - back as place, status as notice from firsts where back <= 5",
)


# --- Alignment ------------------------------------------------------------------------------------------------------
@grouped("f18_chain", "select conv_id, turn, length(left_text) as a, length(right_text) as b from v_pairs", ["conv_id"], "i long, j long, weight double")
def _(rows):
    return folds.best_chain((int(i), int(b) % 17, float(a % 13 + 1)) for i, a, b in zip(rows.turn, rows.a, rows.b, strict=True))


@grouped("f19_alignment", "select conv_id, turn, left_text, right_text from v_pairs", ["conv_id"], "i long, j long, score double")
def _(rows):
    bags = [[set(str(x).lower().split()) for x in c] for c in (rows.left_text, rows.right_text)]
    return folds.align(np.array([[len(a & b) / max(1, len(a | b)) for b in bags[1]] for a in bags[0]]), least=0.0)
