"""Named inputs of the operators, derived from the given tables: the same definition for Spark and for DuckDB.

A document is a row of documents, cut into pages of 44 lines; a source is a collection of documents. Each view can be
replaced by a table of one's own with the same columns (plans.catalog.run).
"""

from __future__ import annotations

from collections.abc import Callable

from docspark.functions import text as t
from docspark.functions.dialect import Spark

PAGE_LINES, PAGE_HEIGHT, VERSION = 44, 792, 4


def raw_lines(d: Spark) -> str:
    return d.explode("documents", d.lines("text"), "line", "seq", "doc_id, source, lang")


def v_lines(d: Spark) -> str:
    at = f"(seq % {PAGE_LINES})"
    return f"""
select doc_id, source, lang, {d.div('seq', str(PAGE_LINES))} + 1 as page, {at} as line_no, seq, line as text, cast(690 - 14 * {at} as double) as y, cast({PAGE_HEIGHT} as double) as page_height, cast(72 as double) as x,
  cast(case when {at} = 0 and length(line) < 120 then 16 when contains(line, '|') then 8 else 10 end as double) as font_size, case when contains(line, '|') then 'code' else 'body' end as font_name
from raw_lines where {t.trim(d, 'line')} <> ''
union all
select doc_id, source, lang, cast(1 as bigint), cast(-1 as bigint), cast(-1 as bigint), concat('Running head ', cast(doc_id as {d.string})), cast(705 as double), cast({PAGE_HEIGHT} as double), cast(72 as double), cast(10 as double), 'body'
from documents where doc_id % 2 = 0 and text is not null"""


def v_samples(d: Spark) -> str:
    """Lines, and forms of them in which the patterns of the operators occur."""
    n, k = f"cast(doc_id as {d.string})", f"cast(doc_id % 1000 as {d.string})"
    forms = [
        "text", f"concat({n}, ' | ', text)", f"concat(text, ' | ', {k})", k, "concat('xiv ', text)", f"concat('12 ', text)", f"concat(text, ' ', {k})", f"concat('1.', {k}, text)",
        "concat('1212.1', text)", "concat('- ', text)", "concat('• ', text, ' • ', text)", "concat('%sql select ', text)", "'+----+----+'", "concat('spark> ', text)", f"concat('/usr/lib/', {n})",
        f"concat('{{\"a\": [', {n}, ']}}; x = y[1]; ', text)", f"concat('Figure ', {k}, '.1 ', text)", "concat('译文：', text)", f"concat('See https://example.com/', {n}, ' [', {n}, '] EM and OKRs in CI,CD EM EM', ' ')", f"concat(text, ' ..... ', {k})",
        "'Contents'", "concat('中文 翻 译 内容 ', text, '。第二句！')", f"concat('��', {k})", f"concat('com-', {d.newline}, text)", "concat('1.1.1 ', text, ': ', text)", "'mill'", "'XLIV'", "concat('<b>', text, ' & co</b>')",
    ]
    cases = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
    return f"select doc_id, seq, y, page_height, font_size, font_name, case (doc_id + seq + {len(forms)}) % {len(forms)} {cases} end as t from v_lines"


def v_kinds(d: Spark) -> str:
    code_font = "(font_name = 'code')"
    return f"select *, {t.classify(d, 'text', 'font_name', 'font_size', '10', code_font)} as kind from v_lines"


def v_blocks(d: Spark) -> str:
    """Consecutive list items and code lines as one block each, at the place of their last member; in reading order."""
    item = f"case when kind = 'list-item' then {t.strip_page_numbers(d, d.sub(d.sub('text', t.LIST_NUMBERED), t.LIST_BULLET))} when kind = 'code' then text else {t.strip_page_numbers(d, 'text')} end"
    return f"""
select doc_id, cast(row_number() over (partition by doc_id order by page, top_y desc, last_seq) as bigint) - 1 as block_no, kind, page, top_y, items, {d.join('items', d.newline)} as body
from (
  select doc_id, run, max(kind) as kind, max(page) as page, min(y) as top_y, max(seq) as last_seq, {d.ordered('item', 'seq')} as items
  from (
    select *, {item} as item, cast(sum(case when kind = before and kind in ('list-item', 'code') then 0 else 1 end) over (partition by doc_id order by seq) as bigint) as run
    from (select *, lag(kind) over (partition by doc_id order by seq) as before from v_kinds))
  group by doc_id, run)"""


def v_units(d: Spark) -> str:
    """Blocks and list items to be worked on, in one pass over the blocks; ids count all blocks of the document."""
    parts = f"case when kind = 'list-item' then items else {d.array('body')} end"
    rows = d.explode("(select * from v_blocks where kind not in ('code', 'formula'))", parts, "source", "place", "doc_id, block_no, page, kind")
    item = "case when kind = 'list-item' then place end"
    return f"select doc_id, block_no, {item} as item_no, page, concat('b', cast(block_no as {d.string}), case when kind = 'list-item' then concat('-', cast(place as {d.string})) else '' end) as unit_id, source from ({rows}) where {t.trim(d, 'source')} <> ''"


def v_masked(d: Spark) -> str:
    n = f"cast(doc_id % 1000 as {d.string})"
    return f"select *, concat('See https://example.com/', {n}, ' [', {n}, '] Figure ', {n}, '.1 ', source) as full_source, concat('See §A§ §B§ §C§ ', source) as masked from v_units"


def v_attempts(d: Spark) -> str:
    """Results that are right or wrong in known ways, by doc_id."""
    cases = [
        "masked", "''", d.sub("masked", "[0-9]+"), "replace(masked, '§B§', '')", "concat(masked, ' §A§')", "concat(masked, '</think>')", "concat(masked, masked, masked)", "concat('译文：§A§ §B§ §C§ ', repeat('汉', greatest(1, cast(length(source) / 3 as int))))",
    ]
    when = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    n = f"cast(doc_id % 1000 as {d.string})"
    restored = "raw"
    for token, value in (("A", f"concat('https://example.com/', {n})"), ("B", f"concat('[', {n}, ']')"), ("C", f"concat('Figure ', {n}, '.1')")):
        restored = f"replace({restored}, '§{token}§', {value})"
    return f"select *, {t.clean_translation(d, restored)} as restored from (select *, case (doc_id + block_no) % 8 {when} end as raw from v_masked)"


def v_checked(d: Spark) -> str:
    """Attempts with the reasons of either phase against them, and all of them. A phase stops at an empty text."""
    src, out = "src", "res"
    count = lambda xs: d.size(d.filter(xs, "y", "y = x"))
    first = lambda xs, more, less: d.filter(d.distinct(xs), "x", f"{count(more)} > {count(less)}")
    cjk, norm = d.like(out, f"[{t.HAN}]"), lambda x: f"lower({t.collapse(d, x)})"
    bare = lambda n: d.sub(n, "[.,]")
    dropped = d.filter("src_numbers", "n", f"not {d.has('res_numbers', 'n')} and not {d.has('res_numbers', bare('n'))} and not {d.has('res_bare', 'n')} and not {d.has('res_bare', bare('n'))}")
    rounded = f"({d.size('dropped')} > 1 and has_cjk and {d.like(out, t.MAGNITUDE)} and {d.forall('dropped', 'n', f'{d.number(bare('n'))} >= 1000 and {d.number(bare('n'))} % 1000 = 0')})"
    ratio = f"(cast({d.length(out)} as double) / {d.length(src)})"
    hundredths = f"cast(floor({ratio} * 100 + 0.5) as bigint)"
    shown = f"concat(cast({d.div(hundredths, '100')} as {d.string}), '.', lpad(cast({hundredths} % 100 as {d.string}), 2, '0'))"
    one = [f"case when {d.size('lost')} > 0 then concat('sentinel-lost:', {d.join('lost', t.EMPTY)}) end", f"case when {d.size('extra')} > 0 then concat('sentinel-extra:', {d.join('extra', t.EMPTY)}) end"]
    two = [
        f"case when {d.like(out, '§[A-Z]§')} then 'sentinel-leak' end",
        f"case when ({d.count(src, t.LATIN_WORD)} >= 4 or {d.length(src)} > 60) and ({out} = {src} or ({d.length(src)} > 40 and {norm(out)} = {norm(src)})) then 'echo' end",
        f"case when not has_cjk and {d.length(out)} > 100 and {d.count(out, t.LATIN_WORD)} >= 3 then 'untranslated-latin' end",
        f"case when {d.size('dropped')} > (case when not has_cjk then 0 when {rounded} then {d.size('dropped')} else 1 end) then concat('number-dropped:', {d.join(d.slice('dropped', 1, 4), t.COMMA)}) end",
        f"case when {d.length(src)} > 0 and ({ratio} < 0.12 or {ratio} > 2.2) then concat('length-ratio:', {shown}) end",
        f"case when {d.like(out, t.MARKER_LEAK)} then 'marker-leak' end",
    ]
    listed = lambda rules: d.filter(d.array(*rules), "r", "r is not null")
    stopped = lambda text, rules: f"case when {text} = '' then {d.array(t.EMPTY_REASON)} else {listed(rules)} end"
    return f"""
select *, {d.concat('output_reasons', 'restored_reasons')} as reasons, {d.size('output_reasons')} + {d.size('restored_reasons')} = 0 as good
from (
  select *, {stopped('answer', one)} as output_reasons, {stopped(out, two)} as restored_reasons
  from (
    select *, {first('want', 'want', 'got')} as lost, {first('got', 'got', 'want')} as extra, {dropped} as dropped
    from (
      select *, {d.all('masked', '§[A-Z]§')} as want, {d.all('raw', '§[A-Z]§')} as got, {d.all(src, t.NUMBER)} as src_numbers, {d.all(out, t.NUMBER)} as res_numbers, {d.map(d.all(out, t.NUMBER), 'n', bare('n'))} as res_bare, {cjk} as has_cjk
      from (select *, {t.trim(d, 'raw')} as answer, {t.trim(d, 'full_source')} as src, {t.trim(d, 'restored')} as res from v_attempts))))"""


def v_items(d: Spark) -> str:
    """Items of the text layer: some have no text, some no transform."""
    matrix = d.array("font_size", "cast(0 as double)", "cast(0 as double)", "-font_size", "x", "y")
    return f"select doc_id, page, seq, case when seq % 17 = 5 then null else text end as str, case when seq % 19 = 7 then null else {matrix} end as transform from v_lines"


def v_limits(d: Spark) -> str:
    """The number of pages of a document to read; 0 or null: all."""
    return "select doc_id as limited, case when doc_id % 4 = 0 then cast(0 as bigint) when doc_id % 4 = 1 then null else doc_id % 7 end as page_limit from documents"


def v_prior(d: Spark) -> str:
    return f"select doc_id, unit_id, concat('done ', source) as result, cast(case when doc_id % 2 = 0 then {VERSION} else {VERSION - 1} end as bigint) as version from v_units where (doc_id + block_no) % 3 = 0"


def v_log(d: Spark) -> str:
    """A log of results as JSON lines, every tenth cut off, some keys written twice."""
    body = f"concat('{{\"unitId\": \"', unit_id, '\", \"n\": ', cast(length(source) as {d.string}), '}}')"
    rows = f"select doc_id, block_no, item_no, unit_id, {body} as line, cast(block_no * 1000 + coalesce(item_no, 0) as bigint) as line_no from v_units"
    return f"""
select doc_id, line_no, case when line_no % 10 = 9 then substring(line, 1, 12) else line end as line from ({rows})
union all
select doc_id, line_no + 100000000, replace(line, '"n": ', '"n": 9') from ({rows}) where (doc_id + block_no) % 7 = 0"""


STATUSES = ["queued", "extracting", "translating", "typesetting", "exporting", "done", "paused", "canceled", "error"]


def v_job_events(d: Spark) -> str:
    """events as the states of jobs: a job is a user."""
    cases = " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATUSES))
    return f"select user_id as job_id, event_id as seq, ts, value, case event_id % 9 {cases} end as status, least(100.0, greatest(0.0, cast(event_id % 131 as double))) as progress from events"


def v_rects(d: Spark) -> str:
    """Rectangles of pages; ink is the percentage of dark pixels in them."""
    return "select user_id as page, event_id as rect_id, cast(event_id % 500 as double) as x, cast(event_id % 700 as double) as y, cast(20 + event_id % 180 as double) as w, cast(20 + event_id % 90 as double) as h, cast(event_id % 4 as bigint) as kind, case event_id % 4 when 0 then 'image' when 1 then 'chart' when 2 then 'table' else 'text' end as class, cast(event_id * 37 % 1000 as double) / 10 as ink from events"


def v_anchors(d: Spark) -> str:
    """Column anchors of a page, from left to right."""
    return f"select page as anchored, {d.ordered('x', 'x')} as anchors from (select distinct page, x from v_rects where rect_id % 9 = 0) group by page"


def v_patches(d: Spark) -> str:
    """Settings of a user and changes to them, as JSON; a change is the next event's properties."""
    return "select event_id, user_id, lag(props) over (partition by user_id order by ts, event_id) as current_json, props as patch_json from events"


def v_removals(d: Spark) -> str:
    """Jobs that were removed, and when: where a job of these was first canceled."""
    return "select job_id as gone, min(seq) as gone_at from v_job_events where status = 'canceled' and job_id % 2 = 0 group by job_id"


def v_pairs(d: Spark) -> str:
    return "select a.conv_id, a.turn, a.text as left_text, b.text as right_text from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1"


def v_answers(d: Spark) -> str:
    """Numbered answers to the turns of a conversation: whole, without the last, with a number twice, or over two lines."""
    k = f"cast(turn + 1 as {d.string})"
    body = f"case when {t.trim(d, 'text')} = '' then '-' else {t.collapse(d, 'text')} end"
    line = f"""case when conv_id % 5 = 1 and turn = last_turn then '' when conv_id % 5 = 2 and turn = 1 then concat('1. ', {body}) when conv_id % 5 = 3 then concat('  ', {k}, '、', {body}, {d.newline}, ' and more ')
      when conv_id % 5 = 4 and turn = 0 then concat('Answers:', {d.newline}, {k}, ') ', {body}, {d.newline}, '99. beyond') else concat({k}, '. ', {body}) end"""
    return f"select conv_id, cast(max(last_turn) + 1 as bigint) as n, {d.join(d.ordered('line', 'turn'), d.newline)} as answer from (select conv_id, turn, last_turn, {line} as line from (select conv_id, turn, text, max(turn) over (partition by conv_id) as last_turn from conversations)) group by conv_id"


def v_json_answers(d: Spark) -> str:
    """JSON answers to the turns of a conversation: whole, without the last, cut off, or with a blank item."""
    items = d.ordered("named_struct('id', id, 'zh', zh)" if d.name == "spark" else "{'id': id, 'zh': zh}", "id")
    whole = f"select conv_id, max(last_turn) + 1 as n, {items} as items from (select conv_id, turn + 1 as id, last_turn, case when conv_id % 4 = 3 and turn = 0 then ' ' else coalesce(text, '') end as zh from (select conv_id, turn, text, max(turn) over (partition by conv_id) as last_turn from conversations) where not (conv_id % 4 = 1 and turn = last_turn)) group by conv_id"
    return f"select conv_id, cast(n as bigint) as n, case when conv_id % 4 = 2 then substring(answer, 1, 20) else answer end as answer from (select conv_id, n, {d.to_json({'items': 'items'})} as answer from ({whole}))"


VIEWS: dict[str, tuple[Callable[[Spark], str], tuple[str, ...]]] = {
    "raw_lines": (raw_lines, ()),
    "v_lines": (v_lines, ("raw_lines",)),
    "v_samples": (v_samples, ("v_lines",)),
    "v_kinds": (v_kinds, ("v_lines",)),
    "v_blocks": (v_blocks, ("v_kinds",)),
    "v_units": (v_units, ("v_blocks",)),
    "v_masked": (v_masked, ("v_units",)),
    "v_attempts": (v_attempts, ("v_masked",)),
    "v_checked": (v_checked, ("v_attempts",)),
    "v_items": (v_items, ("v_lines",)),
    "v_limits": (v_limits, ()),
    "v_prior": (v_prior, ("v_units",)),
    "v_log": (v_log, ("v_units",)),
    "v_job_events": (v_job_events, ()),
    "v_rects": (v_rects, ()),
    "v_pairs": (v_pairs, ()),
    "v_anchors": (v_anchors, ("v_rects",)),
    "v_answers": (v_answers, ()),
    "v_json_answers": (v_json_answers, ()),
    "v_patches": (v_patches, ()),
    "v_removals": (v_removals, ("v_job_events",)),
}


def with_views(d: Spark, sql: str, given: frozenset[str] = frozenset(), steps: dict[str, str] | None = None) -> str:
    """sql with the views it names, and those that they name, as common table expressions; those in given are tables.

    steps: further expressions by name, of which sql and later ones may make use.
    """
    order: list[str] = []

    def need(text: str) -> None:
        for name, (_, _) in VIEWS.items():
            if name in text and name not in given and name not in order:
                need(VIEWS[name][0](d))
                order.append(name)

    steps = steps or {}
    need(" ".join([*steps.values(), sql]))
    parts = [f"{name} as ({VIEWS[name][0](d)})" for name in order] + [f"{name} as ({text})" for name, text in steps.items()]
    return f"with {', '.join(parts)} {sql}" if parts else sql
