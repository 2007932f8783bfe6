"""DuckDB SQL of plans, written apart from theirs and in another way: self-joins, ranks and lists in place of windows and folds.

Where a plan is not here, its check is its own SQL in DuckDB's words.
"""

from __future__ import annotations

from docspark.functions import text as t
from docspark.functions.dialect import DUCK
from docspark.plans.views import VERSION, with_views

_LIST_ITEM = t.strip_page_numbers(DUCK, DUCK.sub(DUCK.sub("text", t.LIST_NUMBERED), t.LIST_BULLET))
_PLAIN = t.strip_page_numbers(DUCK, "text")
#: Runs of one kind are those of an equal difference of two ranks.
_ISLANDS = f"""select doc_id, kind, seq, page, y, case when kind = 'list-item' then {_LIST_ITEM} when kind = 'code' then text else {_PLAIN} end as item,
  case when kind in ('list-item', 'code') then row_number() over (partition by doc_id order by seq) - row_number() over (partition by doc_id, kind order by seq) else -1000000 - row_number() over (partition by doc_id order by seq) end as island from v_kinds"""
_BLOCKS = "select doc_id, kind, island, max(page) as page, min(y) as top_y, max(seq) as last_seq, count(*) as members, cast(sum(length(item)) + count(*) - 1 as bigint) as chars from islands group by doc_id, kind, island"

#: The states that each state may go to, as pairs.
_PAIRS = {
    "queued": "extracting canceled", "extracting": "translating paused canceled error", "translating": "typesetting paused canceled error", "typesetting": "exporting paused canceled error", "exporting": "done paused canceled error",
    "paused": "queued canceled", "error": "queued canceled", "canceled": "queued",
}
_LEGAL = "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, bs in _PAIRS.items() for b in bs.split()) + ") as p(a, b)"

OWN: dict[str, tuple[dict[str, str], str]] = {
    "f07_blocks": (
        {"islands": _ISLANDS, "blocks": _BLOCKS},
        "select b.doc_id, (select count(*) from blocks o where o.doc_id = b.doc_id and (o.page < b.page or (o.page = b.page and (o.top_y > b.top_y or (o.top_y = b.top_y and o.last_seq < b.last_seq))))) as block_no, b.kind, b.page, b.top_y, b.members, b.chars from blocks b",
    ),
    "e12_block_types": (
        {"islands": _ISLANDS, "bodies": "select doc_id, kind, island, string_agg(item, chr(10) order by seq) as body from islands group by doc_id, kind, island"},
        "select kind, count(*) as blocks, sum(case when regexp_matches(body, '^[a-z]') then 1 else 0 end)::bigint as lower_starts, sum(case when length(body) < 20 then 1 else 0 end)::bigint as tiny from bodies group by kind",
    ),
    "k01_transitions": (
        {"pairs": _LEGAL, "ranked": "select *, row_number() over (partition by job_id order by ts, seq) as r from v_job_events"},
        "select e.job_id, e.seq, e.status, p.status as before, p.status is null or p.status = e.status or exists (select 1 from pairs where a = p.status and b = e.status) as legal from ranked e left join ranked p on p.job_id = e.job_id and p.r = e.r - 1",
    ),
    "d20_upsert": (
        {"last": "select job_id, max(row(ts, seq)) as m, min(seq) as first_seq from v_job_events group by job_id"},
        "select l.job_id, e.status, l.first_seq from last l join v_job_events e on e.job_id = l.job_id and row(e.ts, e.seq) = l.m",
    ),
    "k05_orphan_repair": (
        {"last": "select job_id, max(row(ts, seq)) as m from v_job_events group by job_id"},
        "select l.job_id, case e.status when 'extracting' then 'paused' when 'translating' then 'paused' when 'typesetting' then 'paused' when 'exporting' then 'paused' else e.status end as status from last l join v_job_events e on e.job_id = l.job_id and row(e.ts, e.seq) = l.m",
    ),
    "k09_stale_reads": ({}, "select a.job_id, a.seq, exists (select 1 from v_job_events b where b.job_id = a.job_id and b.seq > a.seq) as stale from v_job_events a"),
    "d21_tombstones": (
        {},
        "select e.job_id, e.seq, e.status from v_job_events e where not exists (select 1 from v_job_events c where c.job_id = e.job_id and c.job_id % 2 = 0 and c.status = 'canceled' and c.seq < e.seq)",
    ),
    "e17_bucket_counts": (
        {"last": "select distinct on (job_id) job_id, status from v_job_events order by job_id, ts desc, seq desc"},
        "select count(*) as all_jobs, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'done') as done, count(*) filter (status in ('extracting', 'translating', 'typesetting', 'exporting', 'paused')) as active, count(*) filter (status = 'paused') as paused from last",
    ),
    "f13_page_regressions": ({}, "select a.doc_id, a.seq, a.page, max(b.page) as high from v_lines a join v_lines b on b.doc_id = a.doc_id and row((b.seq * 37) % 101, b.seq) < row((a.seq * 37) % 101, a.seq) group by a.doc_id, a.seq, a.page having max(b.page) > a.page"),
    "g01_reading_order": (
        {},
        "select a.doc_id, a.seq, (select count(*) from v_lines b where b.doc_id = a.doc_id and (b.page < a.page or (b.page = a.page and (b.y > a.y or (b.y = a.y and b.seq <= a.seq))))) as place from v_lines a",
    ),
    "g03_area_order": ({}, "select a.page, a.rect_id, count(*) as place from v_rects a join v_rects b on b.page = a.page and (b.w * b.h > a.w * a.h or (b.w * b.h = a.w * a.h and b.rect_id <= a.rect_id)) group by a.page, a.rect_id"),
    "f12_column_edges": ({}, "select a.page, a.rect_id, sum(b.w) as edge from v_rects a join v_rects b on b.page = a.page and b.rect_id <= a.rect_id group by a.page, a.rect_id"),
    "e20_body_pitch": (
        {
            "ranked": "select *, row_number() over (partition by doc_id, page order by seq) as r from v_lines",
            "gaps": "select a.doc_id, p.y - a.y as gap from ranked a join ranked p on p.doc_id = a.doc_id and p.page = a.page and p.r = a.r - 1 where p.y - a.y > 4 and p.y - a.y < 40",
        },
        "select doc_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] as pitch from gaps group by doc_id",
    ),
    "e01_body_size": (
        {"sizes": "select doc_id, cast(round(font_size) as bigint) as size, sum(length(text)) as weight, min(seq) as first_seq from v_lines group by all"},
        "select s.doc_id, s.size as body_size from sizes s where not exists (select 1 from sizes o where o.doc_id = s.doc_id and (o.weight > s.weight or (o.weight = s.weight and o.first_seq < s.first_seq)))",
    ),
    "d01_first_unused_match": (
        {
            "lefts": "select page, kind, list(rect_id order by rect_id) as ls from v_rects where rect_id % 3 = 0 group by page, kind",
            "rights": "select page, kind, list(rect_id order by rect_id) as rs from v_rects where rect_id % 3 = 1 group by page, kind",
        },
        "select page, ls[i] as left_id, rs[i] as right_id from (select l.page, ls, rs, unnest(range(1, least(len(ls), len(rs)) + 1)) as i from lefts l join rights r on r.page = l.page and r.kind = l.kind)",
    ),
    "d06_uncovered": (
        {"covers": "select page, list({'y': y, 'h': h}) as cs from v_rects where kind = 0 group by page"},
        "select a.page, a.rect_id from v_rects a left join covers c on c.page = a.page where a.kind <> 0 and len(list_filter(coalesce(cs, []), lambda b: abs(a.y + a.h / 2 - b.y - b.h / 2) < 0.4 * (a.h + b.h))) = 0",
    ),
    "d08_nearest_anchor": (
        {"near": "select page, rect_id, unnest(list_transform(anchors, lambda a: abs(x - a))) as far, generate_subscripts(anchors, 1) - 1 as place from v_rects join v_anchors on anchored = page"},
        "select page, rect_id, case when min(far) <= 16 then cast(arg_min(place, row(far, place)) as bigint) else -1 end as anchor from near group by page, rect_id",
    ),
    "c18_deferred_bullets": (
        {"ranked": f"select doc_id, seq, text, {DUCK.like(t.trim(DUCK, 'text'), t.BULLET_ONLY)} as marker, row_number() over (partition by doc_id order by seq) as r from v_lines"},
        "select a.doc_id, a.seq, case when p.marker then '• ' || a.text else a.text end as value from ranked a left join ranked p on p.doc_id = a.doc_id and p.r = a.r - 1 where not a.marker",
    ),
    "a10_last_write_wins": (
        {"parsed": "select doc_id, line_no, json_extract_string(line, '$.unitId') as unit_id, cast(json_extract_string(line, '$.n') as bigint) as n from (select doc_id, line_no, case when json_valid(line) then line end as line from v_log)", "solid": "select * from parsed where unit_id is not null"},
        "select s.doc_id, s.unit_id, s.n from solid s where s.n is not null and not exists (select 1 from solid o where o.doc_id = s.doc_id and o.unit_id = s.unit_id and o.line_no > s.line_no)",
    ),
    "d11_version_guard": ({}, f"select doc_id, unit_id from v_units except select doc_id, unit_id from v_prior where version = {VERSION}"),
    "d10_prior_results": ({}, "select doc_id, unit_id, exists (select 1 from v_prior p where p.doc_id = u.doc_id and p.unit_id = u.unit_id) as done from v_units u"),
    "f09_batches": (
        {
            "state": """select doc_id, list_reduce(list({'fits': length(source) between 60 and 250, 'page': page, 'runs': [cast(1 as bigint)]} order by block_no, coalesce(item_no, -1)),
              lambda a, e: {'fits': e.fits, 'page': e.page, 'runs': case when a.fits and e.fits and a.page = e.page then a.runs[:-2] || [a.runs[-1] + 1] else a.runs || [1] end}).runs as runs from v_units group by doc_id""",
            "sizes": "select doc_id, unnest(runs) as n, generate_subscripts(runs, 1) as run from state",
        },
        "select doc_id, cast(run as bigint) as run, b as batch, least(4, n - 4 * b) as units from (select doc_id, run, n, unnest(range(0, (n + 3) // 4)) as b from sizes)",
    ),
    "e10_breaker": (
        {"ranked": "select doc_id, good, row_number() over (partition by doc_id order by block_no, coalesce(item_no, -1)) as k from v_checked", "bads": "select a.doc_id, a.k, count(*) filter (not b.good) as bad from ranked a join ranked b on b.doc_id = a.doc_id and b.k <= a.k group by a.doc_id, a.k"},
        "select doc_id, min(k) as trips_at from bads where k >= 5 and bad > 0.3 * k group by doc_id",
    ),
    "d16_label_cosine": (
        {"centres": "select distinct on (label) label as l, embedding as centre from embeddings order by label, vec_id"},
        "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(centre as double[])), 6) as cosine from embeddings join centres on l = label",
    ),
    "e16_throughput": ({}, "select event_type, count(*) as n, round(sum(value) / 1000.0, 6) as total, list_sort(list(cast(round(value * 1000) as bigint)))[count(*) // 2 + 1] as p50 from events group by event_type"),
    "d24_id_set": ({}, f"select conv_id, count(*) as n, list_sort(list(turn)) = range(0, count(*)) and not bool_or({t.trim(DUCK, 'text')} = '') as complete from conversations group by conv_id"),
    "f22_chunks": ({}, "select u.doc_id, u.unit_id, (select count(*) from v_units o where o.doc_id = u.doc_id and (o.block_no < u.block_no or (o.block_no = u.block_no and coalesce(o.item_no, -1) < coalesce(u.item_no, -1)))) // 8 as chunk from v_units u"),
    "h06_patch_merge": (
        {"ranked": "select event_id, user_id, props, row_number() over (partition by user_id order by ts, event_id) as r from events"},
        "select a.event_id, a.user_id, " + ", ".join(f"coalesce(json_extract_string(case when json_valid(a.props) then a.props end, '$.{k}'), json_extract_string(case when json_valid(p.props) then p.props end, '$.{k}')) as {k}" for k in ("k", "v", "model")) + " from ranked a left join ranked p on p.user_id = a.user_id and p.r = a.r - 1",
    ),
}


def own(name: str) -> str | None:
    if name not in OWN:
        return None
    steps, result = OWN[name]
    return with_views(DUCK, result, steps=steps)
