"""The named operators as plans, each for Spark and, as an independent check, for DuckDB.

`run(name, spark, tables)` gives the Spark DataFrame of a plan over tables of one's own; a table named like a view of
docspark.plans.views takes that view's place. Plans are SQL text, so Catalyst sees all of them: filters and columns
reach the scans, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docspark.functions import text as t
from docspark.functions.dialect import DUCK, SPARK, Spark
from docspark.plans.views import STATUSES, VERSION, with_views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Plan:
    sql: Callable[[Spark], str]
    oracle: bool = True


PLANS: dict[str, Plan] = {}
_in = lambda c, names: f"{c} in ({', '.join(f"'{n}'" for n in names)})" if names else "false"


def plan(name: str, oracle: bool = True):
    def add(sql: Callable[[Spark], str]):
        PLANS[name] = Plan(sql, oracle)
        return sql

    return add


def scalar(name: str, value: Callable[[Spark], str], source: str = "v_samples", columns: str = "doc_id, seq", where: Callable[[Spark], str] | None = None) -> None:
    """A plan that computes one value for each row of a view."""
    plan(name)(lambda d: f"select {columns}, {value(d)} as value from {source}" + (f" where {where(d)}" if where else ""))


def run(name: str, spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    for key, df in tables.items():
        df.createOrReplaceTempView(key)
    return spark.sql(with_views(SPARK, PLANS[name].sql(SPARK), frozenset(tables)))


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = with_views(SPARK, PLANS[name].sql(SPARK))
    used = [x for x in TABLES if x in text]

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, spark, {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in used})

    return read


def oracle(name: str) -> str:
    """DuckDB SQL of a plan: one written apart, if there is one, else the plan's own in DuckDB's words."""
    from docspark.plans.oracles import own

    return own(name) or with_views(DUCK, PLANS[name].sql(DUCK))


# Limits of figures in points and percent of ink, and how far from a column's anchor a cell may start.
FIGURE_HEIGHT, FIGURE_WIDTH, LEAST_INK, MOST_INK, ANCHOR_REACH = 40, 60, 0.5, 12, 16

# --- Predicates and rewrites of lines -------------------------------------------------------------------------------
T = "t"
#: Parts sentences; texts do not have it.
SPLIT = "\x01"
scalar("a02_text_items", lambda d: f"abs({d.at('transform', '4')})", "v_items", where=lambda d: f"str is not null and transform is not null and {t.trim(d, 'str')} <> ''")
plan("a03_page_limit")(lambda d: "select doc_id, seq, page from v_lines join v_limits on limited = doc_id where coalesce(page_limit, 0) = 0 or page <= page_limit")
scalar("c02_edge_bands", lambda d: f"(case when {t.header_band(d, 'y', 'page_height')} then 'header' when {t.footer_band(d, 'y', 'page_height')} then 'footer' else 'body' end)")
scalar("c03_running_furniture", lambda d: t.running_furniture(d, T, "y", "page_height"))
scalar("c04_toc_entry", lambda d: t.toc_entry(d, T))
scalar("c06_roman", lambda d: t.roman(d, t.trim(d, T)))
scalar("c07_strip_page_numbers", lambda d: t.strip_page_numbers(d, T))
scalar("c08_heading_number", lambda d: t.heading_number(d, T))
scalar("c09_empty_furniture", lambda d: t.empty_furniture(d, T))
plan("c10_split_heading")(lambda d: "select doc_id, seq, " + ", ".join(f"{t.split_heading(d, T, p)} as {p}" for p in ("heading", "body", "level")) + " from v_samples")
scalar("c11_looks_like_code", lambda d: t.looks_like_code(d, T, "font_name", "font_size", "10", "(font_name = 'code')"))
scalar("c12_join_lines", lambda d: t.join_lines(d, d.lines("text")), "documents", "doc_id")
scalar("c13_clean_translation", lambda d: t.clean_translation(d, T))
scalar("c15_heading_level", lambda d: t.heading_level(d, "font_size", "10"))
scalar("c16_classify", lambda d: t.classify(d, T, "font_name", "font_size", "10", "(font_name = 'code')"))
plan("c17_list_parts")(lambda d: d.explode("v_samples", t.list_parts(d, T), "part", "place", "doc_id, seq"))
plan("c18_deferred_bullets")(
    lambda d: f"select doc_id, seq, case when before then concat('• ', text) else text end as value from (select *, coalesce(lag(marker) over (partition by doc_id order by seq), false) as before from (select *, {d.like(t.trim(d, 'text'), t.BULLET_ONLY)} as marker from v_lines)) where not marker"
)
scalar("c19_garbage", lambda d: f"round({t.garbage_ratio(d, T)}, 9)")
scalar("c20_caption_label", lambda d: t.caption_label(d, T))
scalar("c21_drop_glyphs", lambda d: f"concat({t.drop_glyphs(d, T)}, '|', {t.drop_markers(d, T)})")
scalar("c22_escape", lambda d: t.escape(d, "html"), "pages", "page_id")
scalar("c23_chapter", lambda d: t.chapter(d, f"case when seq % 2 = 0 then concat('Chapter ', {T}) else {T} end"))
scalar("c25_data_uri", lambda d: t.data_uri(d, "'jpeg'", T))
scalar("c26_safe_id", lambda d: t.safe_id(d, T))
scalar("c28_despace_cjk", lambda d: t.despace_cjk(d, T))
plan("c29_noise")(lambda d: "select doc_id, seq, " + ", ".join(f"{t.noise(d, T, k)} as {k}" for k in ("numbery", "caption", "spam", "furniture")) + " from v_samples")
plan("c30_prose_tests")(lambda d: "select doc_id, seq, " + ", ".join(f"{f(d, T)} as {n}" for n, f in (("latin", t.latin), ("han", t.han), ("index_like", t.index_like), ("table_like", t.table_like))) + " from v_samples")
scalar("c31_rare_tokens", lambda d: d.join(t.rare_tokens(d, T), "' '"))
scalar("c32_prose", lambda d: t.prose(d, T))
plan("c33_sentences")(lambda d: f"select doc_id, place, s as value from ({d.explode('documents', d.split(d.sub('text', r'([.!?])\s+', r'\1' + SPLIT), SPLIT), 's', 'place', 'doc_id')}) where {d.length(t.trim(d, 's'))} >= 30")
scalar("c34_benchmark_clean", lambda d: t.benchmark_clean(d, T))
scalar("c35_words", lambda d: t.words(d, "text"), "documents", "doc_id")
scalar("c36_fuzzy_key", lambda d: t.fuzzy_key(d, T))
scalar("c37_head_key", lambda d: t.head_key(d, T))
scalar("c38_char_class", lambda d: t.char_class(d, f"substring({T}, 1, 1)"))
scalar("c39_atoms", lambda d: d.join(t.atoms(d, T), "'¦'"))
scalar("c40_mirror", lambda d: t.mirror(d, f"case when page_id % 2 = 0 then concat('https://modelscope.cn/models/a/', cast(page_id as {d.string}), '/resolve/master/m.bin') else url end"), "pages", "page_id")
scalar("c42_hardware_error", lambda d: t.hardware_error(d, f"case when seq % 3 = 0 then concat('Vulkan device lost ', {T}) else {T} end"))
plan("c43_formatting")(
    lambda d: f"select event_id, case when secs < 60 then concat(cast(secs as {d.string}), ' s') when secs < 3600 then concat(cast(greatest(1, {d.div('secs + 30', '60')}) as {d.string}), ' min') else concat(cast({d.div('secs + 180', '3600')} as {d.string}), '.', cast({d.div('secs + 180', '360')} % 10 as {d.string}), ' h') end as eta, {d.sub('path', '^.*/')} as base_name, {d.like('lower(path)', r'[.]pdf\z')} as is_pdf from (select event_id, event_id % 9000 as secs, concat('/in/', cast(user_id as {d.string}), '/', event_type, case when event_id % 2 = 0 then '.PDF' else '.txt' end) as path from events)"
)
scalar("c44_sparse_figures", lambda d: "class", "v_rects", "page, rect_id", lambda d: f"class in ('image', 'chart') and h >= {FIGURE_HEIGHT} and w >= {FIGURE_WIDTH} and ink between {LEAST_INK} and {MOST_INK}")
scalar("c45_small_placements", lambda d: "w * h", "v_rects", "page, rect_id", lambda d: "not (w < 40 or h < 40)")
scalar("c46_clamp", lambda d: t.clamp100(d, "value * 3 - 50"), "events", "event_id")
scalar("c47_prompt", lambda d: f"concat('System', {d.newline}, {d.newline}, '原文：', {d.newline}, text, {d.newline}, {d.newline}, '译文：')", "documents", "doc_id")
plan("c48_defects")(lambda d: "select doc_id, seq, " + ", ".join(f"{t.defects(d, T, k)} as {k}" for k in ("furniture_leak", "run_on_word", "mid_word_split")) + " from v_samples")
scalar("c49_latin_residue", lambda d: d.join(t.latin_residue(d, "left_text", "right_text"), "' '"), "v_pairs", "conv_id, turn")
plan("c50_captions")(lambda d: "select doc_id, seq, " + ", ".join(f"{t.caption(d, T, k)} as {k}_caption" for k in ("line", "figure", "table")) + " from v_samples")
plan("c51_residual")(lambda d: "select doc_id, seq, " + ", ".join(f"{t.residual(d, T, k)} as {k}" for k in ("han", "latin", "english")) + " from v_samples")
scalar("j03_glossary", lambda d: t.expand_glossary(d, T))

# --- Scans ----------------------------------------------------------------------------------------------------------
plan("a10_last_write_wins")(
    lambda d: f"select doc_id, unit_id, n from (select doc_id, unit_id, n, cast(row_number() over (partition by doc_id, unit_id order by line_no desc) as bigint) as r from (select doc_id, line_no, {d.json('line', 'unitId')} as unit_id, cast({d.json('line', 'n')} as bigint) as n from v_log)) where r = 1 and unit_id is not null and n is not null"
)
plan("a13_settings")(
    lambda d: f"select event_id, coalesce({d.json('props', 'model')}, 'default') as model, coalesce({d.json('props', 'k')}, 'none') as k, coalesce(try_cast({d.json('props', 'v')} as double), 1.0) as v from events"
)
plan("a14_cache_lookup")(
    lambda d: "select u.doc_id, u.unit_id, p.result from v_units u left join (select doc_id, unit_id, case when doc_id % 5 = 0 then '' else result end as result from v_prior) p on p.doc_id = u.doc_id and p.unit_id = u.unit_id and length(p.result) > 0"
)
plan("a18_fixed_corpus")(lambda d: f"select doc_id, block_no, {d.length('source')} as n from v_units where length(source) between 120 and 400 order by doc_id, block_no, coalesce(item_no, -1) limit 80")
plan("a19_pair_output")(
    lambda d: f"select conv_id, turn, {t.trim(d, d.ext('chunk', '(?m)^SRC:(.*)$', 1))} as src, {t.trim(d, d.ext('chunk', '(?m)^ZH :(.*)$', 1))} as zh from (select conv_id, turn, concat('### ', cast(turn as {d.string}), {d.newline}, 'SRC: ', replace(left_text, {d.newline}, ' '), {d.newline}, 'ZH : ', replace(right_text, {d.newline}, ' ')) as chunk from v_pairs)"
)
SAMPLED_PAGES = lambda d: "select distinct doc_id, cast(floor(i * (n - 1) / 11.0) as bigint) + 1 as page from (" + d.explode("(select doc_id, max(page) as n from v_lines group by doc_id)", d.range("0", "11"), "i", "place", "doc_id, n") + ")"
plan("g05_sampled_pages")(SAMPLED_PAGES)
plan("a20_scanned_gate")(
    lambda d: f"select n.doc_id, {d.count_if('coalesce(p.solid, 0) >= 20')} = 0 as scanned from ({SAMPLED_PAGES(d)}) n left join (select doc_id, page, sum({t.solid_length(d, 'text')}) as solid from v_lines group by doc_id, page) p on p.doc_id = n.doc_id and p.page = n.page group by n.doc_id"
)
plan("a21_text_probe")(lambda d: f"select doc_id, page, count(*) as items, cast(sum({d.length(t.trim(d, 'text'))}) as bigint) as chars, round(avg(cast({d.length(t.trim(d, 'text'))} as double)), 6) as mean_chars from v_lines group by doc_id, page")
plan("a24_line_scrape")(lambda d: f"select doc_id, page, yr, {d.join(d.ordered('text', 'seq'), t.SPACE)} as line from (select *, cast(round(y / 28.0) as bigint) as yr from v_lines) group by doc_id, page, yr having {d.length(d.join(d.ordered('text', 'seq'), t.SPACE))} >= 20")
plan("a25_output_reread")(lambda d: f"select doc_id, {d.count_if(t.residual(d, T, 'han'))} as han_items, {d.count_if('not ' + t.residual(d, T, 'han') + ' and ' + t.residual(d, T, 'latin'))} as latin_items from v_samples group by doc_id")

# --- Page and book aggregates ---------------------------------------------------------------------------------------
plan("block_census")(lambda d: f"select lang, kind, count(*) as lines, cast(sum({d.length('text')}) as bigint) as chars from v_kinds group by lang, kind")
plan("c05_toc_pages")(
    lambda d: f"select doc_id, page, count(*) as lines, {d.count_if('entry')} as entries from (select doc_id, seq % 7 as page, {t.toc_title(d, T)} as title, not {t.toc_title(d, T)} and {t.toc_entry(d, T)} as entry from v_samples where {t.trim(d, T)} <> '') group by doc_id, page having count(*) >= 4 and (({d.count_if('title')} > 0 and {d.count_if('entry')} >= 3) or {d.count_if('entry')} > 0.3 * count(*))"
)
plan("e01_body_size")(
    lambda d: f"select doc_id, {d.arg_max('size', 'weight', '-first_seq')} as body_size from (select doc_id, cast(round(font_size) as bigint) as size, cast(sum({d.length('text')}) as bigint) as weight, min(seq) as first_seq from v_lines group by doc_id, cast(round(font_size) as bigint)) group by doc_id"
)
REPEATED = """select source, key from (select source, key, count(distinct doc_id) as pages from (select source, doc_id, {key} as key from v_lines where y >= page_height * 0.88 or y <= page_height * 0.12) where key <> '' and length(key) <= 80 group by source, key)
  join (select source as s, count(distinct doc_id) as n from v_lines group by source) on s = source where n >= 8 and pages >= greatest(4, cast(floor(n * 0.4) as bigint))"""
plan("e04_repeated_edge_text")(lambda d: f"select l.source, count(*) as dropped from (select source, {t.head_key(d, 'text')} as key from v_lines) l join ({REPEATED.format(key=t.head_key(d, 'text'))}) r on r.source = l.source and r.key = l.key group by l.source")
plan("d04_prose_lines")(
    lambda d: f"select l.source, count(*) as lines, cast(sum({d.length('l.text')}) as bigint) as chars from (select *, {t.head_key(d, 'text')} as key from v_lines) l left join (select source as rs, key as rk from ({REPEATED.format(key=t.head_key(d, 'text'))})) r on rs = l.source and rk = l.key where rs is null group by l.source"
)
plan("d03_code_fonts")(lambda d: f"select l.doc_id, count(*) as code_lines from v_samples l join (select distinct doc_id, font_name from v_samples where {t.definitive_code(d, T)}) f on f.doc_id = l.doc_id and f.font_name = l.font_name group by l.doc_id")
plan("e05_line_rollup")(lambda d: f"select doc_id, page, max(font_size) as font_size, {d.arg_max('font_name', '-seq')} as font_name, min(x) as x, {d.arg_max('y', '-seq')} as y from v_lines group by doc_id, page")
plan("e11_capture_audit")(
    lambda d: "select doc_id, count(*) as lines, " + ", ".join(f"{d.count_if(t.defects(d, T, k))} as {k}" for k in ("furniture_leak", "run_on_word", "mid_word_split")) + f", max({d.length(T)}) as longest from v_samples group by doc_id"
)
plan("e12_block_types")(lambda d: f"select kind, count(*) as blocks, {d.count_if(d.like('body', '^[a-z]'))} as lower_starts, {d.count_if('length(body) < 20')} as tiny from v_blocks group by kind")
plan("e20_body_pitch")(
    lambda d: f"select doc_id, coalesce({d.at(d.ordered('gap', 'gap'), d.div('count(gap)', '2') + ' + 1')}, 14.0) as pitch from (select doc_id, case when gap > 4 and gap < 40 then gap end as gap from (select doc_id, lag(y) over (partition by doc_id, page order by seq) - y as gap from v_lines)) where gap is not null group by doc_id"
)
#: Lines in an order that is not that of their pages.
MIXED = "(seq * 37) % 101, seq"
plan("f13_page_regressions")(lambda d: f"select doc_id, seq, page, high from (select *, max(page) over (partition by doc_id order by {MIXED} rows between unbounded preceding and 1 preceding) as high from v_lines) where page < high")
plan("g01_reading_order")(lambda d: "select doc_id, seq, cast(row_number() over (partition by doc_id order by page, y desc, seq) as bigint) as place from v_lines")
plan("g02_fragment_order")(lambda d: "select doc_id, page, seq, cast(row_number() over (partition by doc_id, page order by y desc, x, seq) as bigint) as place from v_lines")
plan("g06_first_of_class")(lambda d: "select doc_id, kind, seq from (select doc_id, kind, seq, cast(row_number() over (partition by doc_id, kind order by seq) as bigint) as r from v_kinds) where r <= 3")
plan("g08_arg_max")(lambda d: f"select doc_id, {d.arg_max('seq', d.length('text'), '-seq')} as longest_line from v_lines group by doc_id")
plan("g10_systematic_sample")(lambda d: f"select conv_id, turn from (select *, cast(row_number() over (partition by conv_id order by turn) as bigint) - 1 as k, count(*) over (partition by conv_id) as n from v_pairs) where k % greatest(1, cast(ceil(n / 8.0) as bigint)) = 0")
plan("h01_union_entries")(lambda d: "select doc_id as owner, 'prose' as what, count(*) as n from v_lines group by doc_id union all select page, 'region', count(*) from v_rects group by page")
plan("e27_translatable_units")(lambda d: "select doc_id, count(distinct page) as pages, count(*) as units from v_units group by doc_id")
plan("e30_script_ratio")(lambda d: f"select doc_id, round(cast(sum({d.count(T, f'[{t.HAN}]')}) as double) / sum({d.length(T)}), 9) as han_ratio from v_samples group by doc_id")

# --- Islands and packing --------------------------------------------------------------------------------------------
plan("f02_gutter")(
    lambda d: f"select page, {d.arg_max('mid', 'gap', '-x')} as gutter from (select page, x, x - before as gap, (x + before) / 2 as mid from (select page, x, lag(x) over (partition by page order by x, rect_id) as before from v_rects)) where gap >= 0.02 * 500 and mid between 0.28 * 500 and 0.72 * 500 group by page"
)
plan("f05_table_runs")(
    lambda d: f"select doc_id, run, count(*) as lines, min(seq) as first_seq from (select *, cast(sum(case when before is null or abs(before - y) > 2.5 * greatest(size_before, font_size) then 1 else 0 end) over (partition by doc_id, page order by seq) as bigint) as run from (select *, lag(y) over (partition by doc_id, page order by seq) as before, lag(font_size) over (partition by doc_id, page order by seq) as size_before from v_lines where font_name = 'code')) group by doc_id, page, run having count(*) >= 2 and {d.count_if(d.like('text', t.ASCII_DUMP))} < 2"
)
plan("f06_table_rows")(
    lambda d: f"select doc_id, page, line_row, {d.join(d.ordered('text', 'seq'), t.SPACE)} as cells from (select *, cast(sum(case when before - y > 1.6 * font_size then 1 else 0 end) over (partition by doc_id, page order by seq) as bigint) as line_row from (select *, lag(y) over (partition by doc_id, page order by seq) as before from v_lines where font_name = 'code')) group by doc_id, page, line_row"
)
plan("f07_blocks")(lambda d: f"select doc_id, block_no, kind, page, top_y, {d.size('items')} as members, {d.length('body')} as chars from v_blocks")
plan("j01_units")(lambda d: f"select doc_id, unit_id, page, {d.length('source')} as chars from v_units where not {t.garbage(d, 'source')}")
PACK = "select *, cast(sum(case when fits and fits_before and page = page_before then 0 else 1 end) over (partition by doc_id order by block_no, coalesce(item_no, -1)) as bigint) as run from (select *, lag(fits) over (partition by doc_id order by block_no, coalesce(item_no, -1)) as fits_before, lag(page) over (partition by doc_id order by block_no, coalesce(item_no, -1)) as page_before from (select *, length(source) between 60 and 250 as fits from v_units))"
BATCHED = f"select *, {{div}} as batch from (select *, cast(row_number() over (partition by doc_id, run order by block_no, coalesce(item_no, -1)) as bigint) - 1 as k from ({PACK}))"
plan("f09_batches")(lambda d: f"select doc_id, run, batch, count(*) as units from ({BATCHED.format(div=d.div('k', '4'))}) group by doc_id, run, batch")
plan("j13_carrier")(
    lambda d: f"select doc_id, run, batch, {d.join(d.ordered(f"concat(cast(k % 4 + 1 as {d.string}), '. ', source)", 'k'), d.newline)} as carrier from ({BATCHED.format(div=d.div('k', '4'))}) group by doc_id, run, batch having count(*) > 1"
)
plan("f15_segments")(
    lambda d: f"select doc_id, page, segment, count(*) as lines, {d.join(d.ordered('text', 'seq'), t.SPACE)} as body from (select *, cast(sum(case when gap is null or gap > 1.9 * 14 or len_before < 0.72 * length(text) then 1 else 0 end) over (partition by doc_id, page order by seq) as bigint) as segment from (select *, lag(y) over (partition by doc_id, page order by seq) - y as gap, lag(length(text)) over (partition by doc_id, page order by seq) as len_before from v_lines)) group by doc_id, page, segment"
)
plan("f22_chunks")(lambda d: f"select doc_id, unit_id, {d.div('cast(row_number() over (partition by doc_id order by block_no, coalesce(item_no, -1)) as bigint) - 1', '8')} as chunk from v_units")
plan("f12_column_edges")(lambda d: "select page, rect_id, sum(w) over (partition by page order by rect_id rows unbounded preceding) as edge from v_rects")
plan("d10_prior_results")(lambda d: "select u.doc_id, u.unit_id, p.result is not null as done from v_units u left join v_prior p on p.doc_id = u.doc_id and p.unit_id = u.unit_id")
plan("d11_version_guard")(lambda d: f"select u.doc_id, u.unit_id from v_units u left join (select doc_id as pd, unit_id as pu from v_prior where version = {VERSION}) p on pd = u.doc_id and pu = u.unit_id where pd is null")
plan("d13_write_back")(
    lambda d: f"select doc_id, block_no, {d.join(d.ordered('body', 'coalesce(item_no, -1)'), d.newline)} as body from (select u.doc_id, u.block_no, u.item_no, coalesce(p.result, u.source) as body from v_units u left join v_prior p on p.doc_id = u.doc_id and p.unit_id = u.unit_id) group by doc_id, block_no"
)
plan("b05_current_version")(lambda d: f"select doc_id, unit_id, version, case when version = {VERSION} then 'translation.jsonl' else 'translation.jsonl.stale' end as file from v_prior")

# --- Validation and reports -----------------------------------------------------------------------------------------
HAS_CJK = lambda d, x: d.like(x, f"[{t.HAN}]")
RULES = {"j06_empty": "empty", "j07_sentinel_leak": "sentinel-leak", "j08_echo": "echo", "j09_untranslated_latin": "untranslated-latin", "j10_number_dropped": "number-dropped", "j11_length_ratio": "length-ratio", "j12_marker_leak": "marker-leak"}
plan("h02_sentinel_difference")(lambda d: f"select doc_id, unit_id, {d.join('lost', t.EMPTY)} as lost, {d.join('extra', t.EMPTY)} as extra from v_checked")
plan("h03_dropped_numbers")(lambda d: f"select doc_id, unit_id, {d.join('dropped', t.COMMA)} as dropped from v_checked")
plan("g09_first_dropped")(lambda d: f"select doc_id, unit_id, {d.join(d.slice('dropped', 1, 4), t.COMMA)} as dropped from v_checked")
plan("j05_model_output")(lambda d: f"select doc_id, unit_id, {d.join('output_reasons', t.SEMICOLON)} as reasons from v_checked")
for _id, _rule in RULES.items():
    plan(_id)(lambda d, rule=_rule: f"select doc_id, unit_id, {d.exists('restored_reasons', 'r', d.starts('r', f'{t.QUOTE}{rule}{t.QUOTE}'))} as failed from v_checked")
plan("h05_all_reasons")(lambda d: f"select doc_id, unit_id, {d.join('reasons', t.SEMICOLON)} as reasons from v_checked")
plan("e09_counters")(lambda d: f"select count(*) as total, {d.count_if('good')} as ok_units, {d.count_if('not good')} as fallbacks from v_checked")
plan("e10_breaker")(
    lambda d: "select doc_id, min(k) as trips_at from (select doc_id, cast(row_number() over w as bigint) as k, cast(sum(case when good then 0 else 1 end) over w as bigint) as bad from v_checked window w as (partition by doc_id order by block_no, coalesce(item_no, -1) rows between unbounded preceding and current row)) where k >= 5 and bad > 0.3 * k group by doc_id"
)


def marks(d: Spark) -> str:
    """What is to be reported of each unit, in one pass: that it fell back, and that its source is garbage."""
    found = d.filter(d.array("case when not good then 'fallback' end", f"case when {t.garbage(d, 'source')} then 'garbage' end"), "m", "m is not null")
    return d.explode("v_checked", found, "why", "place", "doc_id, unit_id, page")


plan("b08_quality_report")(lambda d: f"select doc_id, unit_id, page, why from ({marks(d)})")
plan("h04_badge_keys")(lambda d: f"select doc_id, unit_id from v_checked where not good or {t.garbage(d, 'source')}")
plan("d14_badges")(lambda d: "select doc_id, unit_id, case when good then 'plain' else 'plain badge' end as class from v_checked")
plan("e15_output_proxies")(
    lambda d: f"select conv_id, round(avg(cast(case when {HAS_CJK(d, 'right_text')} then 0 else 1 end as double)), 9) as untranslated, round(avg(cast({d.size(t.latin_residue(d, 'left_text', 'right_text'))} as double)), 9) as residue, round(avg(case when length(left_text) > 0 then cast(length(right_text) as double) / length(left_text) end), 9) as length_ratio from v_pairs group by conv_id"
)
plan("e16_throughput")(
    lambda d: f"select event_type, count(*) as n, round(sum(value) / 1000.0, 6) as total, {d.at(d.ordered('ms', 'ms'), d.div('count(*)', '2') + ' + 1')} as p50 from (select event_type, value, cast(round(value * 1000) as bigint) as ms from events) group by event_type"
)
plan("e31_run_summary")(lambda d: "select user_id, round(avg(value), 6) as mean, min(value) as low, max(value) as high, count(*) as n from events where value is not null group by user_id")
#: A case passes if its output has Latin text and a sound length; run b is run a with some outputs cut.
PASSES = lambda d, out: f"({t.residual(d, out, 'latin')} and length(left_text) > 0 and cast(length({out}) as double) / length(left_text) between 0.12 and 2.2)"
plan("e23_gate")(
    lambda d: f"select conv_id, total, passed_a, passed_b, passed_a > passed_b as better, same = total as identical from (select conv_id, count(*) as total, {d.count_if(PASSES(d, 'out_a'))} as passed_a, {d.count_if(PASSES(d, 'out_b'))} as passed_b, {d.count_if('out_a = out_b')} as same from (select conv_id, left_text, right_text as out_a, case when (conv_id + turn) % 4 = 0 then substring(right_text, 1, 3) else right_text end as out_b from v_pairs) group by conv_id)"
)


def sentence_ends(d: Spark) -> str:
    """Ends of sentences in the middle of a source: how far from its middle, and where, as one number."""
    near = d.filter(d.range("1", d.length("source")), "i", "i between 0.3 * length(source) and 0.7 * length(source) and substring(source, cast(i as int), 1) in ('.', '!', '?')")
    middle = d.div(d.length("source"), "2")
    return d.map(near, "i", f"cast(abs(i - {middle}) * 100000 + i as bigint)")


plan("f20_sentence_boundary")(
    lambda d: f"select doc_id, unit_id, coalesce({d.least_of(sentence_ends(d))}, cast(-1 as bigint)) as nearest from v_units where length(source) > 20"
)

# --- Geometry -------------------------------------------------------------------------------------------------------
plan("d01_first_unused_match")(
    lambda d: "select a.page, a.rect_id as left_id, b.rect_id as right_id from (select *, cast(row_number() over (partition by page, kind order by rect_id) as bigint) as k from v_rects where rect_id % 3 = 0) a join (select *, cast(row_number() over (partition by page, kind order by rect_id) as bigint) as k from v_rects where rect_id % 3 = 1) b on b.page = a.page and b.kind = a.kind and b.k = a.k"
)
plan("d02_unmatched")(lambda d: "select a.page, a.rect_id from v_rects a left join (select distinct page as p, kind as k from v_rects where kind = 1) b on p = a.page and k = a.kind where p is null")
plan("d05_lines_in_regions")(lambda d: "select r.page, r.rect_id, count(*) as inside from v_rects r join v_rects p on p.page = r.page and p.x between r.x - 2 and r.x + r.w + 2 and p.y between r.y - 2 and r.y + r.h + 2 group by r.page, r.rect_id")
plan("d06_uncovered")(lambda d: "select a.page, a.rect_id from v_rects a where a.kind <> 0 and not exists (select 1 from v_rects b where b.kind = 0 and b.page = a.page and abs((a.y + a.h / 2) - (b.y + b.h / 2)) < 0.4 * (a.h + b.h))")
plan("d08_nearest_anchor")(
    lambda d: f"select page, rect_id, case when {d.least_of('far')} <= {ANCHOR_REACH} then {d.position_of('far', d.least_of('far'))} - 1 else cast(-1 as bigint) end as anchor from (select page, rect_id, {d.map('anchors', 'a', 'abs(x - a)')} as far from v_rects join v_anchors on anchored = page)"
)
plan("d09_side_by_side")(lambda d: "select a.page, count(*) as n from v_rects a where exists (select 1 from v_rects b where b.page = a.page and b.rect_id <> a.rect_id and abs(a.y - b.y) < 6 and b.x > a.x + a.w) group by a.page having count(*) >= 3")
plan("e03_anchor_support")(lambda d: "select c.page, c.rect_id, count(*) as support from v_rects c join v_rects p on p.page = c.page and abs(p.x - c.x) <= 14 group by c.page, c.rect_id having count(*) >= 3")
plan("d07_overlap_iou")(
    lambda d: "select a.page, a.rect_id as left_id, b.rect_id as right_id, round(i / (a.w * a.h + b.w * b.h - i), 9) as iou from (select a.page, a.rect_id, a.w, a.h, b.rect_id as other, b.w as bw, b.h as bh, greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i from v_rects a join v_rects b on b.page = a.page and b.rect_id > a.rect_id) a join v_rects b on b.page = a.page and b.rect_id = a.other where i > 0"
)
plan("g03_area_order")(lambda d: "select page, rect_id, cast(row_number() over (partition by page order by w * h desc, rect_id) as bigint) as place from v_rects")
TABLE_CELLS = lambda d: f"(select doc_id, seq, {d.map(d.split('text', r'\|'), 'c', t.trim(d, 'c'))} as cells from v_lines where font_name = 'code')"
plan("c14_header_row")(lambda d: f"select doc_id, seq, {d.size('cells')} >= 2 and {d.forall('cells', 'c', 'length(c) between 1 and 24')} as header from {TABLE_CELLS(d)}")
plan("e06_column_widths")(lambda d: f"select page, rect_id, round(gap / sum(gap) over (partition by page), 9) as width from (select page, rect_id, greatest(24.0, coalesce(lead(x) over (partition by page order by x, rect_id) - x, 24.0)) as gap from v_rects)")
plan("e07_empty_cells")(lambda d: f"select doc_id, count(*) as rows_kept, max({d.size(d.filter('cells', 'c', 'length(c) > 0'))}) as cols from {TABLE_CELLS(d)} where {d.exists('cells', 'c', 'length(c) > 0')} group by doc_id having count(*) >= 2 and max({d.size(d.filter('cells', 'c', 'length(c) > 0'))}) >= 2")
plan("e21_content_widths")(lambda d: "select page, rect_id, round(greatest(48.0, 500 * (0.45 * w / sum(w) over (partition by page) + 0.55 * h / sum(h) over (partition by page))), 6) as width from v_rects")
plan("b10_table_html")(lambda d: f"select doc_id, seq, concat('<tr>', {d.join(d.map('cells', 'c', f"concat('<td>', {t.escape(d, 'c')}, '</td>')"), t.EMPTY)}, '</tr>') as html from {TABLE_CELLS(d)}")
BLOCK_HTML = lambda d: (
    f"case kind when 'heading' then concat('<h1', case when {t.chapter(d, 'body')} then ' class=\"chapter\"' else '' end, '>', {t.escape(d, 'body')}, '</h1>') when 'code' then concat('<pre>', {t.escape(d, 'body')}, '</pre>') "
    f"when 'list-item' then concat('<ul><li>', {d.join(d.map('items', 'i', t.escape(d, 'i')), "'</li><li>'")}, '</li></ul>') else concat('<p>', {t.escape(d, 'body')}, '</p>') end"
)
plan("b09_document_html")(lambda d: f"select doc_id, {d.join(d.ordered('html', 'block_no'), d.newline)} as html from (select doc_id, block_no, {BLOCK_HTML(d)} as html from v_blocks) group by doc_id")

# --- Cache, similarity, alignment -----------------------------------------------------------------------------------
KEY = lambda d, source, masked: d.sha256(f"concat({f', {d.control(1)}, '.join(["'m1'", "'v3'", "'0.1'", "'20'", "'0.9'", source, masked])})")
plan("d12_cache_keys")(lambda d: f"select doc_id, unit_id, {KEY(d, 'full_source', 'masked')} as key from v_masked")
plan("e19_cache_size")(lambda d: f"select count(distinct {KEY(d, 'full_source', 'masked')}) as entries from v_masked")
plan("b07_cache_shards")(lambda d: f"select distinct key, concat(substring(key, 1, 2), '/', key, '.json') as path from (select {KEY(d, 'full_source', 'masked')} as key from v_masked)")
plan("e14_repeat_rate")(lambda d: f"select count(*) as units, count(*) - count(distinct {t.fuzzy_key(d, 'source')}) as repeats, round(cast(100 * (count(*) - count(distinct {t.fuzzy_key(d, 'source')})) as double) / count(*), 1) as percent from v_units")
ASCII = lambda d, x: d.sub(x, "[^ -~]", "?")  # noqa: E731  DuckDB counts edits of bytes
plan("d17_nearest_prior")(
    lambda d: f"select conv_id, turn, max(round(sim, 6)) as best from (select a.conv_id, a.turn, 1.0 - cast(levenshtein(a.body, b.body) as double) / greatest(length(a.body), length(b.body)) as sim from (select conv_id, turn, {ASCII(d, 'left_text')} as body from v_pairs where length(left_text) > 0) a join (select conv_id, turn, {ASCII(d, 'left_text')} as body from v_pairs where length(left_text) > 0) b on b.conv_id = a.conv_id and b.turn < a.turn and least(length(a.body), length(b.body)) >= 0.5 * greatest(length(a.body), length(b.body))) group by conv_id, turn"
)
plan("f23_edit_distance")(lambda d: f"select conv_id, turn, cast(levenshtein({ASCII(d, 'left_text')}, {ASCII(d, 'right_text')}) as bigint) as distance from v_pairs")
plan("d16_label_cosine")(
    lambda d: f"select vec_id, round({d.dot('embedding', 'centre')} / sqrt({d.dot('embedding', 'embedding')} * {d.dot('centre', 'centre')}), 6) as cosine from embeddings join (select label as l, {d.arg_max('embedding', '-vec_id')} as centre from embeddings group by label) on l = label"
)
#: Logarithm of the least rarity of a token that counts, the least weight of a link, and the ratios of solid lengths between which it may be.
IDF_FLOOR, LEAST_WEIGHT, RATIOS = "ln(1 / cast(0.12 as double))", 2.0, (1.2, 8)
SIDES = lambda d: f"(select conv_id, turn, 'L' as side, {t.solid_length(d, 'left_text')} as n, left_text as body from v_pairs union all select conv_id, turn, 'R', {t.solid_length(d, 'right_text')}, right_text from v_pairs)"
TOKENS = lambda d: d.explode(SIDES(d), t.rare_tokens(d, "body"), "token", "place", "conv_id, turn, side, n")
IDF = lambda d: f"(select token, ln((select cast(2 * count(*) as double) from v_pairs) / count(*)) as idf from ({TOKENS(d)}) group by token)"
plan("e13_document_frequency")(lambda d: f"select token, df, round(idf, 9) as idf, idf >= {IDF_FLOOR} as counts from (select token, df, ln((select cast(2 * count(*) as double) from v_pairs) / df) as idf from (select token, count(*) as df from ({TOKENS(d)}) group by token))")
plan("d15_token_overlap")(
    # tokens of one conversation and side by side first, so that only rare ones are joined
    lambda d: f"""select l.conv_id, l.turn as left_turn, r.turn as right_turn, count(*) as anchors, round(sum(l.idf), 6) as weight
      from (select x.*, idf from ({TOKENS(d)}) x join {IDF(d)} f on f.token = x.token where side = 'L' and n >= 20 and idf >= {IDF_FLOOR}) l join ({TOKENS(d)}) r on r.conv_id = l.conv_id and r.token = l.token and r.side = 'R' and r.n >= 8 and l.n between {RATIOS[0]} * r.n and {RATIOS[1]} * r.n
      group by l.conv_id, l.turn, r.turn having sum(l.idf) >= {LEAST_WEIGHT}"""
)
plan("h07_token_intersection")(lambda d: f"select conv_id, turn, {d.size(d.filter(t.rare_tokens(d, 'left_text'), 'w', d.has(t.rare_tokens(d, 'right_text'), 'w')))} as shared from v_pairs")
SYSTEM = "'Translate the text.'"
MESSAGE = lambda d, role, text: ("named_struct('role', '%s', 'content', %s)" if d.name == "spark" else "{'role': '%s', 'content': %s}") % (role, text)
plan("b14_sft_records")(lambda d: f"select conv_id, turn, {d.to_json({'messages': d.array(MESSAGE(d, 'system', SYSTEM), MESSAGE(d, 'user', 'left_text'), MESSAGE(d, 'assistant', 'right_text'))})} as line from v_pairs")
plan("b16_case_counts")(lambda d: f"select kind, count(*) as cases, {d.count_if('length(text) > 100')} as hits from v_kinds group by kind")
plan("d18_prefix_picks")(
    lambda d: f"select item_id, doc_id from (select b.item_id, x.doc_id, cast(row_number() over (partition by b.item_id order by x.doc_id) as bigint) as r from (select item_id, lower(substring({d.sub('text', r'\s+')}, 1, 24)) as prefix from benchmark) b join (select doc_id, lower(substring({d.sub('text', r'\s+')}, 1, 24)) as head from v_lines) x on x.head = b.prefix) where r = 1"
)
plan("d22_glossary_hits")(lambda d: f"select doc_id, seq, {d.count(T, '(?:^|[^A-Za-z0-9_])(?:' + '|'.join(sorted(t.GLOSSARY, key=len, reverse=True)) + ')(?:[^A-Za-z0-9_]|' + r'\z)')} as hits from v_samples")
plan("d24_id_set")(lambda d: f"select conv_id, count(*) as n, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) and {d.count_if(f"{t.trim(d, 'text')} = ''")} = 0 as complete from conversations group by conv_id")
plan("j21_rule_carrier")(lambda d: f"select conv_id, turn, {d.size(d.split(f"concat(left_text, {d.newline}, '---', {d.newline}, right_text)", r'\n---\n'))} = 2 as accepted from v_pairs")

RESULT_UNITS = lambda d: f"select doc_id, unit_id, source as body, block_no as n from v_units union all select doc_id, concat('t', cast(seq as {d.string}), '-r0c', cast(place as {d.string})), cell, seq + place from ({d.explode(TABLE_CELLS(d), 'cells', 'cell', 'place', 'doc_id, seq')})"
# --- Evaluation, layout census and stored results -------------------------------------------------------------------
plan("d23_stored_results")(
    # results by the id of a block, or of a table's cell
    lambda d: f"""select c.doc_id, c.unit_id, coalesce(r.result, c.body) as body from ({RESULT_UNITS(d)}) c left join (select doc_id, unit_id, concat('done ', body) as result from ({RESULT_UNITS(d)}) where (doc_id + n) % 3 = 0) r on r.doc_id = c.doc_id and r.unit_id = c.unit_id"""
)
REQUIRED_GLYPHS = "ŠšŽžéèñüæœßłø"
plan("e29_missing_glyphs")(lambda d: "select source, concat(" + ", ".join(f"case when max(case when contains(text, '{c}') then 1 else 0 end) = 0 then '{c}' else '' end" for c in REQUIRED_GLYPHS) + ") as missing from documents where text is not null group by source")
plan("b15_output_dump")(lambda d: f"select conv_id, {d.join(d.ordered(f"concat('### ', cast(turn as {d.string}), {d.newline}, 'SRC: ', left_text, {d.newline}, 'ZH : ', right_text, {d.newline})", 'turn'), d.newline)} as dump from v_pairs group by conv_id")
plan("j17_json_carrier")(
    lambda d: f"select conv_id, coalesce({d.size('items')} = n and {d.forall(d.range('1', 'n'), 'k', d.has(d.map('items', 'x', 'x.id'), 'k'))} and {d.forall('items', 'x', f"coalesce({t.trim(d, 'x.zh')} <> '', false)")}, false) as accepted from (select conv_id, n, {d.parse_items('answer')} as items from v_json_answers)"
)
#: Languages of code in a label, how much of it is read, and how sure a label must be. The words are of this library.
CODE_WORDS = {
    "typescript": "interface|readonly|implements|namespace|enum", "javascript": "function|const|let|var|await|async", "python": "def|import|elif|self|lambda|None", "bash": "fi|esac|echo|export|done", "shell": "sudo|cd|ls|grep|mkdir",
    "json": "true|false|null", "yaml": "apiVersion|metadata|kind|spec", "sql": "SELECT|FROM|WHERE|JOIN|GROUP|INSERT", "go": "func|chan|defer|package|nil", "java": "public|static|void|extends|throws", "c": "printf|malloc|struct|typedef|sizeof",
    "cpp": "std|cout|template|typename|nullptr", "csharp": "using|foreach|sealed|override|Console", "rust": "fn|mut|impl|pub|match", "xml": "xmlns|xsl|DOCTYPE", "markdown": "README|TODO", "diff": "index|diff", "dockerfile": "RUN|COPY|ENTRYPOINT|WORKDIR", "ini": "section|option",
    "properties": "log4j|appender",
}
CODE_CHARS, LEAST_RELEVANCE = 20_000, 5


def code_language(d: Spark) -> str:
    """The language that most words of a text belong to, the first of equals; empty if they are few."""
    counts = ", ".join(f"{d.count('code', '[^A-Za-z0-9_](?:' + words + ')[^A-Za-z0-9_]')} as n{k}" for k, words in enumerate(CODE_WORDS.values()))
    best = f"greatest({', '.join(f'n{k}' for k in range(len(CODE_WORDS)))})"
    label = " ".join(f"when n{k} = {best} then '{name}'" for k, name in enumerate(CODE_WORDS))
    return f"select doc_id, case when {best} < {LEAST_RELEVANCE} then '' {label} end as language from (select doc_id, {counts} from (select doc_id, concat(' ', substring(text, 1, {CODE_CHARS}), ' ') as code from documents where text is not null))"


plan("c24_code_language")(code_language)
plan("e08_ink_percent")(
    # an embedding's values as an image of 8 x 8; boxes that are too narrow count as full
    lambda d: f"select vec_id, case when vec_id % 9 < 2 then cast(100 as double) else round(cast(100 * {d.size(d.filter('embedding', 'v', 'cast(floor(abs(v) * 1000) as bigint) % 256 < 160'))} as double) / 64, 6) end as ink from embeddings"
)
LAYOUT_CLASSES = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "table_title", "reference", "doc_title", "footnote", "header", "algorithm", "footer", "seal", "chart_title", "chart", "formula_number", "header_image",
    "footer_image", "aside_text",
)
LEAST_SCORE = 0.3
plan("a09_known_boxes")(lambda d: f"select page, rect_id, class, ink / 100 as score from v_rects where ink / 100 >= {LEAST_SCORE} and {_in('class', LAYOUT_CLASSES)}")
plan("e18_detector_recall")(
    lambda d: f"select count(*) as captioned, {d.count_if('hit')} as hits, round(cast(100 * {d.count_if('hit')} as double) / greatest(1, count(*)), 1) as recall_pct from (select page, max(case when class in ('image', 'chart', 'table') and ink / 100 >= {LEAST_SCORE} then 1 else 0 end) = 1 as hit from v_rects where page % 3 = 0 group by page)"
)
plan("g07_top_classes")(lambda d: "select event_type, count(*) as n from events group by event_type order by n desc, event_type limit 12")
plan("g11_seeded_sample")(lambda d: f"select conv_id, turn from v_pairs order by md5(concat('7:', cast(conv_id as {d.string}), ':', cast(turn as {d.string}))), conv_id, turn limit 8")
plan("e24_figure_census")(
    lambda d: f"select bucket, count(*) as pages from (select case when placements = 0 and draws > 20 then 'vector-only' when placements > 0 then 'placed' else 'other' end as bucket from (select page, {d.count_if("class = 'image' and ink > 60")} as placements, cast(sum(case when class = 'text' then rect_id % 9 else 0 end) as bigint) as draws from v_rects group by page)) group by bucket"
)
plan("e25_ink_partition")(lambda d: f"select class, {d.count_if(f'ink > {MOST_INK}')} as high, {d.count_if(f'ink <= {MOST_INK}')} as low from v_rects group by class")

# --- Jobs -----------------------------------------------------------------------------------------------------------
LEGAL = {"queued": ["extracting", "canceled"], "paused": ["queued", "canceled"], "error": ["queued", "canceled"], "canceled": ["queued"], "done": []}
_PHASES = STATUSES[1:6]
LEGAL |= {a: [b, "paused", "canceled", "error"] for a, b in zip(_PHASES, _PHASES[1:], strict=False)}
ACTIVE = STATUSES[1:5]
legal = lambda a, b: "(" + f"{a} = {b} or " + " or ".join(f"({a} = '{k}' and {_in(b, v)})" for k, v in LEGAL.items()) + ")"
plan("k01_transitions")(lambda d: f"select job_id, seq, status, before, before is null or {legal('before', 'status')} as legal from (select *, lag(status) over (partition by job_id order by ts, seq) as before from v_job_events)")
plan("k02_capabilities")(lambda d: f"select job_id, seq, {_in('status', ACTIVE)} as can_pause, {_in('status', ['paused', 'error', 'canceled'])} as can_resume, not {_in('status', ['canceled', 'done'])} as can_cancel, not {_in('status', ACTIVE)} as can_delete from v_job_events")
LATEST = lambda d: f"(select job_id, {d.arg_max('status', 'ts', 'seq')} as status, min(seq) as first_seq from v_job_events group by job_id)"
plan("k05_orphan_repair")(lambda d: f"select job_id, case when {_in('status', ACTIVE)} then 'paused' else status end as status from {LATEST(d)}")
plan("d20_upsert")(lambda d: f"select job_id, status, first_seq from {LATEST(d)}")
plan("d21_tombstones")(lambda d: "select e.job_id, e.seq, e.status from v_job_events e left join v_removals on gone = e.job_id and e.seq > gone_at where gone is null")
plan("k09_stale_reads")(lambda d: "select job_id, seq, seq < max(seq) over (partition by job_id) as stale from v_job_events")
plan("k08_phase_progress")(
    lambda d: "select job_id, seq, case status when 'extracting' then progress * 0.05 when 'translating' then 5 + progress * 0.85 when 'typesetting' then 92.0 when 'exporting' then 98 + progress * 0.02 when 'done' then 100.0 else 0.0 end as overall from v_job_events"
)
plan("c27_status_buckets")(lambda d: f"select job_id, seq, case when status = 'queued' then 'queued' when status = 'done' then 'done' when {_in('status', [*ACTIVE, 'paused'])} then 'active' else 'all' end as bucket from v_job_events")
plan("e17_bucket_counts")(lambda d: f"select count(*) as all_jobs, {d.count_if(_in('status', ['queued']))} as queued, {d.count_if(_in('status', ['done']))} as done, {d.count_if(_in('status', [*ACTIVE, 'paused']))} as active, {d.count_if(_in('status', ['paused']))} as paused from {LATEST(d)}")
plan("g04_oldest_queued")(lambda d: f"select job_id, first_seq from {LATEST(d)} where status = 'queued' order by first_seq limit 1")
#: Known settings; others of a patch are dropped.
SETTINGS = ("k", "v", "model")
plan("h06_patch_merge")(lambda d: "select event_id, user_id, " + ", ".join(f"coalesce({d.json('patch_json', k)}, {d.json('current_json', k)}) as {k}" for k in SETTINGS) + " from v_patches")

# --- Not of the original: relational extras over the star schema ------------------------------------------------------
plan("x01_pricing_summary")(
    lambda d: "select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus"
)
plan("x02_revenue_by_nation")(
    lambda d: "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(name) for name, p in PLANS.items() if p.oracle}
