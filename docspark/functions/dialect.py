"""SQL text for Spark and for DuckDB from one definition, where the two engines spell a function differently.

Patterns are written for both regular-expression dialects: ASCII classes, `\\z` for the end of a text, no look-around.
In replacements `\\1` stands for a group. A quote in a pattern is written `\\x27`.
"""

from __future__ import annotations


BACKSLASH = "\\"


class Spark:
    name = "spark"
    newline = "'\\n'"
    bigint, double, string = "bigint", "double", "string"

    def pattern(self, p: str) -> str:
        assert "'" not in p
        return f"r'{p}'"

    def like(self, s: str, p: str) -> str:
        return f"regexp_like({s}, {self.pattern(p)})"

    def sub(self, s: str, p: str, r: str = "") -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, r'{r.replace(BACKSLASH, '$')}')"

    def count(self, s: str, p: str) -> str:
        return f"cast(regexp_count({s}, {self.pattern(p)}) as bigint)"

    def all(self, s: str, p: str) -> str:
        return f"regexp_extract_all({s}, {self.pattern(p)}, 0)"

    def ext(self, s: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.pattern(p)}, {group})"

    def split(self, s: str, p: str) -> str:
        return f"split({s}, {self.pattern(p)}, -1)"

    def lines(self, s: str) -> str:
        return f"split({s}, '\\n', -1)"

    def length(self, s: str) -> str:
        return f"cast(length({s}) as bigint)"

    def filter(self, xs: str, x: str, body: str) -> str:
        return f"filter({xs}, {x} -> {body})"

    def map(self, xs: str, x: str, body: str) -> str:
        return f"transform({xs}, {x} -> {body})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {sep})"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def forall(self, xs: str, x: str, body: str) -> str:
        return f"forall({xs}, {x} -> {body})"

    def exists(self, xs: str, x: str, body: str) -> str:
        return f"exists({xs}, {x} -> {body})"

    def at(self, xs: str, i: str) -> str:
        return f"element_at({xs}, cast({i} as int))"

    def distinct_sorted(self, xs: str) -> str:
        return f"array_sort(array_distinct({xs}))"

    def distinct(self, xs: str) -> str:
        """The different values of xs, in the order of their first places."""
        return f"array_distinct({xs})"

    def slice(self, xs: str, start: int, n: int) -> str:
        return f"slice({xs}, {start}, {n})"

    def concat(self, *xs: str) -> str:
        """Arrays one after another."""
        return f"concat({', '.join(xs)})"

    def position_of(self, xs: str, x: str) -> str:
        """The first place of x in xs, from 1."""
        return f"cast(array_position({xs}, {x}) as bigint)"

    def least_of(self, xs: str) -> str:
        return f"array_min({xs})"

    def control(self, n: int) -> str:
        """The character of a code point."""
        return f"char({n})"

    def to_json(self, fields: dict[str, str]) -> str:
        return f"to_json(struct({', '.join(f'{v} as {k}' for k, v in fields.items())}))"

    def parse_items(self, text: str) -> str:
        """The items (id, zh) of a JSON answer; null if it does not parse."""
        return f"from_json({text}, 'items array<struct<id: bigint, zh: string>>').items"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def number(self, s: str) -> str:
        return f"try_cast({s} as double)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def starts(self, s: str, p: str) -> str:
        return f"startswith({s}, {p})"

    def base64(self, s: str) -> str:
        return f"replace(base64(cast({s} as binary)), '\\r\\n', '')"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def explode(self, source: str, xs: str, value: str, place: str, columns: str) -> str:
        """columns of source and each element of xs with its place from 0."""
        return f"select {columns}, {value}, cast({place} as bigint) as {place} from {source} lateral view posexplode({xs}) x as {place}, {value}"

    def ordered(self, x: str, by: str) -> str:
        """An aggregate: the values of x in the order of by."""
        return f"transform(array_sort(collect_list(struct({by} as k_, {x} as v_))), e_ -> e_.v_)"

    def count_if(self, c: str) -> str:
        return f"count_if({c})"

    def position(self, text: str, p: str) -> str:
        return f"cast(instr({text}, {p}) as bigint)"

    def range(self, a: str, b: str) -> str:
        """The integers from a to b, none if b is less."""
        return f"(case when {b} >= {a} then sequence(cast({a} as bigint), cast({b} as bigint)) else array() end)"

    def json(self, text: str, key: str) -> str:
        return f"get_json_object({text}, '$.{key}')"

    def valid_json(self, text: str) -> str:
        return f"(try_parse_json({text}) is not null)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)"

    def fixed(self, x: str, digits: int) -> str:
        return f"format_string('%.{digits}f', {x})"

    def arg_max(self, x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))"


class Duck(Spark):
    name = "duck"
    newline = "chr(10)"
    string = "varchar"

    def pattern(self, p: str) -> str:
        assert "'" not in p
        return f"'{p}'"

    def like(self, s: str, p: str) -> str:
        return f"regexp_matches({s}, {self.pattern(p)})"

    def sub(self, s: str, p: str, r: str = "") -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, '{r}', 'g')"

    def count(self, s: str, p: str) -> str:
        return f"cast(len(regexp_extract_all({s}, {self.pattern(p)})) as bigint)"

    def all(self, s: str, p: str) -> str:
        return f"regexp_extract_all({s}, {self.pattern(p)})"

    def split(self, s: str, p: str) -> str:
        return f"regexp_split_to_array({s}, {self.pattern(p)})"

    def lines(self, s: str) -> str:
        return f"string_split({s}, chr(10))"

    def filter(self, xs: str, x: str, body: str) -> str:
        return f"list_filter({xs}, lambda {x}: {body})"

    def map(self, xs: str, x: str, body: str) -> str:
        return f"list_transform({xs}, lambda {x}: {body})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {sep})"

    def size(self, xs: str) -> str:
        return f"cast(len({xs}) as bigint)"

    def forall(self, xs: str, x: str, body: str) -> str:
        return f"(len(list_filter({xs}, lambda {x}: not ({body}))) = 0)"

    def exists(self, xs: str, x: str, body: str) -> str:
        return f"(len(list_filter({xs}, lambda {x}: {body})) > 0)"

    def at(self, xs: str, i: str) -> str:
        return f"({xs})[cast({i} as bigint)]"

    def distinct_sorted(self, xs: str) -> str:
        return f"list_sort(list_distinct({xs}))"

    def distinct(self, xs: str) -> str:
        return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"

    def slice(self, xs: str, start: int, n: int) -> str:
        return f"({xs})[{start}:{start + n - 1}]"

    def concat(self, *xs: str) -> str:
        return f"({' || '.join(xs)})"

    def position_of(self, xs: str, x: str) -> str:
        return f"cast(list_position({xs}, {x}) as bigint)"

    def least_of(self, xs: str) -> str:
        return f"list_min({xs})"

    def control(self, n: int) -> str:
        return f"chr({n})"

    def to_json(self, fields: dict[str, str]) -> str:
        return f"cast(to_json(struct_pack({', '.join(f'{k} := {v}' for k, v in fields.items())})) as varchar)"

    def parse_items(self, text: str) -> str:
        return f"""from_json(case when json_valid({text}) then {text} end, '{{"items": [{{"id": "BIGINT", "zh": "VARCHAR"}}]}}').items"""

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def sha256(self, s: str) -> str:
        return f"sha256({s})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def starts(self, s: str, p: str) -> str:
        return f"starts_with({s}, {p})"

    def base64(self, s: str) -> str:
        return f"base64(encode({s}))"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def explode(self, source: str, xs: str, value: str, place: str, columns: str) -> str:
        return f"select {columns}, unnest(xs_) as {value}, cast(generate_subscripts(xs_, 1) - 1 as bigint) as {place} from (select *, {xs} as xs_ from {source})"

    def ordered(self, x: str, by: str) -> str:
        return f"list({x} order by {by})"

    def count_if(self, c: str) -> str:
        return f"cast(count_if({c}) as bigint)"

    def position(self, text: str, p: str) -> str:
        return f"cast(instr({text}, {p}) as bigint)"

    def range(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def json(self, text: str, key: str) -> str:
        return f"json_extract_string(case when json_valid({text}) then {text} end, '$.{key}')"

    def valid_json(self, text: str) -> str:
        return f"json_valid({text})"

    def number(self, s: str) -> str:
        return f"try_cast({s} as double)"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: cast(({a})[i] as double) * cast(({b})[i] as double)))"

    def fixed(self, x: str, digits: int) -> str:
        return f"printf('%.{digits}f', {x})"

    def arg_max(self, x: str, *by: str) -> str:
        return f"arg_max({x}, row({', '.join(by)}))"


SPARK, DUCK = Spark(), Duck()
