"""Spellings of the few functions that Spark SQL and ANSI SQL in DuckDB name differently.

Operators are written once as SQL over named tables, with these helpers where the two differ. Spark runs the first
spelling; the second is what a check against another engine runs.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        """A string literal."""
        return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rx(self, s: str, pattern: str, to: str) -> str:
        """All matches replaced; groups as \\1."""
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace(chr(92), '$'))})"

    def like(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.lit(pattern)})"

    def extract(self, s: str, pattern: str, group: int) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def filter(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def exists(self, a: str, v: str, e: str) -> str:
        return f"exists({a}, {v} -> {e})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def split(self, s: str, sep: str) -> str:
        return f"split({s}, {self.lit(sep)})"

    def parts(self, s: str, pattern: str) -> str:
        """A string split at a pattern."""
        return f"split({s}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def listagg(self, e: str, sep: str, order: str) -> str:
        return f"listagg({e}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def seq(self, a: str, b: str) -> str:
        """a to b, none if b < a."""
        return f"(CASE WHEN {b} >= {a} THEN sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def each(self, table: str, array: str, at: str, item: str) -> str:
        """table with the items of an array and their positions from 0."""
        return f"(SELECT * FROM {table} LATERAL VIEW posexplode({array}) e_ AS {at}, {item})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def collect(self, e: str) -> str:
        """A sorted array of distinct values."""
        return f"array_sort(collect_set({e}))"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rx(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def filter(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def exists(self, a: str, v: str, e: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {e})) > 0)"

    def size(self, a: str) -> str:
        return f"len({a})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, {start}, ({start}) + ({n}) - 1)"

    def at(self, a: str, i: str) -> str:
        return f"list_extract({a}, {i})"

    def split(self, s: str, sep: str) -> str:
        return f"string_split({s}, {self.lit(sep)})" if sep != "\\n" else f"string_split({s}, chr(10))"

    def parts(self, s: str, pattern: str) -> str:
        return f"regexp_split_to_array({s}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def listagg(self, e: str, sep: str, order: str) -> str:
        return f"string_agg({e}, {self.lit(sep)} ORDER BY {order})"

    def seq(self, a: str, b: str) -> str:
        return f"range({a}, ({b}) + 1)"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def each(self, table: str, array: str, at: str, item: str) -> str:
        return f"(SELECT *, unnest(range(len({array}))) AS {at}, unnest({array}) AS {item} FROM {table})"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def collect(self, e: str) -> str:
        return f"list_sort(list_distinct(list({e})))"

    def sha(self, s: str) -> str:
        return f"sha256({s})"


SPARK, DUCK = Spark(), Duck()
