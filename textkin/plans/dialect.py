"""One relational plan, spelt for two engines: Spark SQL runs it, DuckDB SQL checks it.

A plan is a function of a dialect that returns SQL. Where the engines name a thing differently, the dialect has a method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Fixed value: a token is a run of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class SparkDialect:
    def pattern(self, p: str) -> str:
        return "r'" + p.replace("'", r"\x27") + "'"

    def words(self, x: str) -> str:
        return f"regexp_extract_all(lower(coalesce({x}, '')), {self.pattern(TOKEN)}, 0)"

    def extract_all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')"

    def matches(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})"

    def ref(self, n: int) -> str:
        return f"${n}"

    def explode(self, x: str) -> str:
        return f"explode({x})"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def sort(self, x: str) -> str:
        return f"array_sort({x})"

    def join(self, x: str, by: str = " ") -> str:
        return f"array_join({x}, '{by}')"

    def collect(self, x: str) -> str:
        return f"collect_list({x})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def where(self, x: str, cond: str) -> str:
        """Elements x of an array for which cond holds."""
        return f"filter({x}, x -> {cond})"

    def each(self, x: str, value: str) -> str:
        return f"transform({x}, x -> {value})"

    def slice(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def at(self, x: str, i: str) -> str:
        return f"get({x}, ({i}) - 1)"

    def range(self, a: str, b: str) -> str:
        """a to b, both included; empty if b < a."""
        return f"CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE CAST(array() AS ARRAY<BIGINT>) END"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def epoch(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))"

    def json_int(self, x: str, key: str) -> str:
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"

    def contains(self, a: str, b: str) -> str:
        return f"contains({a}, {b})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def values(self, rows: str, columns: str) -> str:
        return f"(SELECT * FROM VALUES {rows} AS v({columns}))"

    def repeat(self, x: str, n: str) -> str:
        return f"repeat({x}, CAST({n} AS INT))"

    def ordered_join(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, {by}) WITHIN GROUP (ORDER BY {order})"

    def count_if(self, cond: str) -> str:
        return f"count_if({cond})"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def has(self, x: str, v: str) -> str:
        return f"array_contains({x}, {v})"


class DuckDialect(SparkDialect):
    def pattern(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def words(self, x: str) -> str:
        return f"regexp_extract_all(lower(coalesce({x}, '')), {self.pattern(TOKEN)})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}', 'g')"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def ref(self, n: int) -> str:
        return f"\\{n}"

    def explode(self, x: str) -> str:
        return f"unnest({x})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def sort(self, x: str) -> str:
        return f"list_sort({x})"

    def join(self, x: str, by: str = " ") -> str:
        return f"array_to_string({x}, '{by}')"

    def collect(self, x: str) -> str:
        return f"list({x})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def concat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def where(self, x: str, cond: str) -> str:
        return f"list_filter({x}, lambda x: {cond})"

    def each(self, x: str, value: str) -> str:
        return f"list_transform({x}, lambda x: {value})"

    def slice(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def at(self, x: str, i: str) -> str:
        return f"({x})[{i}]"

    def range(self, a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    def epoch(self, x: str) -> str:
        return f"epoch_us({x})"

    def json_int(self, x: str, key: str) -> str:
        return f"CAST(json_extract_string({x}, '$.{key}') AS BIGINT)"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def values(self, rows: str, columns: str) -> str:
        return f"(SELECT * FROM (VALUES {rows}) AS v({columns}))"

    def repeat(self, x: str, n: str) -> str:
        return f"repeat({x}, {n})"

    def ordered_join(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, {by} ORDER BY {order})"

    def median(self, x: str) -> str:
        return f"quantile_cont({x}, 0.5)"

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def has(self, x: str, v: str) -> str:
        return f"list_contains({x}, {v})"


SPARK, DUCK = SparkDialect(), DuckDialect()


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of sf_dir."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def plan(name: str) -> Callable:
    """Registers a function of a dialect under a name: Spark runs its one spelling, the oracle is the other."""

    def add(f: Callable[[SparkDialect], str]):
        query(name, f(DUCK))(lambda spark, sf_dir: run(spark, sf_dir, f(SPARK)))
        return f

    return add
