"""The few spellings in which Spark SQL and DuckDB SQL differ."""

from __future__ import annotations


class SparkSql:
    name = "spark"

    def text(self, value: str) -> str:
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return "'" + escaped + "'"

    def array(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def at(self, array: str, index: str) -> str:
        return f"element_at({array}, CAST({index} AS INT))"

    def plus_seconds(self, timestamp: str, seconds: str) -> str:
        return f"timestampadd(SECOND, CAST({seconds} AS INT), {timestamp})"

    def explode_range(self, count: int) -> str:
        return f"explode(sequence(0, {count - 1}))"

    def char(self, code: int) -> str:
        return f"chr({code})"

    def json_int(self, column: str, key: str) -> str:
        return f"CAST(get_json_object({column}, '$.{key}') AS BIGINT)"

    def double(self, expr: str) -> str:
        return f"CAST({expr} AS DOUBLE)"

    def ntz(self, value: str) -> str:
        return f"TIMESTAMP_NTZ '{value}'"


class DuckSql(SparkSql):
    name = "duckdb"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def array(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def at(self, array: str, index: str) -> str:
        return f"({array})[CAST({index} AS INT)]"

    def plus_seconds(self, timestamp: str, seconds: str) -> str:
        return f"({timestamp} + to_seconds(CAST({seconds} AS BIGINT)))"

    def explode_range(self, count: int) -> str:
        return f"unnest(range({count}))"

    def json_int(self, column: str, key: str) -> str:
        return f"CAST(json_extract_string({column}, '$.{key}') AS BIGINT)"

    def ntz(self, value: str) -> str:
        return f"TIMESTAMP '{value}'"


SPARK, DUCK = SparkSql(), DuckSql()


def pick(d: SparkSql, values: list[str | None], index: str) -> str:
    """One of the texts, by the index modulo their number."""
    items = ["CAST(NULL AS VARCHAR(1))" if v is None and d.name == "duckdb" else "NULL" if v is None else d.text(v)
             for v in values]
    return d.at(d.array(*items), f"(({index}) % {len(values)}) + 1")
