"""Scalar expressions as text for two engines: Spark SQL, which runs them, and DuckDB, which checks them.

Rule tables and patterns are stated once, as data; each engine has its own spelling of regular expressions,
lambdas and list functions.
"""

from __future__ import annotations


class Dialect:
    name = ""

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def words(self, listed: str | tuple[str, ...]) -> str:
        items = listed.split() if isinstance(listed, str) else listed
        return "(" + ", ".join(self.lit(w) for w in dict.fromkeys(items)) + ")"

    def full(self, x: str, pattern: str) -> str:
        return self.like(x, f"^(?:{pattern})$")

    def case(self, rules: list[tuple[str, str]], default: str) -> str:
        return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for value, cond in rules) + f" ELSE {default} END"


class SparkDialect(Dialect):
    name = "spark"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def each(self, xs: str, var: str, body: str) -> str:
        return f"transform({xs}, {var} -> {body})"

    def where(self, xs: str, var: str, cond: str) -> str:
        return f"filter({xs}, {var} -> {cond})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def upto(self, n: str) -> str:
        """1, 2, ... n; empty if n < 1."""
        return f"(CASE WHEN {n} >= 1 THEN sequence(1, {n}) ELSE cast(array() AS array<int>) END)"

    def at(self, xs: str, i: str) -> str:
        return f"{xs}[({i}) - 1]"

    def double(self, x: str) -> str:
        return f"cast({x} AS double)"

    def unique(self, xs: str) -> str:
        return f"array_distinct({xs})"


class DuckDialect(Dialect):
    name = "duckdb"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def each(self, xs: str, var: str, body: str) -> str:
        return f"list_transform({xs}, lambda {var}: {body})"

    def where(self, xs: str, var: str, cond: str) -> str:
        return f"list_filter({xs}, lambda {var}: {cond})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def upto(self, n: str) -> str:
        return f"range(1, ({n}) + 1)"

    def at(self, xs: str, i: str) -> str:
        return f"{xs}[{i}]"

    def double(self, x: str) -> str:
        return f"({x})::DOUBLE"

    def unique(self, xs: str) -> str:
        return f"list_distinct({xs})"


def listed(expressions: dict[str, str]) -> str:
    """A select list of named expressions."""
    return ", ".join(f"{v} AS {k}" for k, v in expressions.items())


SPARK, DUCK = SparkDialect(), DuckDialect()
