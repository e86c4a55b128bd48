"""SQL text of the same expression for Spark and for the oracle; signals are written once and rendered for either."""

from __future__ import annotations


class Spark:
    def text(self, s: str) -> str:
        return 'r"' + s + '"' if "'" in s else "r'" + s + "'"

    def pattern(self, p):
        """Without u, Java's (?i) knows the case of ASCII letters only."""
        return self.text(p.replace("(?i)", "(?iu)"))

    def count(self, pattern, x):
        return f"regexp_count({x}, {self.pattern(pattern)})"

    def matches(self, pattern, x):
        return f"rlike({x}, {self.pattern(pattern)})"

    def every(self, pattern, x, group=0):
        return f"regexp_extract_all({x}, {self.pattern(pattern)}, {group})"

    def replace(self, pattern, x, by):
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.text(by.replace('@', '$'))})"

    def filter(self, a, v, cond):
        return f"filter({a}, {v} -> {cond})"

    def map(self, a, v, e):
        return f"transform({a}, {v} -> {e})"

    def size(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def total(self, a):
        return f"aggregate({a}, CAST(0 AS DOUBLE), (acc, x) -> acc + CAST(x AS DOUBLE))"

    def distinct(self, a):
        return f"array_distinct({a})"

    def split(self, x, sep):
        return f"split({x}, {self.text(sep)})"

    def at(self, a, i):
        return f"try_element_at({a}, {i})"

    def slice(self, a, start, n):
        return f"slice({a}, {start}, {n})"

    def steps(self, a, b, step):
        return f"sequence({a}, {b}, {step})"

    def divide(self, a, b):
        return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def join(self, a, sep):
        return f"array_join({a}, '{sep}')"

    def real(self, v):
        return f"{float(v)!r}D"

    starts = "startswith"


class Oracle(Spark):
    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, p):
        return self.text(p)

    def count(self, pattern, x):
        return f"len(regexp_extract_all({x}, {self.text(pattern)}))"

    def matches(self, pattern, x):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, pattern, x, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('@', chr(92)))}, 'g')"

    def filter(self, a, v, cond):
        return f"list_filter({a}, lambda {v}: {cond})"

    def map(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def size(self, a):
        return f"len({a})"

    def total(self, a):
        return f"coalesce(list_sum(list_transform({a}, lambda q: CAST(q AS DOUBLE))), 0.0::DOUBLE)"

    def distinct(self, a):
        return f"list_distinct({a})"

    def split(self, x, sep):
        return f"string_split({x}, {self.text(sep)})"

    def at(self, a, i):
        return f"({a})[{i}]"

    def slice(self, a, start, n):
        return f"({a})[({start}):({start}) + ({n}) - 1]"

    def steps(self, a, b, step):
        return f"generate_series({a}, {b}, {step})"

    def divide(self, a, b):
        return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def real(self, v):
        return f"{float(v)!r}::DOUBLE"

    starts = "starts_with"
