"""A front end for a subset of SPARQL 1.1 queries, compiled to DataFrame plans over a table of triples.

Understood: PREFIX; SELECT of variables and (expression AS ?v), DISTINCT; COUNT, COUNT(DISTINCT), SUM, MIN, MAX, AVG, also
within expressions; basic graph patterns with a, names, IRIs and literals; OPTIONAL, UNION, nested groups; FILTER with
&& || ! comparison, arithmetic, IN, NOT EXISTS; BIND; STR, IRI, CONCAT, SUBSTR, STRLEN, LCASE, UCASE, CONTAINS, STRSTARTS, IF, RAND,
xsd:integer; GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET.  Patterns become filtered projections of the triples joined on
the variables they share; Catalyst picks order and strategy.  Solutions are bags.  An unbound variable is null: it is
compatible with every value where groups are joined, and a filter that is not true drops its solution.
What isn't understood raises SparqlError.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*(?:(?P<iri><[^>\s]*>)|(?P<var>\?\w+)|(?P<str>"(?:[^"\\]|\\.)*"(?:@\w+|\^\^[\w:]+)?)|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w-]*|:[\w-]+)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|>=|<=|[{}().;,=<>!*+/-]))""")
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG"}


class SparqlError(ValueError):
    """The text is not of the subset."""


class Parser:
    def __init__(self, text: str, triples: DataFrame, seed: int = 42):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.triples, self.seed, self.prefixes = 0, triples, seed, {}
        self.unbound: set[str] = set()  # variables that some solutions leave unbound

    # tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want is not None and self.peek().upper() != want):
            raise SparqlError(f"expected {want or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def has(self, want: str) -> bool:
        if self.word() == want:
            self.at += 1
            return True
        return False

    # query

    def query(self) -> DataFrame:
        while self.has("PREFIX"):
            name, iri = self.take()[1], self.take()[1]
            self.prefixes[name.rstrip(":")] = iri[1:-1]
        rows = self.selection()
        if self.at < len(self.tokens):
            raise SparqlError(f"unexpected {self.peek()!r}")
        return rows

    def selection(self) -> DataFrame:
        """A SELECT with what follows it, at the top or within a group."""
        self.take("SELECT")
        distinct = self.has("DISTINCT")
        items: list[tuple[str, int]] = []  # a variable and where its expression starts, or -1
        while self.word() not in ("WHERE", "{"):
            if self.has("*"):
                items.append(("*", -1))
            elif self.has("("):
                start, depth = self.at, 0
                while not (depth == 0 and self.word() == "AS"):
                    depth += {"(": 1, ")": -1}.get(self.peek(), 0)
                    self.take()
                self.take("AS")
                items.append((self.take()[1][1:], start))
                self.take(")")
            else:
                items.append((self.take()[1][1:], -1))
        self.has("WHERE")
        rows = self.group()
        keys = []
        if self.has("GROUP"):
            self.take("BY")
            while self.peek().startswith("?"):
                keys.append(self.take()[1][1:])
        end = self.at
        out, aggregates = {}, {}
        for name, start in items:
            if start >= 0:
                self.at = start
                (aggregates if self.aggregated(start, "AS") else out)[name] = self.expression(rows)
        self.at = end
        scope = rows.columns
        if self.has("HAVING"):
            aggregates["_having"] = self.primary(rows)
        order: list[tuple[str | int, bool]] = []  # a column, or where an expression over the solutions starts
        if self.has("ORDER"):
            self.take("BY")
            while self.at < len(self.tokens) and self.word() not in ("LIMIT", "OFFSET", "}"):
                down = self.has("DESC")
                if not down:
                    self.has("ASC")
                if self.aggregated(self.at, ""):
                    aggregates[name := f"_order{len(order)}"] = self.primary(rows)
                    order.append((name, down))
                elif self.peek().startswith("?"):
                    order.append((self.take()[1][1:], down))
                else:
                    order.append((self.at, down))
                    self.primary(rows)
        if keys or aggregates:
            if reused := [k for k in aggregates if k in scope]:
                raise SparqlError(f"?{reused[0]} is already in scope")
            rows = rows.groupBy(*keys).agg(*(c.alias(k) for k, c in aggregates.items())) if aggregates else rows.select(*keys).distinct()
        if "_having" in aggregates:
            rows = rows.where("_having").drop("_having")
        for name, c in out.items():
            rows = rows.withColumn(name, c)
        if order:
            end, by = self.at, []
            for c, down in order:
                if isinstance(c, int):
                    self.at = c
                    x = self.primary(rows)
                else:
                    x = F.col(c) if c in rows.columns else F.lit(None)
                by.append(x.desc_nulls_last() if down else x.asc_nulls_first())
            self.at = end
            rows = rows.orderBy(*by)
        names = [k for name, _ in items for k in ([c for c in rows.columns if c[0] != "_"] if name == "*" else [name])]
        if missing := [k for k in names if k not in rows.columns]:
            rows = rows.withColumns({k: F.lit(None).cast("string") for k in missing})
        rows = rows.select(*names)
        rows = rows.distinct() if distinct else rows
        limit = offset = None
        while self.word() in ("LIMIT", "OFFSET"):
            which, n = self.take()[1].upper(), int(self.take()[1])
            limit, offset = (n, offset) if which == "LIMIT" else (limit, n)
        rows = rows.offset(offset) if offset else rows
        return rows.limit(limit) if limit is not None else rows

    def aggregated(self, at: int, stop: str) -> bool:
        """Whether an expression, up to a word or the bracket that ends it, holds an aggregate."""
        depth, found = 0, False
        while at < len(self.tokens):
            word = self.tokens[at][1].upper()
            depth += {"(": 1, ")": -1}.get(word, 0)
            found |= word in AGGREGATES and at + 1 < len(self.tokens) and self.tokens[at + 1][1] == "("
            if (stop and word == stop and depth == 0) or (not stop and depth <= 0 and word in (")", "}", "LIMIT", "OFFSET")) or (not stop and depth == 0 and word.startswith("?")):
                return found
            at += 1
        return found

    # groups

    def group(self) -> DataFrame:
        """A braced group; its filters hold for the whole group, wherever they stand."""
        self.take("{")
        if self.word() == "SELECT":
            rows = self.selection()
            self.take("}")
            return rows
        rows: DataFrame | None = None
        filters: list[int] = []
        absent: list[DataFrame] = []
        while not self.has("}"):
            if self.has("FILTER"):
                if self.has("NOT"):
                    self.take("EXISTS")
                    absent.append(self.group())
                else:
                    filters.append(self.at)
                    self.skip()
            elif self.has("OPTIONAL"):
                part = self.group()
                new = set(part.columns) - set(rows.columns if rows is not None else [])
                rows = self.join(rows, part, "left")
                self.unbound |= new
            elif self.has("BIND"):
                self.take("(")
                if rows is None:
                    raise SparqlError("BIND before any pattern")
                c = self.expression(rows)
                self.take("AS")
                rows = rows.withColumn(self.take()[1][1:], c)
                self.take(")")
            elif self.peek() == "{":
                part = self.group()
                while self.has("UNION"):
                    other = self.group()
                    self.unbound |= set(part.columns) ^ set(other.columns)
                    part = part.unionByName(other, allowMissingColumns=True)
                rows = self.join(rows, part, "inner")
            else:
                rows = self.join(rows, self.pattern(), "inner")
            self.has(".")
        if rows is None:
            raise SparqlError("an empty group")
        end = self.at
        for start in filters:
            self.at = start
            rows = rows.where(self.primary(rows))
        self.at = end
        for part in absent:
            rows = self.join(rows, part.select(*(c for c in part.columns if c in rows.columns)).distinct() if set(part.columns) & set(rows.columns) else part.limit(1), "left_anti")
        return rows

    def skip(self) -> None:
        """Over a filter's bracketed expression."""
        if self.peek() != "(":
            self.take()
        depth = 0
        while True:
            depth += {"(": 1, ")": -1}.get(self.take()[1], 0)
            if depth == 0:
                return

    def join(self, rows: DataFrame | None, part: DataFrame, how: str) -> DataFrame:
        """Solutions that are compatible: equal in the variables that both bind.  Variables that every solution binds
        make an equi-join; one that may be unbound on a side adds a condition to it."""
        if rows is None:
            return part
        shared = [c for c in part.columns if c in rows.columns]
        open_ = [c for c in shared if c in self.unbound]
        if not shared:
            return rows.crossJoin(part) if how == "inner" else rows.join(part, F.lit(True), how)
        if not open_:
            return rows.join(part, shared, how)
        other = part.toDF(*(f"_{c}" if c in shared else c for c in part.columns))
        tests = [F.col(c) == F.col(f"_{c}") if c not in open_ else F.col(c).isNull() | F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")) for c in shared]
        out = rows.join(other, reduce(lambda a, b: a & b, tests), how)
        if how == "left_anti":
            return out
        return out.select(*(F.coalesce(c, f"_{c}").alias(c) if c in open_ else F.col(c) for c in rows.columns), *(c for c in part.columns if c not in shared))

    def term(self) -> tuple[str, str]:
        """('var', name), ('iri', short name) or ('lit', text)."""
        kind, x = self.take()
        if kind == "var":
            return "var", x[1:]
        if kind == "iri":
            iri = x[1:-1]
            for p, base in self.prefixes.items():
                if iri.startswith(base):
                    return "iri", f"{p}:{iri[len(base) :]}"
            return "iri", iri
        if kind == "name":
            return "iri", x
        if kind == "word" and x == "a":
            return "iri", "a"
        if kind == "str":
            return "lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1 : x.rindex('"')])
        if kind == "num":
            return "lit", x
        raise SparqlError(f"unexpected {x!r}")

    def pattern(self) -> DataFrame:
        terms = [self.term() for _ in range(3)]
        rows, names = self.triples, {}
        for column, (kind, value) in zip(("s", "p", "o"), terms):
            if kind != "var":
                rows = rows.where(F.col(column) == value)
                if column == "o":
                    rows = rows.where(F.col("o_kind") == kind)
            elif value in names:
                rows = rows.where(F.col(column) == F.col(names[value]))
            else:
                names[value] = column
        return rows.select(*(F.col(c).alias(v) for v, c in names.items()))

    # expressions

    def expression(self, rows: DataFrame) -> Column:
        left = self.conjunction(rows)
        while self.has("||"):
            left = left | self.conjunction(rows)
        return left

    def conjunction(self, rows: DataFrame) -> Column:
        left = self.comparison(rows)
        while self.has("&&"):
            left = left & self.comparison(rows)
        return left

    def comparison(self, rows: DataFrame) -> Column:
        left = self.sum(rows)
        for op, f in {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}.items():
            if self.has(op):
                return f(left, self.sum(rows))
        if self.has("IN"):
            self.take("(")
            values = [self.expression(rows)]
            while self.has(","):
                values.append(self.expression(rows))
            self.take(")")
            return reduce(lambda a, b: a | b, (left == v for v in values))
        return left

    def number(self, read, rows: DataFrame) -> tuple[Column, bool]:
        """What read gives, and whether it is a bare variable, whose text counts as a number."""
        bare = self.peek().startswith("?")
        at = self.at
        c = read(rows)
        return c, bare and self.at == at + 1

    def sum(self, rows: DataFrame) -> Column:
        return self.chain(rows, self.product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def product(self, rows: DataFrame) -> Column:
        return self.chain(rows, self.primary, {"*": lambda a, b: a * b, "/": lambda a, b: a / b})

    def chain(self, rows: DataFrame, read, steps: dict) -> Column:
        left, bare = self.number(read, rows)
        while self.peek() in steps:
            step = steps[self.take()[1]]
            right, bare_right = self.number(read, rows)
            left = step(left.try_cast("double") if bare else left, right.try_cast("double") if bare_right else right)
            bare = False
        return left

    def arguments(self, rows: DataFrame) -> list[Column]:
        self.take("(")
        out: list[Column] = []
        while not self.has(")"):
            out.append(self.expression(rows))
            self.has(",")
        return out

    def primary(self, rows: DataFrame) -> Column:
        if self.has("!"):
            return ~self.primary(rows)
        if self.has("-"):
            return -self.primary(rows)
        if self.has("("):
            c = self.expression(rows)
            self.take(")")
            return c
        kind, _ = self.tokens[self.at]
        name = self.word()
        if name in AGGREGATES and self.peek(1) == "(":
            self.take()
            self.take("(")
            distinct = self.has("DISTINCT")
            c = F.lit(1) if self.has("*") else self.expression(rows)
            self.take(")")
            if name == "COUNT":
                return F.count_distinct(c) if distinct else F.count(c)
            return {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[name](c)
        if self.peek(1) == "(" and kind in ("word", "name"):
            self.take()
            args = self.arguments(rows)
            simple = {"STR": lambda x: x.cast("string"), "IRI": lambda x: x.cast("string"), "CONCAT": F.concat, "STRLEN": F.length, "LCASE": F.lower, "UCASE": F.upper, "CONTAINS": F.contains, "STRSTARTS": F.startswith, "IF": lambda t, a, b: F.when(t, a).otherwise(b), "RAND": lambda: F.rand(self.seed), "BOUND": lambda x: x.isNotNull(), "SUBSTR": lambda x, a, n=None: F.substr(x, a.cast("int"), n.cast("int") if n is not None else None), "XSD:INTEGER": lambda x: x.try_cast("int")}
            if name not in simple:
                raise SparqlError(f"unknown function {name}")
            return simple[name](*args)
        if kind == "num":
            x = self.take()[1]
            return F.lit(float(x) if "." in x else int(x))
        kind, value = self.term()
        if kind == "var":
            return F.col(value) if value in rows.columns else F.lit(None).cast("string")
        return F.lit(value)


def select(text: str, triples: DataFrame, seed: int = 42) -> DataFrame:
    """The solutions of a SELECT query over triples (s, p, o, o_kind, o_dt) with prefixed names."""
    return Parser(text, triples, seed).query()
