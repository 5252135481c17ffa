"""Computed fields: formulas compiled to columns over a typed document.

Grammar: comparisons over sums over products over unary minus over calls and paths. Paths are a.b, a[0], a[-1], /from.root,
../up, and inside array elements #index, #length, #first, #last, @prev.x, @next.x. Functions: if, isnull, concat, min, max,
round. A failing computation (a division by zero, a missing operand) gives the field's default and an error; what depends
on it fails too. A cycle is an error for the whole schema.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXER = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|(\"[^\"]*\"|'[^']*')|((?:\.\./)+|/)?([A-Za-z_@#][\w]*(?:\.[A-Za-z_]\w*|\[-?\d+\])*)|(==|!=|<=|>=|[-+*/%()<>,]))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # number, text, path, call, op
    value: object
    parts: tuple[Node, ...] = ()


def parse(text: str) -> Node:
    items, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXER.match(text, at)
        if not m:
            raise FormulaError(f"bad formula at {at}: {text!r}")
        # after a value, "/" divides; the lexer takes "/name" for a path from the root only elsewhere
        if m[3] == "/" and items and (items[-1][0] in ("number", "text", "path") or items[-1][1] == ")"):
            items.append(("sign", "/"))
            at = m.start(3) + 1
            continue
        at = m.end()
        if m[1]:
            items.append(("number", float(m[1])))
        elif m[2]:
            items.append(("text", m[2][1:-1]))
        elif m[4]:
            items.append(("path", (m[3] or "") + m[4]))
        else:
            items.append(("sign", m[5]))
    pos = 0

    def peek(*signs: str) -> bool:
        return pos < len(items) and items[pos][0] == "sign" and items[pos][1] in signs

    def take() -> tuple[str, object]:
        nonlocal pos
        if pos >= len(items):
            raise FormulaError(f"formula ends early: {text!r}")
        pos += 1
        return items[pos - 1]

    def level(signs: tuple[str, ...], below) -> Node:
        left = below()
        while peek(*signs):
            sign = take()[1]
            left = Node("op", sign, (left, below()))
        return left

    def atom() -> Node:
        if peek("-"):
            take()
            return Node("op", "neg", (atom(),))
        kind, value = take()
        if kind == "sign":
            if value != "(":
                raise FormulaError(f"unexpected {value}")
            inner = compare()
            if take()[1] != ")":
                raise FormulaError("missing )")
            return inner
        if kind == "path" and peek("("):
            take()
            args = []
            while not peek(")"):
                args.append(compare())
                if peek(","):
                    take()
                elif not peek(")"):
                    raise FormulaError("missing )")
            take()
            return Node("call", value, tuple(args))
        return Node(kind, value)

    def product() -> Node:
        return level(("*", "/", "%"), atom)

    def total() -> Node:
        return level(("+", "-"), product)

    def compare() -> Node:
        return level(("==", "!=", "<", "<=", ">", ">="), total)

    out = compare()
    if pos < len(items):
        raise FormulaError(f"unexpected {items[pos][1]}")
    return out


def paths_of(node: Node) -> set[str]:
    own = {node.value} if node.kind == "path" else set()
    return own.union(*[paths_of(p) for p in node.parts])


@dataclass
class Scope:
    """Where a formula's names are looked up: the nearest object, what encloses it, the root, and array neighbours."""

    here: Column
    root: Column
    up: Column | None = None
    array: Column | None = None
    index: Column | None = None

    def find(self, path: str) -> Column:
        if path.startswith("/"):
            return self._walk(self.root, path[1:])
        if path.startswith("../"):
            return self._walk(self.up if self.up is not None else self.root, path[3:])
        if path[0] in "#@":
            return self._special(path)
        return self._walk(self.here, path)

    def _special(self, path: str) -> Column:
        if self.array is None:
            raise FormulaError(f"{path} outside an array")
        head, _, rest = path.partition(".")
        n = F.size(self.array)
        if head in ("#index", "#length", "#first", "#last"):
            return {"#index": self.index.cast("double"), "#length": n.cast("double"), "#first": self.index == 0, "#last": self.index == n - 1}[head]
        place = self.index - 1 if head == "@prev" else self.index + 1
        neighbour = F.when((place >= 0) & (place < n), F.get(self.array, place))
        return self._walk(neighbour, rest) if rest else neighbour

    @staticmethod
    def _walk(c: Column, path: str) -> Column:
        for name, place in re.findall(r"([A-Za-z_]\w*)|\[(-?\d+)\]", path):
            if name:
                c = c[name]
            else:
                i = int(place)
                c = F.get(c, F.lit(i)) if i >= 0 else F.get(c, F.size(c) + i)
        return c


def compile_node(node: Node, scope: Scope) -> Column:
    """A column that is null where the computation fails."""
    if node.kind in ("number", "text"):
        return F.lit(node.value)
    if node.kind == "path":
        return scope.find(node.value)
    args = [compile_node(p, scope) for p in node.parts]
    if node.kind == "op":
        if node.value == "neg":
            return -args[0]
        a, b = args
        return {
            "+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b), "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b),
            "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        }[node.value]()
    name = str(node.value).lower()
    made = {
        "if": lambda: F.when(args[0], args[1]).when(~args[0], args[2]), "isnull": lambda: args[0].isNull(), "concat": lambda: F.concat(*[a.cast("string") for a in args]),
        "min": lambda: F.when(_all(args), F.least(*args)), "max": lambda: F.when(_all(args), F.greatest(*args)), "round": lambda: F.round(args[0], node.parts[1].value if len(args) > 1 else 0),
    }
    if name not in made:
        raise FormulaError(f"unknown function {node.value}")
    return made[name]()


def _all(args: list[Column]) -> Column:
    out = F.lit(True)
    for a in args:
        out = out & a.isNotNull()
    return out


def evaluation_order(formulas: dict[str, str]) -> list[str]:
    """Fields so that each comes after those it reads; paths are reduced to their first names."""
    reads = {f: {re.split(r"[./\[]", p.lstrip("./"))[0] for p in paths_of(parse(e)) if p[0] not in "#@"} for f, e in formulas.items()}
    try:
        return list(TopologicalSorter({f: r & set(formulas) for f, r in reads.items()}).static_order())
    except CycleError as e:
        raise FormulaError(f"formulas depend on each other: {e.args[1]}") from e


def compute(rows: DataFrame, column: str, formulas: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Top-level computed fields of a struct column, in the order of what they need, and `formula_errors`.

    Each field is a column of its own while computing, so that a field read several times is computed once.
    """
    failed: dict[str, Column] = {}
    for f in evaluation_order(formulas):
        node = parse(formulas[f])
        value = compile_node(node, Scope(F.col(column), F.col(column)))
        needs = [F.col(f"_failed_{x}") for x in failed if x in {p.lstrip("./").split(".")[0] for p in paths_of(node)}]
        bad = value.isNull()
        for n in needs:
            bad = bad | n
        rows = rows.withColumn(f"_failed_{f}", bad)
        rows = rows.withColumn(column, F.col(column).withField(f, F.when(F.col(f"_failed_{f}"), F.lit(defaults.get(f, 0.0))).otherwise(value)))
        failed[f] = F.col(f"_failed_{f}")
    errors = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in failed.items()]))
    return rows.withColumn("formula_errors", errors).drop(*[f"_failed_{f}" for f in failed])


def compute_items(rows: DataFrame, column: str, formulas: dict[str, str], defaults: dict[str, object], root: str) -> DataFrame:
    """An array column with computed fields in each element. Neighbours are read as stored or as computed so far; each
    formula is a step of its own, so that what the next ones read isn't computed again for each use."""
    for f in evaluation_order(formulas):
        rows = rows.withColumn(column, F.transform(column, _item_formula(f, parse(formulas[f]), defaults.get(f, 0.0), F.col(column), F.col(root))))
    return rows


def _item_formula(name: str, node: Node, default: object, array: Column, root: Column):
    def one(x: Column, i: Column) -> Column:
        return x.withField(name, F.coalesce(compile_node(node, Scope(x, root, root, array, i)), F.lit(default)))

    return one
