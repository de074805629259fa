"""The predicate language of decision nodes: parse, check, weigh, evaluate, lower to Column.

    or := and ("||" and)*        and := not ("&&" not)*      not := "!" not | comparison
    comparison := sum [("==" | "!=" | "<" | "<=" | ">" | ">=" | "in") sum]
    sum := product (("+" | "-") product)*      product := primary ("*" primary)*
    primary := literal | "[" literals "]" | reference | builtin "(" reference ")" | "(" or ")"

Two-valued: what is absent, or no boolean, counts as false before every connective.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType, VariantType

from ..functions.values import ABSENT, SAFE, equal, lookup, unify

WEIGHT_LIMIT = 64
BUILTINS = ("present", "absent", "size")
COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")
_TOKEN = re.compile(r'[ \t]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_-]*)|(\|\||&&|==|!=|<=|>=|[<>!+*\-(),.\[\]]))')


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # lit, list, ref, call, not, neg, bin
    op: str = ""
    value: Any = None
    args: tuple[Node, ...] = field(default=())


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, bool]] = []
        at = 0
        text = text.rstrip(" \t")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character at {at}")
            kind = ("string", "number", "name", "op")[m.lastindex - 1]
            token = m[m.lastindex]
            # A minus directly after an operand subtracts; it is no sign.
            if kind == "number" and token[0] == "-" and self.tokens and (self.tokens[-1][0] != "op" or self.tokens[-1][1] in ")]"):
                kind, token = "op", "-"
                m_end = m.start(2) + 1
            else:
                m_end = m.end()
            self.tokens.append((kind, token, m.start(m.lastindex) > at))
            at = m_end
        self.at = 0

    def peek(self, *ops: str) -> str:
        kind, token, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", False)
        return token if (kind == "op" or kind == "name" and token == "in") and token in ops else ""

    def take(self, *ops: str) -> str:
        got = self.peek(*ops)
        if got:
            self.at += 1
        return got

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ParseError(f"expected {op}")

    def whole(self) -> Node:
        out = self.chain("||", lambda: self.chain("&&", self.negation))
        if self.at < len(self.tokens):
            raise ParseError("unexpected token")
        return out

    def chain(self, op: str, part: Callable[[], Node]) -> Node:
        out = part()
        while self.take(op):
            out = Node("bin", op, args=(out, part()))
        return out

    def negation(self) -> Node:
        if self.take("!"):
            return Node("not", args=(self.negation(),))
        left = self.sum()
        op = self.take(*COMPARISONS, "in")
        if not op:
            return left
        out = Node("bin", op, args=(left, self.sum()))
        if self.peek(*COMPARISONS, "in"):
            raise ParseError("comparisons do not chain")
        return out

    def sum(self) -> Node:
        out = self.product()
        while op := self.take("+", "-"):
            out = Node("bin", op, args=(out, self.product()))
        return out

    def product(self) -> Node:
        out = self.primary()
        while self.take("*"):
            out = Node("bin", "*", args=(out, self.primary()))
        return out

    def literal(self) -> Node | None:
        kind, token, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", False)
        if kind == "string":
            try:
                value = json.loads(token)
            except ValueError:
                raise ParseError("bad string") from None
        elif kind == "number":
            value = unify(float(token)) if set(token) & set(".eE") or abs(int(token)) > SAFE else int(token)
            if value is None:
                raise ParseError("number out of range")
        elif kind == "name" and token in ("true", "false", "null"):
            value = {"true": True, "false": False, "null": None}[token]
        else:
            return None
        self.at += 1
        return Node("lit", value=value)

    def primary(self) -> Node:
        if self.take("("):
            out = self.chain("||", lambda: self.chain("&&", self.negation))
            self.need(")")
            return out
        if self.take("-"):
            return Node("neg", args=(self.primary(),))
        if self.take("["):
            items = []
            while not self.take("]"):
                if items:
                    self.need(",")
                item = self.literal()
                if item is None:
                    raise ParseError("expected a literal")
                items.append(item.value)
            return Node("list", value=items)
        found = self.literal()
        if found is not None:
            return found
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise ParseError("expected an operand")
        name = self.tokens[self.at][1]
        if name in BUILTINS and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            self.at += 2
            arg = self.reference()
            self.need(")")
            return Node("call", name, args=(arg,))
        return self.reference()

    def reference(self) -> Node:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise ParseError("expected a reference")
        path: list = [self.tokens[self.at][1]]
        self.at += 1
        while op := self.take(".", "["):
            if self.at >= len(self.tokens):
                raise ParseError("expected a segment")
            kind, token, _ = self.tokens[self.at]
            self.at += 1
            if op == "[" and not (kind == "number" and re.fullmatch(r"\d+", token)) and kind != "string":
                raise ParseError("expected an index")
            if kind == "number":
                # "a.0.1" reads as the number 0.1: two segments
                if not re.fullmatch(r"\d+(\.\d+)?", token):
                    raise ParseError("expected a segment")
                path += [int(x) for x in token.split(".")]
            elif kind == "string":
                path.append(json.loads(token))
            elif kind == "name":
                path.append(token)
            else:
                raise ParseError("expected a segment")
            if op == "[":
                self.need("]")
        return Node("ref", value=path)


def parse(text: str) -> Node:
    return _Parser(text).whole()


def weight(n: Node) -> int:
    """Leaves 1, builtins 3, unary 2 and their operand, binary 2 and both."""
    if n.kind == "call":
        return 3
    return 1 if n.kind in ("lit", "list", "ref") else 2 + sum(map(weight, n.args))


def check(root: Node, bound: set[str]) -> list[str]:
    """Diagnostic codes, in order: a boolean skeleton, bounded arithmetic, bound references."""
    codes: list[str] = []
    constant = lambda n: n.kind == "lit" or n.kind in ("bin", "neg") and n.op in ("+", "-", "*", "") and all(map(constant, n.args))
    numeric = lambda n: n.kind != "lit" or type(n.value) in (int, float)

    def skeleton(n: Node) -> None:
        if n.kind == "not" or n.kind == "bin" and n.op in ("&&", "||"):
            for a in n.args:
                skeleton(a)
        elif n.kind == "bin" and n.op in (*COMPARISONS, "in"):
            if n.op == "in" and n.args[1].kind not in ("ref", "list"):
                codes.append("E_PRED_COMPUTES")
            for a in n.args:
                operand(a)
        elif n.kind == "call" and n.op != "size" or n.kind == "ref" or n.kind == "lit" and isinstance(n.value, bool):
            operand(n)
        else:
            codes.append("E_PRED_COMPUTES")

    def operand(n: Node) -> None:
        if n.kind == "ref" and n.value[0] not in bound:
            codes.append("E_PRED_REF")
        elif n.kind in ("bin", "neg"):
            if n.op not in ("+", "-", "*", "") or not all(map(numeric, n.args)) or n.kind == "bin" and not any(map(constant, n.args)):
                codes.append("E_PRED_COMPUTES")
            for a in n.args:
                operand(a)
        elif n.kind in ("not",):
            codes.append("E_PRED_COMPUTES")
        elif n.kind == "call":
            operand(n.args[0])

    skeleton(root)
    return codes


def compare(op: str, a: Any, b: Any) -> bool:
    """Equality is type-strict and false for what is absent; order is among numbers or among strings."""
    if a is ABSENT or b is ABSENT:
        return False
    if op in ("==", "!="):
        return equal(a, b) == (op == "==")
    if isinstance(a, str) and isinstance(b, str):
        a, b = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    elif type(a) in (int, float) and type(b) in (int, float):
        a, b = float(a), float(b)
    else:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def evaluate(n: Node, env: dict) -> Any:
    """The value of a node; ABSENT where there is none."""
    if n.kind in ("lit", "list"):
        return n.value
    if n.kind == "ref":
        return lookup(env, n.value)
    if n.kind == "call":
        got = evaluate(n.args[0], env)
        if n.op == "size":
            return len(got) if isinstance(got, list | dict) else ABSENT
        return (got is not ABSENT) == (n.op == "present")
    if n.kind == "not":
        return evaluate(n.args[0], env) is not True
    vals = [evaluate(a, env) for a in n.args]
    if n.op in ("&&", "||"):
        return (all if n.op == "&&" else any)(v is True for v in vals)
    if n.op in COMPARISONS:
        return compare(n.op, *vals)
    if n.op == "in":
        return vals[0] is not ABSENT and isinstance(vals[1], list) and any(equal(vals[0], v) for v in vals[1])
    if any(type(v) not in (int, float) for v in vals):
        return ABSENT
    a, b = (0.0, float(vals[0])) if n.kind == "neg" else map(float, vals)
    out = unify(a + b if n.op == "+" else a * b if n.op == "*" else a - b)
    return ABSENT if out is None else out


_MATCH_OPS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "in": "in"}


def match_tree(m: dict) -> Node:
    """A match specification as the same tree."""
    kind = m.get("kind")
    if kind == "compare":
        value = m.get("value")
        return Node("bin", _MATCH_OPS[m["op"]], args=(Node("ref", value=list(m["path"])), Node("list" if isinstance(value, list) else "lit", value=value)))
    if kind in ("present", "absent"):
        return Node("call", kind, args=(Node("ref", value=list(m["path"])),))
    parts = [match_tree(x) for x in m.get("of", [])]
    if not parts:
        return Node("lit", value=kind == "all")
    out = parts[0]
    for p in parts[1:]:
        out = Node("bin", "&&" if kind == "all" else "||", args=(out, p))
    return out


def rule_weight(when: dict) -> int:
    """The weight of a rule. In a match specification a comparison weighs 4, a test of presence 3, a group 2 and its members."""
    if "expr" in when:
        return weight(parse(when["expr"]))
    kind = when.get("kind")
    return 4 if kind == "compare" else 3 if kind in ("present", "absent") else 2 + sum(map(rule_weight, when.get("of", [])))


def match_problem(m: dict) -> bool:
    """Whether a comparison in the specification can never hold."""
    if m.get("kind") == "compare":
        value, op = m.get("value"), m.get("op")
        return op == "in" and not isinstance(value, list) or op in ("lt", "le", "gt", "ge") and (isinstance(value, bool) or not isinstance(value, int | float | str))
    return any(match_problem(x) for x in m.get("of", []) if isinstance(x, dict))


def tree_of(when: dict) -> Node:
    return parse(when["expr"]) if "expr" in when else match_tree(when)


# Shadowing: does one rule's conjunction imply an earlier rule's?

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def conjunction(n: Node) -> list[tuple[tuple, str, Any]] | None:
    """(path, op, literal) terms when the tree is a conjunction of reference-literal comparisons."""
    if n.kind == "bin" and n.op == "&&":
        parts = [conjunction(a) for a in n.args]
        return None if None in parts else parts[0] + parts[1]
    if n.kind == "bin" and n.op in COMPARISONS:
        for (ref, lit), op in ((n.args, n.op), (n.args[::-1], _FLIP[n.op])):
            if ref.kind == "ref" and lit.kind == "lit" and type(lit.value) in (int, float, str):
                return [(tuple(ref.value), op, lit.value)]
    return None


def _region(terms: list[tuple[str, Any]]) -> dict:
    """What the terms leave: an interval of numbers, one of strings, and whether other kinds pass."""
    out = {"other": True, float: [(-math.inf, False), (math.inf, False), set()], str: [("", True), (None, False), set()]}
    for op, v in terms:
        kind = str if isinstance(v, str) else float
        v = v if kind is str else float(v)
        if op == "!=":
            if out[kind] is not None:
                out[kind][2].add(v)
            continue
        out["other"] = False
        out[float if kind is str else str] = None
        side = out[kind]
        if side is None:
            continue
        if op in (">", ">=", "=="):
            closed = op != ">"
            if v > side[0][0] or v == side[0][0] and not closed:
                side[0] = (v, closed)
        if op in ("<", "<=", "=="):
            closed = op != "<"
            if side[1][0] is None or v < side[1][0] or v == side[1][0] and not closed:
                side[1] = (v, closed)
        low, high = side[0], side[1]
        if high[0] is not None and (low[0] > high[0] or low[0] == high[0] and (not (low[1] and high[1]) or low[0] in side[2])):
            out[kind] = None
    for kind in (float, str):
        side = out[kind]
        if side and side[1][0] is not None and side[0][0] == side[1][0] and side[0][0] in side[2]:
            out[kind] = None
    return out


def _within(a: dict, b: dict) -> bool:
    if a["other"] and not b["other"]:
        return False
    for kind in (float, str):
        x, y = a[kind], b[kind]
        if x is None:
            continue
        if y is None:
            return False
        if x[0][0] < y[0][0] or x[0][0] == y[0][0] and x[0][1] and not y[0][1]:
            return False
        if y[1][0] is not None and (x[1][0] is None or x[1][0] > y[1][0] or x[1][0] == y[1][0] and x[1][1] and not y[1][1]):
            return False
        inside = lambda v: (x[0][0] < v or x[0][0] == v and x[0][1]) and (x[1][0] is None or v < x[1][0] or v == x[1][0] and x[1][1]) and v not in x[2]  # noqa: B023, E731
        if any(inside(v) for v in y[2]):
            return False
    return True


def implies(later: list, earlier: list) -> bool:
    """Every input that satisfies `later` satisfies `earlier`."""
    by_path = lambda terms: {p: _region([(op, v) for q, op, v in terms if q == p]) for p, _, _ in terms}
    a, b = by_path(later), by_path(earlier)
    return all(p in a and _within(a[p], r) for p, r in b.items())


# Lowering to Columns. A resolver gives the column of a path and its kind.


@dataclass(frozen=True)
class Typed:
    """A column whose NULL means absent.

    kind is number, string, boolean, list, record, map, variant or other; of is the kind of
    a list's or a map's elements as a Typed without a column, or the fields of a record.
    """

    column: Column | None
    kind: str
    of: Any = None


def kind_of(t: DataType) -> Typed:
    """The kind of a Spark type, without a column."""
    if isinstance(t, BooleanType):
        return Typed(None, "boolean")
    if isinstance(t, NumericType):
        return Typed(None, "number")
    if isinstance(t, StringType):
        return Typed(None, "string")
    if isinstance(t, ArrayType):
        return Typed(None, "list", kind_of(t.elementType))
    if isinstance(t, MapType):
        return Typed(None, "map", kind_of(t.valueType))
    if isinstance(t, StructType):
        return Typed(None, "record", {f.name: kind_of(f.dataType) for f in t.fields})
    return Typed(None, "variant" if isinstance(t, VariantType) else "other")


def column_of(df: DataFrame, name: str) -> Typed:
    """A column of a DataFrame with its kind, as deep as its type goes."""
    return replace(kind_of(df.schema[name].dataType), column=df[name])


def element(t: Typed, column: Column) -> Typed:
    """An element of a list or a map. Lists of unknown elements hold numbers."""
    return replace(t.of, column=column) if isinstance(t.of, Typed) else Typed(column, "number" if t.kind == "list" else "other")


def step(t: Typed, seg: str | int) -> Typed | None:
    """A typed column one segment deeper; None where no value of its kind has that segment."""
    if t.kind == "variant":
        if isinstance(seg, str) and "'" in seg:
            raise ParseError("a key with a quote cannot be looked up in a variant")
        return Typed(F.try_variant_get(t.column, f"$[{seg}]" if isinstance(seg, int) else f"$['{seg}']", "variant"), "variant")
    if isinstance(seg, int):
        return element(t, F.get(t.column, F.lit(seg))) if t.kind == "list" else None
    if t.kind == "record" and isinstance(t.of, dict):
        return replace(t.of[seg], column=t.column[seg]) if seg in t.of else None
    if t.kind == "map":
        return element(t, F.try_element_at(t.column, F.lit(seg)))
    return Typed(t.column[seg], "other") if t.kind in ("record", "other") else None


def resolve(t: Typed | None, path: list | tuple) -> Typed | None:
    for seg in path:
        t = None if t is None else step(t, seg)
    return t


_VARIANT_KINDS = {"number": ("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)", "double"), "string": ("^STRING", "string"), "boolean": ("^BOOLEAN", "boolean")}


def as_kind(t: Typed, kind: str) -> Column:
    """The column where it holds a value of the kind, else NULL."""
    if t.kind == "variant" and kind in _VARIANT_KINDS:
        pattern, cast = _VARIANT_KINDS[kind]
        return F.when(F.schema_of_variant(t.column).rlike(pattern), F.try_variant_get(t.column, "$", cast))
    if t.kind == kind:
        return t.column.cast("double") if kind == "number" else t.column
    return F.lit(None).cast({"number": "double", "string": "string", "boolean": "boolean"}[kind])


def _size(t: Typed) -> Column:
    if t.kind in ("list", "map"):
        return F.size(t.column).cast("double")
    if t.kind == "record":
        return sum((F.when(t.column[f].isNotNull(), 1.0).otherwise(0.0) for f in t.of or {}), F.lit(0.0))
    if t.kind == "variant":
        text = F.to_json(t.column)
        return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text))).cast("double")
    return F.lit(None).cast("double")


def _there(t: Typed) -> Column:
    return F.lit(False) if t.kind == "absent" else t.column.isNotNull()


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _compared(op: str, a: Typed, b: Typed) -> Column:
    """Kinds never cross: what differs in kind is unequal when both are there, and has no order."""
    if "absent" in (a.kind, b.kind):
        return F.lit(False)
    plain = ("number", "string", "boolean")
    kinds = [k for k in plain if k in (a.kind, b.kind)] or ([k for k in plain] if "variant" in (a.kind, b.kind) else [])
    kinds = [k for k in kinds if a.kind in (k, "variant") and b.kind in (k, "variant")]
    if op in ("<", "<=", ">", ">="):
        tests = []
        for k in kinds:
            if k != "boolean":
                x, y = as_kind(a, k), as_kind(b, k)
                tests.append(_false({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]))
        return reduce(lambda p, q: p | q, tests, F.lit(False))
    if a.kind == b.kind and a.kind not in (*plain, "variant"):
        same = _false(a.column == b.column)
    else:
        same = reduce(lambda p, q: p | q, [_false(as_kind(a, k) == as_kind(b, k)) for k in kinds], F.lit(False))
        if a.kind == b.kind == "variant":  # nulls, lists and maps by their text, whose keys are sorted
            other = [~F.schema_of_variant(t.column).rlike("|".join(p for p, _ in _VARIANT_KINDS.values())) for t in (a, b)]
            same = same | _false(other[0] & other[1] & (F.to_json(a.column) == F.to_json(b.column)))
    return same if op == "==" else _there(a) & _there(b) & ~same


def _truth(t: Typed) -> Column:
    return _false(as_kind(t, "boolean")) if t.kind in ("boolean", "variant") else F.lit(False)


def holds(n: Node, resolve: Callable[[list], Typed | None]) -> Column:
    """Whether the predicate holds: never NULL, and false for what is no boolean."""
    return _truth(lower(n, resolve))


def lower(n: Node, resolve: Callable[[list], Typed | None]) -> Typed:
    """The tree as a Column. Connectives see false for NULL, so three-valued logic never shows."""
    if n.kind == "lit":
        kind = "boolean" if isinstance(n.value, bool) else "number" if isinstance(n.value, int | float) else "string" if isinstance(n.value, str) else "variant"
        return Typed(F.lit(float(n.value)) if kind == "number" else F.parse_json(F.lit("null")) if n.value is None else F.lit(n.value), kind)
    if n.kind == "list":
        return Typed(F.array(*map(F.lit, n.value)), "list")
    if n.kind == "ref":
        return resolve(n.value) or Typed(F.lit(None), "absent")
    if n.kind == "call":
        got = lower(n.args[0], resolve)
        if n.op == "size":
            return Typed(F.lit(None).cast("double") if got.kind == "absent" else _size(got), "number")
        return Typed(_there(got) if n.op == "present" else ~_there(got), "boolean")
    if n.kind == "not":
        return Typed(~_truth(lower(n.args[0], resolve)), "boolean")
    if n.kind == "bin" and n.op == "in":
        a, right = lower(n.args[0], resolve), n.args[1]
        if right.kind == "list" and a.kind in ("number", "string", "boolean"):  # as one test, which a scan can take
            kind = {"number": lambda v: type(v) in (int, float), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool)}[a.kind]
            same = [v for v in right.value if kind(v)]
            return Typed(_false(a.column.isin(*same)) if same else F.lit(False), "boolean")
        if right.kind == "list":
            return Typed(reduce(lambda p, q: p | q, [_compared("==", a, lower(Node("lit", value=v), resolve)) for v in right.value], F.lit(False)), "boolean")
        b = lower(right, resolve)
        if b.kind != "list" or a.kind == "absent":
            return Typed(F.lit(False), "boolean")
        return Typed(_false(F.exists(b.column, lambda x: _compared("==", element(b, x), a))), "boolean")
    args = [lower(a, resolve) for a in n.args]
    if n.kind == "bin" and n.op in ("&&", "||"):
        x, y = map(_truth, args)
        return Typed(x & y if n.op == "&&" else x | y, "boolean")
    if n.kind == "neg" or n.op in ("+", "-", "*"):
        x, y = (F.lit(0.0), as_kind(args[0], "number")) if n.kind == "neg" else (as_kind(a, "number") for a in args)
        out = x + y if n.op == "+" else x * y if n.op == "*" else x - y
        return Typed(F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out), "number")
    return Typed(_compared(n.op, *args), "boolean")
