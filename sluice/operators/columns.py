"""Column lowering: a graph of pure Column bodies as one lazy plan, a row an execution.

Each node adds flat columns: <id>__o outcome (executed, failed, cancelled, blocked),
<id>__ck, <id>__cn, <id>__cp cause kind, node and path or route, <id>__e error code,
<id>__a attempts, <id>__w what a blocked node awaits, and its values: <id>__v, or
<id>__v_<port> for each port. NULL in a value is absence. Nodes go in canonical order
with one projection each, so the plan grows with the graph and Catalyst prunes what no
export reads.

A fan-out is a transform over its array, without a shuffle: the gather is an array of
{status, value, code, idx}, and <id>__i is the lowest index that failed. A graph as body
is lowered within the transform, where each node's columns are bound to a variable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MAX_WIDTH
from ..plans.graph import Graph, Node, Source, required_inputs, segments
from ..plans.predicates import Typed, element, holds, resolve

EXECUTED, FAILED, CANCELLED, BLOCKED = "executed", "failed", "cancelled", "blocked"
_AWAITS = "array<struct<kind: string, key: string>>"


@dataclass
class Emission:
    """What a body gives: ports (or one value), and where it fails: an error code or NULL."""

    ports: dict[str, Typed]
    error: Column | None = None
    attempts: Column | None = None


#: Of inputs and params; the params hold `$maxAttempts` as well, for bodies that may be tried again (see retried).
Body = Callable[[dict[str, Typed], dict], Emission]


def value(t: Typed, error: Column | None = None, attempts: Column | None = None) -> Emission:
    return Emission({"value": t}, error, attempts)


def retried(attempt: Callable[[int], tuple[Typed, Column, Column]], most: int) -> Emission:
    """Up to `most` attempts, unrolled: attempt(k) gives value, error code or NULL, and whether the failure may be tried again."""
    tries = [attempt(k) for k in range(1, most + 1)]
    ends = [t[1].isNull() | ~t[2] for t in tries[:-1]]
    pick = lambda columns: reduce(lambda rest, k: F.when(ends[k], columns[k]).otherwise(rest), reversed(range(most - 1)), columns[-1])
    return Emission({"value": replace(tries[-1][0], column=pick([t[0].column for t in tries]))}, pick([t[1] for t in tries]), pick([F.lit(k) for k in range(1, most + 1)]))


@dataclass
class Binding:
    """A live flag, the value, the cause when it is dead, and what it awaits when it is neither."""

    live: Column
    typed: Typed
    cause: tuple[Column, Column, Column]  # kind, node, path or route
    code: Column | None = None
    waits: Column | None = None  # a flag
    key: tuple[str, str] = ("", "")  # kind and key of what it awaits
    awaits: Column | None = None  # of several: an array of them

    @property
    def dead(self) -> Column:
        return ~self.live if self.waits is None else ~self.live & ~self.waits

    def awaited(self) -> Column:
        if self.awaits is not None:
            return self.awaits
        one = F.array(F.struct(F.lit(self.key[0]).alias("kind"), F.lit(self.key[1]).alias("key")))
        return _nothing() if self.waits is None else F.when(self.waits, one).otherwise(_nothing())


@dataclass
class Lowered:
    df: DataFrame | None
    graph: Graph
    values: dict[str, dict[str, Typed]] = field(default_factory=dict)
    space: str = ""  # of an inlined child: the keys of the nodes around it, each with a slash
    look: Callable[[str], Column] = F.col
    facts: dict[str, Typed] = field(default_factory=dict)  # `$in` facts by their keys

    def name(self, node: str, what: str) -> str:
        return f"{self.space.replace('/', '__')}{node}__{what}"

    def at(self, node: str, what: str) -> Column:
        return self.look(self.name(node, what))

    def exported(self, *keep: str) -> DataFrame:
        return self.df.select(*keep, *[_binding(self, s).typed.column.alias(name) for name, s in self.graph.exports.items()])

    def report(self, *keep: str) -> DataFrame:
        """A row per execution and node: the columns of keep, ord, key, outcome, attempts, error_code, cause_kind, cause_node, awaiting."""
        rows = []
        for k, id_ in enumerate(self.graph.topological()):
            outcome, attempts = self.at(id_, "o"), self.at(id_, "a")
            settled = F.when((outcome == FAILED) | (outcome == EXECUTED) & (attempts > 1), attempts)
            rows.append(F.struct(F.lit(k).alias("ord"), F.lit(id_).alias("key"), outcome.alias("outcome"), settled.alias("attempts"), F.when(outcome == FAILED, self.at(id_, "e")).alias("error_code"), self.at(id_, "ck").alias("cause_kind"), self.at(id_, "cn").alias("cause_node"), F.when(outcome == BLOCKED, F.transform(self.at(id_, "w"), lambda w: w["key"])).alias("awaiting")))
        return self.df.select(*keep, F.explode(F.array(*rows)).alias("row")).select(*keep, "row.*")


def _none() -> tuple[Column, Column, Column]:
    return tuple(F.lit(None).cast("string") for _ in range(3))


def _nothing() -> Column:
    return F.array().cast(_AWAITS)


def _binding(low: Lowered, s: Source) -> Binding:
    """A producer's value at a path: live, waiting, or dead with its cause; port_absent where the path misses."""
    if s.input is not None:
        key = f"{low.space}$in/{s.input}"
        t = low.values["$input"].get(s.input) or low.facts.get(key)
        t = t or Typed(F.lit(None), "absent")
        return Binding(t.column.isNotNull(), t, _none(), F.lit(None).cast("string"), t.column.isNull(), ("input", key))
    ports, path, n = low.values[s.node], list(s.path), low.graph.nodes[s.node]
    if path and path[0] in ports and not (n.contract and n.contract.bare and n.species == "routine"):
        t, rest = ports[path[0]], path[1:]
    elif "value" in ports:
        t, rest = ports["value"], path
    else:  # all ports, as one record
        t, rest = Typed(F.struct(*[t.column.alias(p) for p, t in ports.items()]), "record", {p: replace(t, column=None) for p, t in ports.items()}), path
    t = resolve(t, rest) or Typed(F.lit(None), "absent")
    outcome = low.at(s.node, "o")
    ran = outcome == EXECUTED
    # A null that a decision commits for its default rule is there, though it is null.
    there = F.lit(True) if n.species == "decision" or not path and n.species != "routine" else t.column.isNotNull()
    cause = (
        F.when(outcome == FAILED, "failed").when(outcome == CANCELLED, low.at(s.node, "ck")).otherwise("port_absent"),
        F.when(outcome == CANCELLED, low.at(s.node, "cn")).otherwise(low.space + s.node),
        F.when(outcome == CANCELLED, low.at(s.node, "cp")).when(ran, F.lit(".".join(map(str, path)))),
    )
    code = F.when(outcome == FAILED, low.at(s.node, "e")).when(outcome == CANCELLED, "cancelled").otherwise("port_absent")
    return Binding(ran & there, replace(t, column=F.when(ran, t.column)), cause, code, outcome == BLOCKED, ("node", low.space + s.node))


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def _all(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def _awaiting(parts: list[Binding]) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[p.awaited() for p in parts]))) if parts else _nothing()


def _first_dead(parts: list[Binding]) -> tuple[Column, Column, Column]:
    """The cause of the first dead part, kept whole."""
    nothing = F.struct(*[c.alias(k) for c, k in zip(_none(), "knp", strict=True)])
    first = reduce(lambda rest, b: F.when(b.dead, F.struct(*[c.cast("string").alias(k) for c, k in zip(b.cause, "knp", strict=True)])).otherwise(rest), reversed(parts), nothing)
    return (first["k"], first["n"], first["p"])


def _group(low: Lowered, sources: list[Source], mode: str) -> Binding:
    got = [_binding(low, s) for s in sources]
    if mode == "any":
        waits = _any([b.waits for b in got])
        tagged = F.array(*[F.struct(F.when(b.live, "ok").otherwise("error").alias("status"), b.typed.column.alias("value"), F.when(~b.live, b.code).alias("code"), F.when(~b.live, F.lit(low.space + (s.node or ""))).alias("by")) for b, s in zip(got, sources, strict=True)])
        fields = {"status": Typed(None, "string"), "value": replace(got[0].typed, column=None), "code": Typed(None, "string"), "by": Typed(None, "string")}
        return Binding(_any([b.live for b in got]) & ~waits, Typed(tagged, "list", Typed(None, "record", fields)), got[0].cause, None, waits, awaits=_awaiting(got))
    if len(got) == 1:
        return got[0]
    live = _all([b.live for b in got])
    joined = Typed(F.when(live, F.array(*[b.typed.column for b in got])), "list", replace(got[0].typed, column=None))
    return Binding(live, joined, _first_dead(got), None, ~live & ~_any([b.dead for b in got]), awaits=_awaiting(got))


def _order(low: Lowered, node: str, label: str | None) -> Binding:
    outcome = low.at(node, "o")
    chosen = low.values[node]["selected"].column == label if label is not None else F.lit(True)
    cause = (
        F.when(outcome == FAILED, "failed").when(outcome == CANCELLED, low.at(node, "ck")).otherwise("routed"),
        F.when(outcome == CANCELLED, low.at(node, "cn")).otherwise(low.space + node),
        F.when(outcome == CANCELLED, low.at(node, "cp")).otherwise(F.lit(label)),
    )
    return Binding((outcome == EXECUTED) & F.coalesce(chosen, F.lit(False)), Typed(F.lit(None), "absent"), cause, None, outcome == BLOCKED, ("node", low.space + node))


def decision(n: Node, env: dict[str, Typed]) -> tuple[Column, Column]:
    """The selected label, and the index of the rule that matched (NULL for the default)."""
    label, index = F.lit(n.spec["default"]), F.lit(None).cast("int")
    for k, (rule, tree) in reversed(list(enumerate(zip(n.spec["rules"], n.trees, strict=True)))):
        hit = holds(tree, lambda path: resolve(env.get(path[0]), path[1:]))
        label, index = F.when(hit, F.lit(rule["route"])).otherwise(label), F.when(hit, F.lit(k)).otherwise(index)
    return label, index


# --- fan-out


def _child(low: Lowered, n: Node, env: dict[str, Typed], bodies: dict[str, Body], item: Typed, index: Column) -> Column:
    """The envelope of one child: status, value, code, idx; status blocked where a graph body awaits something."""
    bound = {k: v for k, v in env.items() if k != n.spec["over"]}
    missed, bind = F.lit(False), n.spec.get("bind")
    for target in sorted(bind or {}):
        path = segments(bind[target]) if isinstance(bind[target], str) else tuple(bind[target])
        found = resolve(item, path) or Typed(F.lit(None).cast("string"), "absent")
        bound[target], missed = found, missed | found.column.isNull()
    if bind is None:
        bound[required_inputs(n)[0]] = item

    def envelope(result: Column, code: Column, waits: Column) -> Column:
        code = F.when(missed, "kernel/bind").otherwise(code)
        status = F.when(code.isNotNull(), "error").when(waits, BLOCKED).otherwise("ok")
        return F.struct(status.alias("status"), F.when(code.isNull() & ~waits, result).alias("value"), code.alias("code"), index.cast("int").alias("idx"))

    if n.child is None:
        emitted = bodies[n.ref](bound, n.spec.get("params") or {})
        ports = emitted.ports
        result = ports["value"].column if n.contract.bare else F.struct(*[t.column.alias(p) for p, t in ports.items()])
        return envelope(result, F.lit(None).cast("string") if emitted.error is None else emitted.error, F.lit(False))

    # A graph: each node's columns are bound to the variable of a transform over a single struct.
    bindings: dict[str, Column] = {}
    inner = Lowered(None, n.child, {"$input": bound}, f"{low.space}{n.id}/*/", bindings.__getitem__)
    nodes = _nodes(inner, bodies)

    def rest() -> Column:
        columns = next(nodes, None)
        if columns is None:
            out = {name: _binding(inner, s) for name, s in n.child.exports.items()}
            dead, waits = _any([b.dead for b in out.values()]), _any([b.waits for b in out.values()])
            return envelope(F.struct(*[b.typed.column.alias(name) for name, b in out.items()]), F.when(dead, "cancelled"), waits)

        def bound_to(variable: Column) -> Column:
            bindings.update({name: variable[name] for name in columns})
            return rest()

        return F.element_at(F.transform(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])), bound_to), 1)

    return rest()


def _fan_out(low: Lowered, n: Node, env: dict[str, Typed], bodies: dict[str, Body]) -> tuple[Typed, Column, Column, Column]:
    """Gather, error code or NULL, the lowest index that failed, and the children that await something."""
    over = env[n.spec["over"]]
    if over.kind != "list":
        nothing = F.lit(None).cast("string")
        return Typed(nothing, "absent"), F.lit("kernel/fanout"), F.lit(None).cast("int"), _nothing()
    gather = F.transform(over.column, lambda x, i: _child(low, n, env, bodies, element(over, x), i))
    held = F.element_at(F.transform(F.array(gather), lambda g: F.struct(g.alias("g"), F.array_min(F.transform(F.filter(g, lambda e: e["status"] == "error"), lambda e: e["idx"])).alias("first"), F.transform(F.filter(g, lambda e: e["status"] == BLOCKED), lambda e: F.struct(F.lit("node").alias("kind"), F.concat(F.lit(f"{low.space}{n.id}/"), e["idx"].cast("string")).alias("key"))).alias("waits"))), 1)
    error = F.when(F.size(over.column) > MAX_WIDTH, "kernel/bounds")
    if n.spec.get("absorb") is not True:
        error = error.when(held["first"].isNotNull(), "kernel/fanout_child")
    fields = {"status": Typed(None, "string"), "value": Typed(None, "other"), "code": Typed(None, "string"), "idx": Typed(None, "number")}
    waits = F.when(F.size(over.column) <= MAX_WIDTH, held["waits"]).otherwise(_nothing())
    return Typed(held["g"], "list", Typed(None, "record", fields)), error, held["first"], waits


# --- graphs


def _nodes(low: Lowered, bodies: dict[str, Body]) -> Iterator[dict[str, Column]]:
    """The columns of one node after another, those of an invoked graph before those of its node.

    Whoever takes them makes them known to low.look before the next are asked for.
    """
    for id_ in low.graph.topological():
        n = low.graph.nodes[id_]
        groups = {name: _group(low, n.inputs[name], n.modes[name]) for name in sorted(n.inputs, key=str.encode)}
        parts = [*groups.values(), *[_order(low, node, label) for node, label in n.orders]]
        env = {name: b.typed for name, b in groups.items()}
        error, attempts, ports, absorb = F.lit(None).cast("string"), F.lit(0), {}, n.spec.get("absorb") is True
        more, children = {}, None  # the children of a fan-out that await something
        if n.species == "decision":
            label, index = decision(n, env)
            ports = {"selected": Typed(label, "string"), "matched_rule": Typed(index, "number")}
        elif n.species == "invoke":
            child = Lowered(None, n.child, {"$input": env}, f"{low.space}{id_}/", low.look, low.facts)
            yield from _nodes(child, bodies)
            out = {name: _binding(child, s) for name, s in n.child.exports.items()}
            ports = {name: b.typed for name, b in out.items()}
            parts = [*parts, *out.values()]
        elif n.species == "map":
            gather, error, first, children = _fan_out(low, n, env, bodies)
            ports, absorb = {"value": gather}, False
            attempts = F.when(error.isNotNull(), 1).otherwise(0)
            more = {"i": first}
        else:
            most = (n.spec.get("retry") or {}).get("maxAttempts", 1)
            emitted = bodies[n.ref](env, (n.spec.get("params") or {}) | {"$maxAttempts": most})
            ports = emitted.ports
            attempts = emitted.attempts if emitted.attempts is not None else F.lit(1)
            error = emitted.error if emitted.error is not None else error
        live, dead = _all([b.live for b in parts]), _any([b.dead for b in parts])
        runs = live if children is None else live & (F.size(children) == 0)
        failed = runs & error.isNotNull()
        cause = _first_dead(parts)
        awaiting = F.when(~live & ~dead, _awaiting(parts))
        awaiting = awaiting if children is None else awaiting.when(live, children)
        columns = {
            "o": F.when(dead, CANCELLED).when(~runs, BLOCKED).when(failed & ~F.lit(absorb), FAILED).otherwise(EXECUTED),
            **{what: F.when(dead, c) for what, c in zip(("ck", "cn", "cp"), cause, strict=True)},
            "e": F.when(failed, error),
            "a": F.when(runs, attempts).otherwise(0).cast("long"),
            "w": awaiting,
            **more,
        }
        columns = {low.name(id_, what): c for what, c in columns.items()}
        where = {port: low.name(id_, "v" if port == "value" else f"v_{port}") for port in ports}
        columns |= {where[port]: F.when(runs & ~failed, t.column) for port, t in ports.items()}
        yield columns
        low.values[id_] = {port: replace(t, column=low.look(where[port])) for port, t in ports.items()}


def lower_graph(graph: Graph, df: DataFrame, inputs: dict[str, Typed], bodies: dict[str, Body], facts: dict[str, Typed] | None = None) -> Lowered:
    """The graph over df. Bodies of all routines are Column builders; children are inlined.

    An input whose column is NULL is not there yet: what reads it is blocked. facts gives
    inputs of invoked graphs that no edge feeds, by key (`node/$in/name`).
    """
    low = Lowered(df, graph, {"$input": inputs}, facts=facts or {})
    for columns in _nodes(low, bodies):
        low.df = low.df.withColumns(columns)
    return low
