"""The engine's own registered queries: each is a graph or an operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import facts as FT
from .operators.columns import Emission, Lowered, lower_graph, retried, value
from .operators.fanout import exploded
from .operators.migrate import classify, migrate, new_positions
from .operators.runtime import Capabilities, drive, execute_all, reports
from .plans.generator import SplitMix64, generate
from .plans.graph import Graph, classes_frame, compile_graph, diagnostics_frame
from .plans.predicates import Typed, column_of, holds, parse, resolve, tree_of
from .plans.registry import Registry, contract, stock_registry
from .sources.documents import ingested, manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _num(c: str) -> Typed:
    return Typed(F.col(c), "number")


def _str(c: str) -> Typed:
    return Typed(F.col(c), "string")


def _predicate(text: str | dict, **columns: Typed) -> Column:
    tree = parse(text) if isinstance(text, str) else tree_of(text)

    return holds(tree, lambda path: resolve(columns.get(path[0]), path[1:]))


def _graph(nodes: list[dict], exports: dict[str, str], inputs: dict[str, dict] | None = None, registry: Registry | None = None) -> Graph:
    spec = {"name": "q", "nodes": nodes, "exports": [{"name": k, "from": v} for k, v in exports.items()]}
    return compile_graph(spec | ({"inputs": inputs} if inputs else {}), registry or column_registry())


_ROUTE = [{"route": "bad", "when": {"expr": 'type == "error"'}}, {"route": "big", "when": {"expr": "value > 100"}}]


def _events_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph([{"id": "d", "species": "decision", "rules": _ROUTE, "default": "rest", "in": {"type": "$input.type", "value": "$input.value"}}], {"selected": "d.selected", "matched_rule": "d.matched_rule"}, {"type": {}, "value": {}})
    low = lower_graph(g, _read(spark, sf_dir, "events"), {"type": _str("event_type"), "value": _num("value")}, {})
    return low.exported("event_id")


_CASE = "CASE WHEN event_type = 'error' THEN 'bad' WHEN value > 100 THEN 'big' ELSE 'rest' END"


@_query("decision_route", f"SELECT {_CASE} AS selected, count(*) AS n FROM events GROUP BY 1")
def decision_route(spark, sf_dir):
    return _events_decision(spark, sf_dir).groupBy("selected").agg(F.count(F.lit(1)).alias("n"))


@_query("decision_matched_rule", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN value > 100 THEN 1 END::BIGINT AS matched_rule FROM events")
def decision_matched_rule(spark, sf_dir):
    return _events_decision(spark, sf_dir).select("event_id", F.col("matched_rule").cast("long").alias("matched_rule"))


@_query("pred_order_numeric", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 GROUP BY 1")
def pred_order_numeric(spark, sf_dir):
    hit = _predicate("q >= 30 && d < 0.05", q=_num("l_quantity"), d=_num("l_discount"))
    return _read(spark, sf_dir, "lineitem").filter(hit).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@_query("pred_order_string", "SELECT c_custkey FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'")
def pred_order_string(spark, sf_dir):
    return _read(spark, sf_dir, "customer").filter(_predicate('s > "BUILDING" && s <= "HOUSEHOLD"', s=_str("c_mktsegment"))).select("c_custkey")


@_query("pred_type_strict", "SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'x'")
def pred_type_strict(spark, sf_dir):
    """A string never equals or orders against a number; != holds across kinds."""
    hit = _predicate('!(s == 1) && !(s < 1) && s != 1 && s != "x"', s=_str("c_mktsegment"))
    return _read(spark, sf_dir, "customer").filter(hit).agg(F.count(F.lit(1)).alias("n"))


@_query("pred_in_arith", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice * 2 > 100000")
def pred_in_arith(spark, sf_dir):
    return _read(spark, sf_dir, "orders").filter(_predicate('s in ["F", "P", 3] && p * 2 > 100000', s=_str("o_orderstatus"), p=_num("o_totalprice"))).select("o_orderkey")


_PROPS = "CASE event_type WHEN 'click' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END"


def _with_k(spark, sf_dir):
    return _read(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_type") != "click", F.get_json_object("props", "$.k").cast("long")))


@_query("pred_present_absent", f"SELECT count(k) AS present, count(*) - count(k) AS absent FROM (SELECT {_PROPS} AS k FROM events)")
def pred_present_absent(spark, sf_dir):
    df = _with_k(spark, sf_dir)
    there, gone = _predicate("present(k)", k=_num("k")), _predicate("absent(k)", k=_num("k"))
    return df.agg(F.count_if(there).alias("present"), F.count_if(gone).alias("absent"))


@_query("pred_negated_miss", f"SELECT count(*) FILTER (k IS NULL OR k <> 7) AS negated, count(*) FILTER (k <> 7) AS unequal FROM (SELECT {_PROPS} AS k FROM events)")
def pred_negated_miss(spark, sf_dir):
    """!(k == 7) holds where k is missing, k != 7 does not."""
    return _with_k(spark, sf_dir).agg(F.count_if(_predicate("!(k == 7)", k=_num("k"))).alias("negated"), F.count_if(_predicate("k != 7", k=_num("k"))).alias("unequal"))


@_query("match_all_any", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT')")
def match_all_any(spark, sf_dir):
    compare = lambda path, op, v: {"kind": "compare", "path": [path], "op": op, "value": v}
    spec = {"kind": "all", "of": [compare("p", "ge", 50000), {"kind": "any", "of": [compare("s", "eq", "O"), compare("u", "eq", "1-URGENT")]}]}
    return _read(spark, sf_dir, "orders").filter(_predicate(spec, p=_num("o_totalprice"), s=_str("o_orderstatus"), u=_str("o_orderpriority"))).select("o_orderkey")


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s"))
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("s", lambda x: x["l_quantity"]).alias("q"))
    empty = F.array().cast("array<double>")
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").join(lines, "o_orderkey", "left").withColumn("q", F.coalesce("q", empty))


@_query("pred_size", "SELECT CASE WHEN n > 4 THEN 'long' WHEN n >= 1 THEN 'some' ELSE 'none' END AS size_class, count(*) AS n FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1")
def pred_size(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("q"))
    df = _read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("q", F.coalesce("q", F.array().cast("array<int>")))
    lines = Typed(F.col("q"), "list")
    label = F.when(_predicate("size(q) > 4", q=lines), "long").when(_predicate("size(q) >= 1", q=lines), "some").otherwise("none")
    return df.groupBy(label.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


# Routines with Column bodies.


def column_registry() -> Registry:
    out = stock_registry()
    one = [{"name": "in"}]
    out.routines |= {
        "q/limit@1": contract([*one, {"name": "most", "configEligible": True, "optional": True}], [{"port": "value"}], "pure"),
        "q/double@1": contract(one, [{"port": "value"}], "pure"),
        "q/sum@1": contract(one, [{"port": "value"}], "pure"),
        "q/split@1": contract(one, [{"port": "low"}, {"port": "high"}], "pure"),
        "q/count@1": contract(one, [{"port": "value"}], "pure"),
        "q/again@1": contract(one, [{"port": "value"}], "pure"),
        "q/share@1": contract([*one, {"name": "of"}], [{"port": "value"}], "pure"),
    }
    return out


def _limit(env, params):
    x = env["in"].column
    return value(env["in"], F.when(x > params["most"], F.lit("q/over")))


def _split(env, params):
    x = env["in"].column
    return Emission({"low": Typed(F.when(x < 100000, x), "number"), "high": Typed(F.when(x >= 100000, x), "number")})


BODIES = {
    "q/limit@1": _limit,
    "q/double@1": lambda env, params: value(Typed(env["in"].column * 2, "number")),
    "q/sum@1": lambda env, params: value(Typed(F.aggregate(env["in"].column, F.lit(0.0), lambda a, x: a + x), "number")),
    "q/count@1": lambda env, params: value(Typed(F.aggregate(env["in"].column, F.lit(0), lambda a, x: a + F.when(x["status"] == "ok", 1).otherwise(0)), "number")),
    "q/split@1": _split,
    "q/again@1": lambda env, params: retried(lambda k: (env["in"], F.when(env["in"].column > k, "q/again"), F.lit(True)), params["$maxAttempts"]),
    "q/share@1": lambda env, params: value(Typed(env["in"].column / env["of"].column, "number")),
    "vec/const@1": lambda env, params: value(Typed(F.lit(params["value"]), "string" if isinstance(params["value"], str) else "number")),
    "vec/echo@1": lambda env, params: value(env["in"]),
    "vec/scrub@1": lambda env, params: value(Typed(F.lit("scrubbed"), "string")),
    "vec/flaky@1": lambda env, params: retried(lambda k: (env["value"], F.lit("vec/again" if k < params["succeed_on"] else None).cast("string"), F.lit(True)), params["$maxAttempts"]),
    "vec/failif@1": lambda env, params: value(env["in"], F.when(env["in"].column == params["when"], F.lit(params["code"]))),
}
_PRICE = {"p": {}}


def _price_graph(spark, sf_dir, nodes, exports):
    g = _graph(nodes, exports, _PRICE)
    return lower_graph(g, _read(spark, sf_dir, "orders"), {"p": _num("o_totalprice")}, BODIES)


_LIMIT = {"id": "a", "routine": "q/limit@1", "params": {"most": 150000}, "in": {"in": "$input.p"}}
_TWICE = {"id": "b", "routine": "q/double@1", "in": {"in": "$input.p"}}


@_query("join_all", "SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN round(o_totalprice + o_totalprice * 2, 2) END AS total FROM orders")
def join_all(spark, sf_dir):
    low = _price_graph(spark, sf_dir, [_LIMIT, _TWICE, {"id": "c", "routine": "q/sum@1", "joins": {"in": "all"}, "in": {"in": ["a", "b"]}}], {"total": "c"})
    return low.exported("o_orderkey").select("o_orderkey", F.round("total", 2).alias("total"))


@_query("join_any_tagged", "SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN 2 ELSE 1 END::BIGINT AS n_ok FROM orders")
def join_any_tagged(spark, sf_dir):
    low = _price_graph(spark, sf_dir, [_LIMIT, _TWICE, {"id": "c", "routine": "q/count@1", "joins": {"in": "any"}, "in": {"in": ["a", "b"]}}], {"n_ok": "c"})
    return low.exported("o_orderkey").select("o_orderkey", F.col("n_ok").cast("long").alias("n_ok"))


@_query("failure_cascade", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'failed' ELSE 'executed' END AS first, CASE WHEN o_totalprice > 150000 THEN 'cancelled' ELSE 'executed' END AS last, CASE WHEN o_totalprice > 150000 THEN 'failed' END AS cause_kind, CASE WHEN o_totalprice > 150000 THEN 'a' END AS cause_node FROM orders")
def failure_cascade(spark, sf_dir):
    """The last of a chain is cancelled with the cause of the first."""
    low = _price_graph(spark, sf_dir, [_LIMIT, {"id": "m", "routine": "q/double@1", "in": {"in": "a"}}, {"id": "z", "routine": "vec/echo@1", "in": {"in": "m"}}], {"out": "z"})
    return low.df.select("o_orderkey", F.col("a__o").alias("first"), F.col("z__o").alias("last"), F.col("z__ck").alias("cause_kind"), F.col("z__cn").alias("cause_node"))


@_query("cause_order", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'a' WHEN o_totalprice < 100000 THEN 's' END AS cause_node, CASE WHEN o_totalprice > 150000 THEN 'failed' WHEN o_totalprice < 100000 THEN 'port_absent' END AS cause_kind FROM orders")
def cause_order(spark, sf_dir):
    """Of two dead inputs the first binding names the cause."""
    nodes = [_LIMIT, {"id": "s", "routine": "q/split@1", "in": {"in": "$input.p"}}, {"id": "c", "routine": "q/sum@1", "joins": {"in": "all"}, "in": {"in": ["a", "s.high"]}}]
    low = _price_graph(spark, sf_dir, nodes, {"out": "c"})
    return low.df.select("o_orderkey", F.col("c__cn").alias("cause_node"), F.col("c__ck").alias("cause_kind"))


@_query("port_absent", "SELECT count(*) FILTER (o_totalprice >= 100000) AS executed, count(*) FILTER (o_totalprice < 100000) AS cancelled, count(*) FILTER (o_totalprice < 100000) AS port_absent FROM orders")
def port_absent(spark, sf_dir):
    low = _price_graph(spark, sf_dir, [{"id": "s", "routine": "q/split@1", "in": {"in": "$input.p"}}, {"id": "e", "routine": "vec/echo@1", "in": {"in": "s.high"}}], {"out": "e"})
    return low.df.agg(F.count_if(F.col("e__o") == "executed").alias("executed"), F.count_if(F.col("e__o") == "cancelled").alias("cancelled"), F.count_if(F.col("e__ck") == "port_absent").alias("port_absent"))


@_query("route_gate", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS high, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_totalprice * 2 END AS low, CASE WHEN o_totalprice > 200000 THEN 'low' ELSE 'high' END AS routed FROM orders")
def route_gate(spark, sf_dir):
    nodes = [
        {"id": "d", "species": "decision", "rules": [{"route": "high", "when": {"expr": "p > 200000"}, "to": ["h"]}], "default": "low", "defaultTo": ["l"], "in": {"p": "$input.p"}},
        {"id": "h", "routine": "vec/echo@1", "in": {"in": "$input.p"}},
        {"id": "l", "routine": "q/double@1", "in": {"in": "$input.p"}},
    ]
    low = _price_graph(spark, sf_dir, nodes, {"high": "h", "low": "l"})
    return low.df.select("o_orderkey", F.col("h__v").alias("high"), F.col("l__v").alias("low"), F.coalesce(F.when(F.col("h__ck") == "routed", F.col("h__cp")), F.col("l__cp")).alias("routed"))


@_query("absorb_fact", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'q/over' END AS code, 'executed' AS outcome FROM orders")
def absorb_fact(spark, sf_dir):
    low = _price_graph(spark, sf_dir, [_LIMIT | {"absorb": True}], {"out": "a"})
    return low.df.select("o_orderkey", F.col("a__e").alias("code"), F.col("a__o").alias("outcome"))


def _invoke(spark, sf_dir):
    reg = column_registry()
    reg.graphs["q/child@1"] = ({"name": "child", "inputs": {"x": {}}, "nodes": [{"id": "lim", "routine": "q/limit@1", "params": {"most": 150000}, "in": {"in": "$input.x"}}, {"id": "two", "routine": "q/double@1", "in": {"in": "lim"}}], "exports": [{"name": "twice", "from": "two"}]}, None)
    g = _graph([{"id": "i", "species": "invoke", "graph": "q/child@1", "in": {"x": "$input.p"}}, {"id": "o", "routine": "vec/echo@1", "in": {"in": "i.twice"}}], {"out": "o"}, _PRICE, reg)
    return lower_graph(g, _read(spark, sf_dir, "orders"), {"p": _num("o_totalprice")}, BODIES)


@_query("invoke_export", "SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN o_totalprice * 2 END AS out FROM orders")
def invoke_export(spark, sf_dir):
    return _invoke(spark, sf_dir).exported("o_orderkey")


@_query("invoke_dead_export", "SELECT CASE WHEN o_totalprice <= 150000 THEN 'executed' ELSE 'cancelled' END AS outcome, CASE WHEN o_totalprice > 150000 THEN 'i/lim' END AS cause_node, count(*) AS n FROM orders GROUP BY 1, 2")
def invoke_dead_export(spark, sf_dir):
    low = _invoke(spark, sf_dir)
    return low.df.groupBy(F.col("i__o").alias("outcome"), F.col("i__cn").alias("cause_node")).agg(F.count(F.lit(1)).alias("n"))


_LINES = "SELECT o_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (l_orderkey IS NOT NULL) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
_FAN = f"SELECT o_orderkey, coalesce(len(list_filter(q, lambda x: x <= 45)), 0)::BIGINT AS n_ok, coalesce(len(list_filter(q, lambda x: x > 45)), 0)::BIGINT AS n_error FROM ({_LINES})"


def _over_45(x: Column) -> tuple[Column, Column]:
    return x * 2, F.when(x > 45, "q/over")


def _lines_graph(spark, sf_dir, absorb: bool, lines: DataFrame | None = None) -> Lowered:
    """Every quantity of an order through the body q/limit@1, in place."""
    node = {"id": "m", "routine": "q/limit@1", "params": {"most": 45}, "absorb": absorb, "in": {"in": "$input.q[*]"}}
    g = _graph([node], {"m": "m"}, {"q": {}})
    df = _orders_lines(spark, sf_dir) if lines is None else lines
    return lower_graph(g, df, {"q": Typed(F.col("q"), "list", Typed(None, "number"))}, BODIES)


def _counts(df: DataFrame, gather: str) -> DataFrame:
    n = lambda s: F.size(F.filter(gather, lambda e: e["status"] == s)).cast("long")
    return df.select("o_orderkey", n("ok").alias("n_ok"), n("error").alias("n_error"))


@_query("fanout_transform", _FAN)
def fanout_transform(spark, sf_dir):
    return _counts(_lines_graph(spark, sf_dir, True).df, "m__v")


@_query("fanout_explode", _FAN)
def fanout_explode(spark, sf_dir):
    return _counts(exploded(_orders_lines(spark, sf_dir), "o_orderkey", "q", _over_45, "m", absorb=True), "m__gather")


@_query("fanout_fail_lowest", f"SELECT o_orderkey, CASE WHEN len(list_filter(q, lambda x: x > 45)) > 0 THEN 'kernel/fanout_child' END AS error, (list_position(list_transform(q, lambda x: x > 45), true) - 1)::BIGINT AS failed_index FROM ({_LINES})")
def fanout_fail_lowest(spark, sf_dir):
    return _lines_graph(spark, sf_dir, False).df.select("o_orderkey", F.col("m__e").alias("error"), F.col("m__i").cast("long").alias("failed_index"))


@_query("fanout_bind_miss", "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'click') AS missed FROM events GROUP BY 1")
def fanout_bind_miss(spark, sf_dir):
    """A child whose bound path is missing fails with kernel/bind and is not invoked."""
    df = _with_k(spark, sf_dir).withColumn("items", F.array(F.struct("k")))
    g = _graph([{"id": "m", "routine": "q/double@1", "bind": {"in": "k"}, "absorb": True, "in": {"items": "$input.items[*]"}}], {"m": "m"}, {"items": {}})
    low = lower_graph(g, df, {"items": column_of(df, "items")}, BODIES)
    missed = F.size(F.filter("m__v", lambda e: F.coalesce(e["code"] == "kernel/bind", F.lit(False)))) > 0
    return low.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(missed).alias("missed"))


@_query("fanout_broadcast", f"SELECT o_orderkey, round(list_sum(list_transform(q, lambda x: x / 50)), 6) AS total FROM ({_LINES})")
def fanout_broadcast(spark, sf_dir):
    """The bound field of each element against an input that all children share."""
    df = _orders_lines(spark, sf_dir).withColumn("items", F.transform("q", lambda x: F.struct(F.struct(x.alias("n")).alias("q"))))
    nodes = [{"id": "c", "routine": "vec/const@1", "params": {"value": 50}}, {"id": "m", "routine": "q/share@1", "bind": {"in": "q.n"}, "in": {"items": "$input.items[*]", "of": "c"}}]
    low = lower_graph(_graph(nodes, {"m": "m"}, {"items": {}}), df, {"items": column_of(df, "items")}, BODIES)
    total = F.aggregate("m__v", F.lit(0.0), lambda a, e: a + e["value"])
    return low.df.select("o_orderkey", F.round(F.when(F.size("q") > 0, total), 6).alias("total"))


@_query("fanout_graph_column", f"SELECT o_orderkey, list_sum(list_transform(list_filter(q, lambda x: x <= 45), lambda x: x * 2)) AS total, CASE WHEN len(list_filter(q, lambda x: x > 45)) > 0 THEN 'cancelled' END AS code FROM ({_LINES})")
def fanout_graph_column(spark, sf_dir):
    """A graph as body of a fan-out, in place: a failure within a child cancels its export."""
    reg = column_registry()
    reg.graphs["q/body@1"] = ({"name": "body", "inputs": {"x": {}}, "nodes": [{"id": "lim", "routine": "q/limit@1", "params": {"most": 45}, "in": {"in": "$input.x"}}, {"id": "two", "routine": "q/double@1", "in": {"in": "lim"}}], "exports": [{"name": "out", "from": "two"}]}, None)
    g = _graph([{"id": "m", "species": "map", "body": "q/body@1", "over": "x", "absorb": True, "in": {"x": "$input.q"}}], {"m": "m"}, {"q": {}}, reg)
    low = lower_graph(g, _orders_lines(spark, sf_dir), {"q": Typed(F.col("q"), "list", Typed(None, "number"))}, BODIES)
    good = F.filter("m__v", lambda e: e["status"] == "ok")
    total = F.aggregate(good, F.lit(0.0), lambda a, e: a + e["value"]["out"])
    return low.df.select("o_orderkey", F.when(F.size(good) > 0, total).alias("total"), F.array_min(F.transform(F.filter("m__v", lambda e: e["status"] == "error"), lambda e: e["code"])).alias("code"))


def _sql_u64(n: str) -> str:
    return f"unhex(lpad(to_hex({n}), 16, '0'))"


_SQL_STRING = lambda c: f"sha256(unhex('05') || {_sql_u64(f'octet_length(encode({c}))')} || encode({c}))"
_SQL_LIST = lambda *h: "sha256(unhex('06') || " + _sql_u64(str(len(h))) + "".join(f" || unhex({x})" for x in h) + ")"


@_query("structural_hash_string", f"SELECT c_custkey, {_SQL_STRING('c_name')} AS h FROM customer")
def structural_hash_string(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", V.hash_string(F.col("c_name")).alias("h"))


@_query("structural_hash_int", "SELECT o_orderkey, sha256(unhex('0300' || lpad(to_hex(len(hx) // 2), 16, '0') || hx)) AS h FROM (SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN '' ELSE lpad(to_hex(o_custkey), (len(to_hex(o_custkey)) + len(to_hex(o_custkey)) % 2)::INTEGER, '0') END AS hx FROM orders)")
def structural_hash_int(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", V.hash_integer(F.col("o_custkey")).alias("h"))


@_query("idempotency_key", f"SELECT o_orderkey, {_SQL_LIST(_SQL_STRING('o_orderkey::VARCHAR'), _SQL_STRING(chr(39) + 'send' + chr(39)))} AS k FROM orders")
def idempotency_key(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", FT.idempotency_key(F.col("o_orderkey").cast("string"), "send").alias("k"))


def _order_facts(spark, sf_dir):
    return _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("execution_id"), F.lit("a").alias("key"), F.col("o_totalprice").alias("fact"))


@_query("replay_skip", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 2 END AS v, o_orderstatus = 'F' AS skipped FROM orders")
def replay_skip(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").withColumn("execution_id", F.col("o_orderkey").cast("string"))
    got = FT.replay(df, _order_facts(spark, sf_dir), "a", "a")
    return got.select("o_orderkey", F.when(F.col("a__skipped"), F.col("a__replayed")).otherwise(F.col("o_totalprice") * 2).alias("v"), F.col("a__skipped").alias("skipped"))


@_query("anti_work", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def anti_work(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").withColumn("execution_id", F.col("o_orderkey").cast("string"))
    return FT.unsettled(df, _order_facts(spark, sf_dir), "a").select("o_orderkey")


@_query("memo_hits", "SELECT count(*) FILTER (p_size <= 25) AS hits, count(DISTINCT CASE WHEN p_size > 25 THEN p_size END) AS to_compute FROM part")
def memo_hits(spark, sf_dir):
    key = lambda c: FT.memo_key("q/double@1", V.hash_map({"in": V.hash_integer(c)}), V.hash_map({}))
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    memo = parts.filter("p_size <= 25").select(key(F.col("p_size")).alias("memo_key"), (F.col("p_size") * 2).alias("value")).dropDuplicates(["memo_key"])
    joined, todo = FT.with_memo(parts.withColumn("mk", key(F.col("p_size"))), memo, "mk")
    hits = joined.agg(F.count_if("cached").alias("hits"), F.lit(0).cast("long").alias("to_compute"))
    rest = todo.agg(F.lit(0).cast("long").alias("hits"), F.count(F.lit(1)).alias("to_compute"))
    return hits.union(rest).agg(F.sum("hits").alias("hits"), F.sum("to_compute").alias("to_compute"))


def _ready(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("cost_class"))


@_query("budgeted_selection", "SELECT o_orderkey AS ord, o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS selected FROM orders")
def budgeted_selection(spark, sf_dir):
    return FT.budgeted(_ready(spark, sf_dir), {"1-URGENT": 2, "5-LOW": 1}).select("ord", "selected")


@_query("defer_costly", "SELECT o_orderkey AS ord, r = min(r) OVER (PARTITION BY o_custkey) AS selected FROM (SELECT *, CASE o_orderpriority WHEN '3-MEDIUM' THEN '0' WHEN '5-LOW' THEN '1' ELSE '9' || o_orderpriority END AS r FROM orders)")
def defer_costly(spark, sf_dir):
    return FT.defer_costly(_ready(spark, sf_dir), ["3-MEDIUM", "5-LOW"]).select("ord", "selected")


@_query("cost_used", "SELECT o_orderpriority AS cost_class, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 1 END) AS BIGINT) AS ticks FROM orders GROUP BY 1")
def cost_used(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cost_class"), F.when(F.col("o_orderstatus") == "P", 3).otherwise(1).alias("attempts"))
    return FT.cost_used(rows)


@_query("seal_facts", f"SELECT c_custkey, true AS sealed, {_SQL_STRING('c_name')} AS content_hash FROM customer")
def seal_facts(spark, sf_dir):
    df = _read(spark, sf_dir, "customer").withColumn("s", FT.sealed(V.hash_string(F.col("c_name"))))
    return df.select("c_custkey", F.col("s.sealed").alias("sealed"), F.col("s.contentHash").alias("content_hash"))


def _versions() -> tuple[Graph, Graph]:
    reg = column_registry()
    a = _graph([_LIMIT, _TWICE, {"id": "c", "routine": "vec/echo@1", "in": {"in": "a"}}], {"x": "b", "y": "c"}, _PRICE, reg)
    spec = {"name": "q", "inputs": _PRICE, "renames": {"b": "b2"}, "nodes": [_LIMIT | {"params": {"most": 9}}, _TWICE | {"id": "b2"}, {"id": "n", "routine": "vec/echo@1", "in": {"in": "$input.p"}}], "exports": [{"name": "x", "from": "b2"}, {"name": "y", "from": "a"}, {"name": "z", "from": "n"}]}
    return a, compile_graph(spec, reg)


def _old_facts(spark, sf_dir):
    old, _ = _versions()
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(old.derivations.get(k, "")).alias("derivation")) for k in ("$in/p", "a", "b", "c")])
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.explode(keys).alias("f")).select("execution_id", "f.*")


@_query("migrate_classify", "SELECT o_orderkey AS execution_id, k AS key, CASE k WHEN '$in/p' THEN 'caller' WHEN 'a' THEN 'invalidate' WHEN 'b' THEN 'rename' ELSE 'orphan' END AS classification, CASE k WHEN '$in/p' THEN k WHEN 'b' THEN 'b2' END AS new_key FROM orders, (VALUES ('$in/p'), ('a'), ('b'), ('c')) t(k)")
def migrate_classify(spark, sf_dir):
    return classify(_old_facts(spark, sf_dir), _versions()[1]).select("execution_id", "key", "classification", "new_key")


@_query("migrate_new", "SELECT o_orderkey AS execution_id, k AS new_key FROM orders, (VALUES ('a'), ('n')) t(k)")
def migrate_new(spark, sf_dir):
    new = _versions()[1]
    return new_positions(classify(_old_facts(spark, sf_dir), new), new).select("execution_id", "new_key")


def _flaky_graph() -> Graph:
    return _graph(
        [
            {"id": "v", "routine": "vec/flaky@1", "params": {"succeed_on": 2}, "retry": {"maxAttempts": 3}, "in": {"value": "$input.x"}},
            {"id": "f", "routine": "vec/failif@1", "params": {"when": "error", "code": "q/error"}, "in": {"in": "$input.x"}},
            {"id": "e", "routine": "vec/echo@1", "in": {"in": "f"}},
        ],
        {"a": "v", "b": "e"},
        {"x": {}},
        stock_registry(),
    )


def _executions(spark, sf_dir) -> DataFrame:
    entry = F.concat(F.lit('{"$in/x":"'), F.col("event_type"), F.lit('"}'))
    return _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), F.when(F.col("event_type") != "view", entry).alias("facts"))


@_query("wave_outcomes", "SELECT key, CASE WHEN event_type = 'view' THEN 'blocked' WHEN key = 'f' AND event_type = 'error' THEN 'failed' WHEN key = 'e' AND event_type = 'error' THEN 'cancelled' ELSE 'executed' END AS outcome, CASE WHEN event_type <> 'view' AND key = 'v' THEN 2 WHEN event_type = 'error' AND key = 'f' THEN 1 END::BIGINT AS attempts, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) GROUP BY 1, 2, 3")
def wave_outcomes(spark, sf_dir):
    """Retries, failures, cancellations and blocked nodes by the wave runtime, an event an execution."""
    rows = execute_all(_flaky_graph(), _executions(spark, sf_dir))
    return rows.groupBy("key", "outcome", "attempts").agg(F.count(F.lit(1)).alias("n"))


@_query("wave_single", "SELECT key, CASE WHEN event_type = 'view' THEN 'blocked' WHEN key = 'f' AND event_type = 'error' THEN 'failed' WHEN key = 'e' AND event_type = 'error' THEN 'cancelled' WHEN key = 'e' THEN 'yielded' ELSE 'executed' END AS outcome, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) GROUP BY 1, 2")
def wave_single(spark, sf_dir):
    rows = execute_all(_flaky_graph(), _executions(spark, sf_dir), lambda: Capabilities(policy="single-wave"))
    return rows.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query("fanout_graph_body", "SELECT event_type, 3 * count(*) AS children, count(*) AS gathers FROM events GROUP BY 1")
def fanout_graph_body(spark, sf_dir):
    reg = stock_registry()
    reg.graphs["q/body@1"] = ({"name": "body", "inputs": {"x": {}}, "nodes": [{"id": "p", "routine": "vec/pack@1", "in": {"a0": "$input.x"}}], "exports": [{"name": "out", "from": "p.a0"}]}, None)
    g = _graph([{"id": "c", "routine": "vec/const@1", "params": {"value": [1, 2, 3]}}, {"id": "m", "species": "map", "body": "q/body@1", "over": "x", "in": {"x": "c"}}], {"m": "m"}, None, reg)
    events = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), "event_type")
    rows = execute_all(g, events.withColumn("facts", F.lit(None).cast("string")), detail="light", carry=("event_type",)).filter("outcome = 'executed'")
    return rows.groupBy("event_type").agg(F.count_if(F.col("key").rlike("^m/[0-9]+$")).alias("children"), F.count_if(F.col("key") == "m").alias("gathers"))


@_query("ingest_canonical", "SELECT event_id AS key, replace(props, ' ', '') AS canonical, NULL::VARCHAR AS reject_reason FROM events")
def ingest_canonical(spark, sf_dir):
    return ingested(_read(spark, sf_dir, "events"), "event_id", "props").select("key", "canonical", "reject_reason")


_BAD = ['{"a":1,"a":2}', "9007199254740992", "1e999", '"\\ud800"', "1" * 101, "[" * 65 + "]" * 65]


@_query("ingest_rejects", "SELECT r AS reject_reason, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'integer_range' WHEN 2 THEN 'overflow' WHEN 3 THEN 'surrogate' WHEN 4 THEN 'number_literal_length' ELSE 'depth' END AS r FROM events) GROUP BY 1")
def ingest_rejects(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _BAD)), (F.col("event_id") % 6 + 1).cast("int"))
    got = ingested(_read(spark, sf_dir, "events").withColumn("t", text), "event_id", "t")
    return got.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


# Values.


@_query("canonical_render", """SELECT event_id AS key, '{"a":[1,"' || event_type || '"],"b":' || event_id || ',"k":' || replace(props, ' ', '') || '}' AS canonical FROM events""")
def canonical_render(spark, sf_dir):
    """Sorted keys, no white space, integral numbers as integers."""
    text = F.concat(F.lit('{"b": '), F.col("event_id"), F.lit(', "a" : [1.0, "'), F.col("event_type"), F.lit('"], "k":'), F.col("props"), F.lit("}"))
    return ingested(_read(spark, sf_dir, "events").withColumn("t", text), "event_id", "t").select("key", "canonical")


@_query("number_unify", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 2 = 0 THEN (l_quantity / 2)::BIGINT::VARCHAR ELSE (l_quantity / 2)::VARCHAR END AS number FROM lineitem")
def number_unify(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.unified(F.col("l_quantity") / 2).alias("number"))


@_query("json_pointer", "SELECT event_id, event_id AS first, CAST(json_extract_string(props, '$.k') AS BIGINT) AS second, false AS third FROM events")
def json_pointer(spark, sf_dir):
    v = F.parse_json(F.concat(F.lit('{"a/b":[{"~":'), F.col("event_id"), F.lit("},"), F.col("props"), F.lit("]}")))
    df = _read(spark, sf_dir, "events").withColumn("v", v)
    at = lambda path: V.pointer_in(F.col("v"), path)
    return df.select("event_id", at("/a~1b/0/~0").cast("long").alias("first"), at("/a~1b/1/k").cast("long").alias("second"), at("/a~1b/01").isNotNull().alias("third"))


@_query("manifest_compare", "SELECT state, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' ELSE 'extra' END AS state FROM customer UNION ALL SELECT 'missing' FROM customer WHERE c_custkey % 5 = 0) GROUP BY 1")
def manifest_compare(spark, sf_dir):
    files = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").cast("binary").alias("content"), "c_custkey")
    known = files.filter("c_custkey % 3 < 2").select("path", F.when(F.col("c_custkey") % 3 == 0, F.sha2("content", 256)).otherwise("00").alias("sha256"))
    gone = files.filter("c_custkey % 5 = 0").select(F.concat(F.lit("x"), "path").alias("path"), F.lit("00").alias("sha256"))
    return manifest(files.select("path", "content"), known.union(gone)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Edges and paths.

_NESTED = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@_query("path_nested", f"SELECT event_id, CASE WHEN event_id > 50 AND {_NESTED} <= 40 THEN 'a' WHEN event_type = 'click' THEN 'b' ELSE 'c' END AS selected, event_id AS second FROM events")
def path_nested(spark, sf_dir):
    """Paths into a VARIANT: in rules, on an edge and on an export."""
    v = F.parse_json(F.concat(F.lit('{"k":'), F.col("props"), F.lit(',"l":[1,'), F.col("event_id"), F.lit('],"t":"'), F.col("event_type"), F.lit('"}')))
    df = _read(spark, sf_dir, "events").withColumn("v", v)
    rules = [{"route": "a", "when": {"expr": "x.l[1] > 50 && x.k.k <= 40"}}, {"route": "b", "when": {"expr": 'absent(x.zz) && x.l.0 == 1 && x.t == "click" && size(x.l) == 2 && x.t != 1'}}]
    nodes = [{"id": "e", "routine": "vec/echo@1", "in": {"in": "$input.x"}}, {"id": "d", "species": "decision", "rules": rules, "default": "c", "in": {"x": "e"}}, {"id": "l", "routine": "vec/echo@1", "in": {"in": "e.l"}}]
    low = lower_graph(_graph(nodes, {"selected": "d.selected", "second": "l.1"}, {"x": {}}), df, {"x": column_of(df, "v")}, BODIES)
    return low.exported("event_id").withColumn("second", F.col("second").cast("long"))


@_query("order_edge", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'cancelled' ELSE 'executed' END AS outcome, CASE WHEN o_totalprice > 150000 THEN 'failed' END AS cause_kind FROM orders")
def order_edge(spark, sf_dir):
    """A node that only has to come after another goes with it."""
    low = _price_graph(spark, sf_dir, [_LIMIT, _TWICE | {"needs": ["a"]}], {"x": "a", "y": "b"})
    return low.df.select("o_orderkey", F.col("b__o").alias("outcome"), F.col("b__ck").alias("cause_kind"))


@_query("retry_attempts", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 'executed' ELSE 'failed' END AS outcome, least(l_linenumber, 3)::BIGINT AS attempts, CASE WHEN l_linenumber > 3 THEN 'q/again' END AS code FROM lineitem")
def retry_attempts(spark, sf_dir):
    """Attempt k succeeds where the line number is at most k; three attempts, unrolled."""
    g = _graph([{"id": "r", "routine": "q/again@1", "retry": {"maxAttempts": 3}, "in": {"in": "$input.n"}}], {"out": "r"}, {"n": {}})
    low = lower_graph(g, _read(spark, sf_dir, "lineitem"), {"n": _num("l_linenumber")}, BODIES)
    return low.df.select("l_orderkey", "l_linenumber", F.col("r__o").alias("outcome"), F.col("r__a").alias("attempts"), F.col("r__e").alias("code"))


_OUTCOMES = "SELECT key, CASE WHEN event_type = 'view' THEN 'blocked' WHEN key = 'f' AND event_type = 'error' THEN 'failed' WHEN key = 'e' AND event_type = 'error' THEN 'cancelled' ELSE 'executed' END AS outcome, CASE WHEN event_type <> 'view' AND key = 'v' THEN 2 WHEN event_type = 'error' AND key = 'f' THEN 1 END::BIGINT AS attempts, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) GROUP BY 1, 2, 3"


def _flaky_columns(spark, sf_dir) -> Lowered:
    df = _read(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_type") != "view", F.col("event_type")))
    return lower_graph(_flaky_graph(), df, {"x": _str("x")}, BODIES)


@_query("column_outcomes", _OUTCOMES)
def column_outcomes(spark, sf_dir):
    """The graph of wave_outcomes without leaving the JVM: retries unrolled, absent inputs block."""
    return _flaky_columns(spark, sf_dir).report("event_id").groupBy("key", "outcome", "attempts").agg(F.count(F.lit(1)).alias("n"))


_AWAITED = "SELECT key, CASE WHEN key = 'e' THEN 'f' ELSE '$in/x' END AS awaited, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) WHERE event_type = 'view' GROUP BY 1, 2"


@_query("column_awaiting", _AWAITED)
def column_awaiting(spark, sf_dir):
    rows = _flaky_columns(spark, sf_dir).report("event_id")
    return rows.select("key", F.explode("awaiting").alias("awaited")).groupBy("key", "awaited").agg(F.count(F.lit(1)).alias("n"))


@_query("awaiting_keys", _AWAITED)
def awaiting_keys(spark, sf_dir):
    rows = execute_all(_flaky_graph(), _executions(spark, sf_dir))
    return rows.select("key", F.explode("awaiting").alias("awaited")).groupBy("key", "awaited").agg(F.count(F.lit(1)).alias("n"))


def _injected() -> Graph:
    reg = stock_registry()
    reg.graphs["q/child@1"] = ({"name": "child", "inputs": {"x": {}}, "nodes": [{"id": "k", "routine": "vec/echo@1", "in": {"in": "$input.x"}}], "exports": [{"name": "out", "from": "k"}]}, None)
    return _graph([{"id": "i", "species": "invoke", "graph": "q/child@1"}], {"o": "i.out"}, None, reg)


_INJECTED = "SELECT event_id, CASE WHEN event_type = 'view' THEN 'blocked' ELSE 'executed' END AS outcome, CASE WHEN event_type <> 'view' THEN event_type END AS out FROM events"


@_query("child_injection", _INJECTED)
def child_injection(spark, sf_dir):
    """An input of an invoked graph that no edge feeds comes from the fact <node>/$in/<name>."""
    df = _read(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_type") != "view", F.col("event_type")))
    low = lower_graph(_injected(), df, {}, BODIES, {"i/$in/x": _str("x")})
    return low.df.select("event_id", F.col("i__o").alias("outcome"), F.col("i__v_out").alias("out"))


@_query("child_injection_waves", _INJECTED)
def child_injection_waves(spark, sf_dir):
    facts = F.concat(F.lit('{"i/$in/x":"'), F.col("event_type"), F.lit('"}'))
    events = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), F.when(F.col("event_type") != "view", facts).alias("facts"))
    rows = execute_all(_injected(), events).filter("key = 'i'")
    return rows.select(F.col("execution_id").cast("long").alias("event_id"), "outcome", F.get_json_object("output", "$.out").alias("out"))


# Waves and their reports.


def _echo_graph() -> Graph:
    return _graph([{"id": "c", "routine": "vec/const@1", "params": {"value": 7}}, {"id": "p", "routine": "vec/pack@1", "in": {"a0": "c", "a1": "$input.x"}}], {"o": "p"}, {"x": {}}, stock_registry())


@_query("facts_unified", """SELECT event_id::VARCHAR AS execution_id, '{"a0":7,"a1":' || event_id || '}' AS output FROM events""")
def facts_unified(spark, sf_dir):
    """Entry facts are read strictly and take their one form."""
    events = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), F.concat(F.lit('{"$in/x": '), F.col("event_id"), F.lit(".0}")).alias("facts"))
    return execute_all(_echo_graph(), events).filter("key = 'p'").select("execution_id", "output")


_ODD_FACTS = ["{bad", '{"$in/x":NaN}', '{"$in/x":1,"$in/x":2}', '{"$in/x":9007199254740993}', "[]", '{"$in/x":1}']


@_query("kernel_error_rows", "SELECT outcome, error_code, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 5 THEN 'executed' ELSE 'kernel_error' END AS outcome, CASE event_id % 6 WHEN 0 THEN 'ingest/syntax' WHEN 1 THEN 'ingest/syntax' WHEN 2 THEN 'ingest/duplicate_key' WHEN 3 THEN 'ingest/integer_range' WHEN 4 THEN 'ingest/facts_not_a_map' END AS error_code FROM events UNION ALL SELECT 'executed', NULL FROM events WHERE event_id % 6 = 5) GROUP BY 1, 2")
def kernel_error_rows(spark, sf_dir):
    """Facts that are no values end their own execution and no other."""
    text = F.element_at(F.array(*map(F.lit, _ODD_FACTS)), (F.col("event_id") % 6 + 1).cast("int"))
    events = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), text.alias("facts"))
    return execute_all(_echo_graph(), events).groupBy("outcome", "error_code").agg(F.count(F.lit(1)).alias("n"))


@_query("report_facts", """SELECT 'c' AS key, '7' AS fact, 'routine' AS species, 'vec/const@1' AS routine, false AS cached, count(*) AS n FROM events
    UNION ALL SELECT 'p', '{"a0":7,"a1":"' || event_type || '"}', 'routine', 'vec/pack@1', false, count(*) FROM events WHERE event_type <> 'view' GROUP BY 2""")
def report_facts(spark, sf_dir):
    facts = reports(_echo_graph(), _executions(spark, sf_dir)).facts
    return facts.groupBy("key", "fact", "species", "routine", "cached").agg(F.count(F.lit(1)).alias("n"))


@_query("report_summary", """SELECT quiescent, yield_reason, cost_used, count(*) AS n FROM (SELECT event_type IN ('view', 'error') AS quiescent, CASE WHEN event_type NOT IN ('view', 'error') THEN 'single-wave' END AS yield_reason, CASE WHEN event_type = 'view' THEN '{}' ELSE '{"default":1,"effect":2}' END AS cost_used FROM events) GROUP BY 1, 2, 3""")
def report_summary(spark, sf_dir):
    summary = reports(_flaky_graph(), _executions(spark, sf_dir), lambda: Capabilities(policy="single-wave")).summary
    return summary.groupBy("quiescent", "yield_reason", "cost_used").agg(F.count(F.lit(1)).alias("n"))


@_query("observe_events", "SELECT event, CAST(sum(CASE WHEN event_type = 'view' THEN a WHEN event_type = 'error' THEN b ELSE c END) AS BIGINT) AS n FROM events, (VALUES ('execution_started', 1, 1, 1), ('wave_started', 0, 1, 2), ('node_started', 0, 2, 3), ('node_retrying', 0, 1, 1), ('node_settled', 0, 3, 3), ('execution_ended', 1, 1, 1)) t(event, a, b, c) GROUP BY 1")
def observe_events(spark, sf_dir):
    events = reports(_flaky_graph(), _executions(spark, sf_dir), observe=True).events
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@_query("row_order", "SELECT ord, key, count(*) AS n FROM events, (VALUES (0, 'f'), (1, 'e'), (2, 'v')) t(ord, key) GROUP BY 1, 2")
def row_order(spark, sf_dir):
    """Canonical order: the smallest id whose sources have gone before."""
    return execute_all(_flaky_graph(), _executions(spark, sf_dir)).groupBy("ord", "key").agg(F.count(F.lit(1)).alias("n"))


@_query("script_policy", "SELECT key, CASE WHEN event_type = 'view' THEN 'blocked' WHEN key = 'f' THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'executed' END WHEN key = 'e' AND event_type = 'error' THEN 'cancelled' ELSE 'yielded' END AS outcome, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) GROUP BY 1, 2")
def script_policy(spark, sf_dir):
    rows = execute_all(_flaky_graph(), _executions(spark, sf_dir), lambda: Capabilities(policy="script", config={"waves": [["f"], {"yield": "enough"}]}))
    return rows.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query("unlawful_policy", "SELECT CASE WHEN event_type = 'view' THEN 'blocked' ELSE 'kernel_error' END AS outcome, CASE WHEN event_type <> 'view' THEN 'kernel/policy' END AS error_code, count(*) * CASE WHEN event_type = 'view' THEN 3 ELSE 1 END AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'x' END AS event_type FROM events) GROUP BY event_type")
def unlawful_policy(spark, sf_dir):
    rows = execute_all(_flaky_graph(), _executions(spark, sf_dir), lambda: Capabilities(decide=lambda ready, used, wave: ("run", ["nope"])))
    return rows.groupBy("outcome", "error_code").agg(F.count(F.lit(1)).alias("n"))


def _odd(env: dict) -> dict:
    got, nested = env["in"], 0
    if got == "error":
        raise ValueError("broken")
    if got == "click":
        return {"value": 1, "other": 2}
    for _ in range(70 if got == "signup" else 0):
        nested = [nested]
    return {"value": nested}


@_query("crash_convert", "SELECT CASE event_type WHEN 'view' THEN 'blocked' WHEN 'purchase' THEN 'executed' ELSE 'failed' END AS outcome, CASE event_type WHEN 'error' THEN 'kernel/crash' WHEN 'click' THEN 'kernel/emission' WHEN 'signup' THEN 'kernel/bounds' END AS error_code, count(*) AS n FROM events GROUP BY 1, 2")
def crash_convert(spark, sf_dir):
    """A routine that raises, emits what it did not declare, or breaks a bound fails; the job goes on."""
    reg = stock_registry()
    reg.routines["q/odd@1"], reg.implementations["q/odd@1"] = contract([{"name": "in"}], [{"port": "value"}]), _odd
    g = _graph([{"id": "o", "routine": "q/odd@1", "retry": {"maxAttempts": 3}, "in": {"in": "$input.x"}}], {"out": "o"}, {"x": {}}, reg)
    return execute_all(g, _executions(spark, sf_dir)).groupBy("outcome", "error_code").agg(F.count(F.lit(1)).alias("n"))


@_query("replay_rows", "SELECT key, CASE WHEN event_type = 'view' AND key <> 'v' OR key = 'f' THEN CASE WHEN key = 'f' THEN 'skipped' ELSE 'executed' END WHEN event_type = 'view' THEN 'blocked' ELSE 'executed' END AS outcome, count(*) AS n FROM events, (VALUES ('v'), ('f'), ('e')) t(key) GROUP BY 1, 2")
def replay_rows(spark, sf_dir):
    """A settled node is skipped and its fact is read, whatever its inputs are now."""
    kept = F.concat(F.lit('{"f":"kept"'), F.when(F.col("event_type") != "view", F.concat(F.lit(',"$in/x":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit("}"))
    events = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("execution_id"), kept.alias("facts"))
    return execute_all(_flaky_graph(), events).groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query("memo_runtime", "SELECT event_type, true AS cached, count(*) AS n, (SELECT count(DISTINCT event_type) + 1 FROM events WHERE event_type <> 'view') AS entries FROM events WHERE event_type <> 'view' GROUP BY 1")
def memo_runtime(spark, sf_dir):
    """What one run computes is a table of as many rows as there are distinct calls; the next run takes all from it."""
    events = _executions(spark, sf_dir).withColumn("memo", F.lit("{}"))
    memo = reports(_echo_graph(), events).memo
    rows = reports(_echo_graph(), events.drop("memo"), memo=memo).rows.filter("key = 'p' and outcome = 'executed'")
    counted = rows.groupBy(F.get_json_object("output", "$.a1").alias("event_type"), "cached").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(memo.agg(F.count(F.lit(1)).alias("entries")))  # one row


@_query("drive_calls", "SELECT CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 2 END AS calls, true AS quiescent, count(*) AS n FROM events GROUP BY 1")
def drive_calls(spark, sf_dir):
    """The embedder's loop: executions that yield are called again with what they have committed."""
    _, summaries = drive(_flaky_graph(), _executions(spark, sf_dir), lambda: Capabilities(policy="single-wave"))
    return summaries.groupBy("calls", "quiescent").agg(F.count(F.lit(1)).alias("n"))


@_query("seal_vault", f"""SELECT {_SQL_STRING('c_name')} AS content_hash, '"' || c_name || '"' AS subject, '"' || c_name || '"' AS value FROM customer""")
def seal_vault(spark, sf_dir):
    """A personal fact leaves its plain value in the vault and its hash in the facts."""
    g = _graph([{"id": "s", "routine": "vec/sense@1", "in": {"in": "$input.who"}}], {"o": "s"}, {"who": {"subject": True}}, stock_registry())
    people = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("execution_id"), F.concat(F.lit('{"$in/who":"'), F.col("c_name"), F.lit('"}')).alias("facts"))
    return reports(g, people, vault=True).sealed.select("content_hash", "subject", "value")


@_query("idempotency_runtime", f"""SELECT o_orderkey::VARCHAR AS execution_id, '{{"key":"' || {_SQL_LIST(_SQL_STRING('o_orderkey::VARCHAR'), _SQL_STRING(chr(39) + 'k' + chr(39)))} || '"}}' AS output FROM orders""")
def idempotency_runtime(spark, sf_dir):
    g = _graph([{"id": "k", "routine": "vec/keyecho@1"}], {"o": "k"}, None, stock_registry())
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("execution_id"), F.lit(None).cast("string").alias("facts"))
    return execute_all(g, orders).select("execution_id", "output")


_STOCK = """('c', 'executed', NULL, '7', NULL, NULL), ('e', 'executed', NULL, '7', NULL, NULL), ('p', 'executed', NULL, '{"a0":7}', NULL, NULL), ('t', 'executed', NULL, '{"a":1,"b":"x"}', NULL, NULL),
    ('s', 'executed', NULL, '"scrubbed"', NULL, NULL), ('x', 'failed', 1, NULL, 't/x', 'said'), ('fl', 'executed', 2, '5', NULL, NULL), ('fm', 'failed', 2, NULL, 'vec/again', 'not yet'),
    ('fi', 'failed', 1, NULL, 't/y', 'matched'), ('fo', 'executed', NULL, '7', NULL, NULL), ('d', 'executed', NULL, '[[0]]', NULL, NULL)"""


@_query("stock_routines", f"SELECT key, outcome, attempts::BIGINT AS attempts, output, error_code, error_message, n FROM (VALUES {_STOCK}) t(key, outcome, attempts, output, error_code, error_message), (SELECT count(*) AS n FROM nation)")
def stock_routines(spark, sf_dir):
    nodes = [
        {"id": "c", "routine": "vec/const@1", "params": {"value": 7}},
        {"id": "e", "routine": "vec/echo@1", "in": {"in": "c"}},
        {"id": "p", "routine": "vec/pack@1", "in": {"a0": "c"}},
        {"id": "t", "routine": "vec/two@1", "params": {"a": 1, "b": "x"}},
        {"id": "s", "routine": "vec/scrub@1", "in": {"in": "c"}},
        {"id": "x", "routine": "vec/fail@1", "params": {"code": "t/x", "message": "said", "retryable": False}, "retry": {"maxAttempts": 3}},
        {"id": "fl", "routine": "vec/flaky@1", "params": {"value": 5, "succeed_on": 2}, "retry": {"maxAttempts": 2}},
        {"id": "fm", "routine": "vec/flaky@1", "params": {"value": 5, "succeed_on": 3}, "retry": {"maxAttempts": 2}},
        {"id": "fi", "routine": "vec/failif@1", "params": {"when": 7, "code": "t/y"}, "in": {"in": "c"}},
        {"id": "fo", "routine": "vec/failif@1", "params": {"when": 8, "code": "t/y"}, "in": {"in": "c"}},
        {"id": "d", "routine": "vec/deep@1", "params": {"n": 2}},
    ]
    g = _graph(nodes, {n["id"]: n["id"] for n in nodes}, None, stock_registry())
    each = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("execution_id"), F.lit(None).cast("string").alias("facts"))
    return execute_all(g, each).groupBy("key", "outcome", "attempts", "output", "error_code", "error_message").agg(F.count(F.lit(1)).alias("n"))


# Migration.


def _numbered(reg: Registry) -> Graph:
    """A graph whose invoked child has a node named 3, beside a fan-out."""
    reg.graphs["q/child@1"] = ({"name": "child", "renames": {"old": "3"}, "inputs": {"x": {}}, "nodes": [{"id": "3", "routine": "vec/echo@1", "in": {"in": "$input.x"}}], "exports": [{"name": "out", "from": "3"}]}, None)
    nodes = [{"id": "i", "species": "invoke", "graph": "q/child@1", "in": {"x": "$input.p"}}, {"id": "m", "routine": "vec/echo@1", "in": {"in": "$input.p[*]"}}]
    return _graph(nodes, {"a": "i", "b": "m"}, _PRICE, reg)


_NUMBERED = "('i/3', 'carry', 'i/3', 'i/3'), ('i/old', 'rename', 'i/3', 'i/3'), ('i/4', 'orphan', NULL, NULL), ('m/0', 'carry', 'm/0', 'm/0'), ('m/12', 'carry', 'm/12', 'm/12'), ('m/x', 'orphan', NULL, NULL), ('m/1/y', 'orphan', NULL, NULL), ('i/$in/x', 'caller', 'i/$in/x', 'i/$in/x')"


def _numbered_facts(spark, sf_dir, g: Graph) -> DataFrame:
    of = {"i": g.nodes["i"].child.derivations["3"], "m": g.derivations["m"]}
    keys = ["i/3", "i/old", "i/4", "m/0", "m/12", "m/x", "m/1/y", "i/$in/x"]
    facts = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(of[k[0]]).alias("derivation"), F.lit(k).alias("node")) for k in keys])
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.explode(facts).alias("f")).select("execution_id", "f.*")


@_query("migrate_positions", f"SELECT o_orderkey AS execution_id, key, classification, new_key FROM orders, (VALUES {_NUMBERED}) t(key, classification, new_key, node)")
def migrate_positions(spark, sf_dir):
    """Below a fan-out a number is an index, in an invoked graph it is a name; renames of a child apply in the child."""
    g = _numbered(stock_registry())
    return classify(_numbered_facts(spark, sf_dir, g), g).select("execution_id", "key", "classification", "new_key")


@_query("migrate_carry", f"SELECT o_orderkey AS execution_id, new_key AS key, node FROM orders, (VALUES {_NUMBERED}) t(key, classification, new_key, node) WHERE new_key IS NOT NULL")
def migrate_carry(spark, sf_dir):
    """The facts that survive, with their provenance under the new names."""
    g = _numbered(stock_registry())
    return migrate(_numbered_facts(spark, sf_dir, g), g).select("execution_id", "key", "node")


# Compilation.

_C, _E = {"id": "c", "routine": "vec/const@1", "params": {"value": 1}}, {"id": "e", "routine": "vec/echo@1", "in": {"in": "c"}}


def _odd_specs() -> dict[str, dict]:
    """For each diagnostic a spec that has it."""
    spec = lambda nodes, exports=(("o", "e"),), **more: {"name": "g", "nodes": nodes, "exports": [{"name": a, "from": b} for a, b in exports], **more}
    rule = lambda when, default="lo", route="hi": {"id": "d", "species": "decision", "rules": [{"route": route, "when": when}], "default": default, "in": {"x": "c"}}
    decides = lambda when, **more: spec([_C, rule(when, **more)], (("o", "d"),))
    many = lambda n: {"kind": "all", "of": [{"kind": "compare", "path": ["x"], "op": "eq", "value": k} for k in range(n)]}
    return {
        "E_SCHEMA": spec([_C | {"odd": 1}, _E]),
        "E_IDENT": spec([_C, _E], name="G!"),
        "E_NODE_DUP": spec([_C, _C, _E]),
        "E_EXPORT_DUP": spec([_C, _E], (("o", "e"), ("o", "c"))),
        "E_REF_UNKNOWN": spec([_C, _E | {"routine": "no/such@1"}]),
        "E_DECISION_ROUTE_DUP": decides({"expr": "x > 1"}, default="hi"),
        "E_ENDPOINT_PARSE": spec([_C, _E | {"in": {"in": "c..x"}}]),
        "E_EDGE_UNKNOWN_NODE": spec([_C, _E | {"in": {"in": "zz"}}], (("o", "e"), ("p", "c"))),
        "E_EDGE_UNKNOWN_PORT": spec([{"id": "t", "routine": "vec/two@1"}, _E | {"in": {"in": "t.zz"}}]),
        "E_EDGE_UNKNOWN_INPUT": spec([_C, _E | {"in": {"in": "c", "zz": "c"}}]),
        "E_INPUT_UNDECLARED": spec([_E | {"in": {"in": "$input.q"}}]),
        "E_ORDER_PATH": spec([_C, _E | {"needs": ["c.x"]}]),
        "E_GATE_UNKNOWN_ROUTE": spec([_C, rule({"expr": "x > 1"}), _E | {"needs": ["d.route.zz"]}], (("o", "e"), ("p", "d"))),
        "E_DUP_BINDING": spec([_C, _E | {"in": {"in": ["c", "c"]}}]),
        "E_JOIN_INVALID": spec([_C, _E | {"joins": {"zz": "all"}}]),
        "E_SHAPE_MISMATCH": spec([{"id": "c", "routine": "t/str@1"}, {"id": "e", "routine": "t/num@1", "in": {"in": "c"}}]),
        "E_CYCLE": spec([{"id": "c", "routine": "vec/echo@1", "in": {"in": "e"}}, _E]),
        "E_UNREACHABLE": spec([_C, _E, {"id": "u", "routine": "vec/pack@1"}]),
        "E_EXPORT_UNKNOWN": spec([_C, _E], (("o", "e"), ("p", "zz"))),
        "E_PARAM_UNDECLARED": spec([_C, _E | {"params": {"in": 2}, "in": {}}], (("o", "e"), ("p", "c"))),
        "E_PARAM_INPUT_COLLISION": spec([_C, {"id": "e", "routine": "vec/const@1", "params": {"value": 2}, "in": {"value": "c"}}]),
        "E_INPUT_UNBOUND": spec([{"id": "e", "routine": "vec/echo@1"}]),
        "E_FANOUT_BIND": spec([_C, {"id": "e", "routine": "t/pair@1", "in": {"a": "c[*]", "b": "c"}}]),
        "E_PRED_PARSE": decides({"expr": "x >"}),
        "E_PRED_COMPUTES": decides({"expr": "x + x == 1"}),
        "E_PRED_REF": decides({"expr": "y == 1"}),
        "E_PRED_TOO_COMPLEX": decides(many(16)),
        "E_MATCH_INVALID": decides({"kind": "compare", "path": ["x"], "op": "lt", "value": True}),
        "E_SENS_NO_SUBJECT": spec([_C, {"id": "e", "routine": "vec/sense@1", "in": {"in": "c"}}]),
        "E_SENS_LEAK": spec([_C, _E], distribution="client"),
        "L_INPUT_UNUSED": spec([_C, _E], inputs={"q": {}}),
        "L_RULE_SHADOWED": spec([_C, {"id": "d", "species": "decision", "rules": [{"route": "a", "when": {"expr": "x > 1"}}, {"route": "b", "when": {"expr": "x > 2"}}], "default": "z", "in": {"x": "c"}}], (("o", "d"),)),
        "none": decides(many(15)),  # 2 and 4 for each comparison: 62 of 64
    }


_DIAGNOSED = """('E_SCHEMA', 'node:c'), ('E_IDENT', 'graph'), ('E_NODE_DUP', 'node:c'), ('E_EXPORT_DUP', 'export:o'), ('E_REF_UNKNOWN', 'node:e'), ('E_DECISION_ROUTE_DUP', 'node:d'), ('E_ENDPOINT_PARSE', 'edge:d:e:in:0'),
    ('E_EDGE_UNKNOWN_NODE', 'edge:d:e:in:0'), ('E_EDGE_UNKNOWN_PORT', 'edge:d:e:in:0'), ('E_EDGE_UNKNOWN_INPUT', 'edge:d:e:zz:0'), ('E_INPUT_UNDECLARED', 'edge:d:e:in:0'), ('E_ORDER_PATH', 'edge:o:e:0'),
    ('E_GATE_UNKNOWN_ROUTE', 'edge:o:e:0'), ('E_DUP_BINDING', 'node:e/input:in'), ('E_JOIN_INVALID', 'node:e/input:zz'), ('E_SHAPE_MISMATCH', 'node:e/input:in'), ('E_CYCLE', 'graph'), ('E_UNREACHABLE', 'node:u'),
    ('E_EXPORT_UNKNOWN', 'export:p'), ('E_PARAM_UNDECLARED', 'node:e/param:in'), ('E_PARAM_INPUT_COLLISION', 'node:e/param:value'), ('E_INPUT_UNBOUND', 'node:e/input:in'), ('E_FANOUT_BIND', 'node:e'),
    ('E_PRED_PARSE', 'node:d/rule:0'), ('E_PRED_COMPUTES', 'node:d/rule:0'), ('E_PRED_REF', 'node:d/rule:0'), ('E_PRED_TOO_COMPLEX', 'node:d/rule:0'), ('E_MATCH_INVALID', 'node:d/rule:0'), ('E_SENS_NO_SUBJECT', 'graph'),
    ('E_SENS_LEAK', 'graph'), ('L_INPUT_UNUSED', 'input:q'), ('L_RULE_SHADOWED', 'node:d/rule:1')"""


@_query("diagnostics", f"SELECT code AS spec, code, CASE WHEN code LIKE 'E%' THEN 'error' ELSE 'lint' END AS severity, address FROM (VALUES {_DIAGNOSED}) t(code, address)")
def diagnostics(spark, sf_dir):
    """Every diagnostic, of the spec that is made to have it; the spec named none has none at all."""
    reg = stock_registry()
    port = lambda kind: [{"port": "value", "shape": {"kind": kind}}]
    reg.routines |= {"t/str@1": contract([], port("string"), "pure"), "t/num@1": contract([{"name": "in", "shape": {"kind": "number"}}], port("any"), "pure"), "t/pair@1": contract([{"name": "a"}, {"name": "b"}], port("any"), "pure")}
    found = diagnostics_frame(spark, _odd_specs(), reg)
    return found.filter("code = spec or spec = 'none'").select("spec", "code", "severity", "address").distinct()


@_query("canonical_edges", "SELECT * FROM (VALUES ('sugar', 'd:e:in:0', 'data', 'c', 'e.in', true), ('sugar', 'd:m:in:0', 'data', 'e', 'm.in', true), ('sugar', 'o:m:0', 'order', 'c', 'm', true), ('plain', 'd:e:in:0', 'data', 'c', 'e.in', true), ('plain', 'd:m:in:0', 'data', 'e', 'm.in', true), ('plain', 'o:m:0', 'order', 'c', 'm', true)) t(written, id, kind, source, target, same_hash)")
def canonical_edges(spark, sf_dir):
    """A graph written with sugar and one written out have one canonical form and one hash."""
    exports = [{"name": "o", "from": "m"}]
    forms = {
        "sugar": {"name": "g", "nodes": [{"id": "m", "routine": "vec/echo@1", "in": {"in": "e[*]"}, "needs": ["c"]}, _E, _C], "exports": exports},
        "plain": {"name": "g", "nodes": [_C, {"id": "e", "species": "routine", "routine": "vec/echo@1"}, {"id": "m", "species": "map", "body": "vec/echo@1", "over": "in"}], "exports": exports, "edges": [{"kind": "order", "from": "c", "to": "m"}, {"kind": "data", "from": "e", "to": "m.in"}, {"kind": "data", "from": "c", "to": "e.in"}]},
    }
    graphs = {k: compile_graph(x, stock_registry()) for k, x in forms.items()}
    same = len({g.hash for g in graphs.values()}) == 1
    return spark.createDataFrame([(k, e["id"], e["kind"], e["from"], e["to"], same) for k, g in graphs.items() for e in g.spec["edges"]], "written string, id string, kind string, source string, target string, same_hash boolean")


_SQL_LITERAL = lambda x: _SQL_STRING(f"'{x}'")
_SQL_MAP = lambda **h: "sha256(unhex('07') || " + _sql_u64(str(len(h))) + "".join(f" || unhex({_SQL_LITERAL(k)}) || unhex({h[k]})" for k in sorted(h)) + ")"
_SQL_SEVEN = "sha256(unhex('0300' || '0000000000000001' || '07'))"
_SQL_CONST = _SQL_MAP(inputs=_SQL_MAP(), species=_SQL_LITERAL("routine"), routine=_SQL_LITERAL("vec/const@1"), params=_SQL_MAP(value=_SQL_SEVEN))


@_query("derivation_hash", f"SELECT 'c' AS node, {_SQL_CONST} AS derivation")
def derivation_hash(spark, sf_dir):
    """The hash of a node's recipe, put together again from hashes of its parts."""
    return spark.createDataFrame([("c", _echo_graph().derivations["c"])], "node string, derivation string")


@_query("sensitivity_classes", "SELECT * FROM (VALUES ('input', 'who', 'internal'), ('node', 's', 'pii'), ('node', 'e', 'pii'), ('node', 'x', 'public'), ('export', 'a', 'pii'), ('export', 'b', 'public')) t(kind, name, class)")
def sensitivity_classes(spark, sf_dir):
    nodes = [{"id": "s", "routine": "vec/sense@1", "in": {"in": "$input.who"}}, {"id": "e", "routine": "vec/echo@1", "in": {"in": "s"}}, {"id": "x", "routine": "vec/scrub@1", "in": {"in": "e"}}]
    return classes_frame(spark, _graph(nodes, {"a": "e", "b": "x"}, {"who": {"subject": True}}, stock_registry()))


@_query("generated_graphs", "SELECT * FROM (VALUES (6, 1), (8, 1), (11, 2), (14, 1), (17, 1), (18, 1), (21, 1), (26, 1), (39, 1)) t(seed, failing)")
def generated_graphs(spark, sf_dir):
    """The seeds up to 39 whose graphs have a failing node; all of them compile."""
    rows = [(s, sum("fail" in n.ref for n in compile_graph(generate(s), stock_registry()).nodes.values())) for s in range(1, 40)]
    return spark.createDataFrame(rows, "seed int, failing int").filter("failing > 0")


@_query("splitmix64", "SELECT n_nationkey AS seed, c::VARCHAR AS first FROM (SELECT n_nationkey, xor(b, b >> 31) AS c FROM (SELECT n_nationkey, (xor(a, a >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS b FROM (SELECT n_nationkey, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM (SELECT n_nationkey, (n_nationkey::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM nation))))")
def splitmix64(spark, sf_dir):
    """The first draw of the generator's source of numbers for each nation's key as a seed."""
    first = F.udf(lambda seed: str(SplitMix64(seed).next()), "string")
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seed"), first("n_nationkey").alias("first"))
