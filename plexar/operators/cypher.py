"""A graph query language subset over ``Graph``: a tokenizer, a parser, and one DataFrame plan.

MATCH (a:Label)-[r:TYPE]->(b:Label)<-[:TYPE*1..3]-(c:Label) WHERE a.x = 1 AND b.y <> 'z'
RETURN [DISTINCT] a, b.title AS t ORDER BY distance(b.v, [0.1, 0.2], 'l2') | a.x [DESC] LIMIT n
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexar.functions.vector import distance, metric_name
from plexar.operators import acl
from plexar.operators.graph import Graph
from plexar.operators.graph_algo import Rounds

TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\.\.\w)|(?P<name>\w+)|(?P<op><>|<=|>=|->|<-|\.\.|[()\[\]:,.*=<>{}|-]))""")
COMPARE = {"=", "<>", "<", "<=", ">", ">="}


@dataclass
class Node:
    var: str
    label: str | None


@dataclass
class Rel:
    var: str | None
    kind: str | None
    forward: bool
    low: int = 1
    high: int | None = 1


@dataclass
class Query:
    nodes: list[Node] = field(default_factory=list)
    rels: list[Rel] = field(default_factory=list)
    filters: list[tuple[str, str, str, object]] = field(default_factory=list)
    returns: list[tuple[str, str | None, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip().rstrip(";")
        while at < len(text.rstrip()):
            # a range such as 1..3 is two numbers
            m = re.compile(r"\s*(?P<num>\d+)(?=\.\.)").match(text, at) or TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query at: {text[at:at + 20]!r}")
            kind = m.lastgroup or ""
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at, self.fresh = 0, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else ""

    def take(self, *want: str) -> str:
        got = self.peek()
        if not got or (want and got.upper() not in want):
            raise ValueError(f"expected {' or '.join(want) or 'more'}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def maybe(self, want: str) -> bool:
        if self.peek().upper() == want:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise ValueError(f"expected a name, found {self.peek() or 'the end'!r}")
        return self.take()

    def literal(self) -> object:
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "str":
            self.at += 1
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if kind == "num":
            self.at += 1
            return float(t) if re.search(r"[.eE]", t) else int(t)
        if t.lower() in ("true", "false", "null"):
            self.at += 1
            return {"true": True, "false": False, "null": None}[t.lower()]
        raise ValueError(f"expected a value, found {t or 'the end'!r}")

    def node(self) -> Node:
        self.take("(")
        if self.peek() in (":", ")"):
            self.fresh += 1
            var = f"_n{self.fresh}"
        else:
            var = self.name()
        label = self.name() if self.maybe(":") else None
        self.take(")")
        return Node(var, label)

    def rel(self) -> Rel:
        back = self.take("-", "<-") == "<-"
        r = Rel(None, None, not back)
        if self.maybe("["):
            if self.peek() not in (":", "]", "*"):
                r.var = self.name()
                if self.peek() == "]":  # a bare name is the type
                    r.var, r.kind = None, r.var
            if self.maybe(":"):
                r.kind = self.name()
            if self.maybe("*"):
                r.low, r.high = 1, None
                if self.peek().isdigit():
                    r.low = r.high = int(self.take())
                if self.maybe(".."):
                    r.high = int(self.take()) if self.peek().isdigit() else None
                if r.high is not None and not 1 <= r.low <= r.high:
                    raise ValueError(f"no path has a length of {r.low} to {r.high}")
            self.take("]")
        if back:
            self.take("-")
        else:
            self.take("->")
        return r

    def parse(self) -> Query:
        q = Query()
        self.take("MATCH")
        q.nodes.append(self.node())
        while self.peek() in ("-", "<-"):
            q.rels.append(self.rel())
            q.nodes.append(self.node())
        if self.maybe("WHERE"):
            while True:
                var = self.name()
                self.take(".")
                key, op = self.name(), self.take()
                if op not in COMPARE:
                    raise ValueError(f"unknown comparison: {op}")
                q.filters.append((var, key, op, self.literal()))
                if not self.maybe("AND"):
                    break
        if self.maybe("RETURN"):
            q.distinct = self.maybe("DISTINCT")
            while True:
                var = self.name()
                key = self.name() if self.maybe(".") else None
                alias = self.name() if self.maybe("AS") else (f"{var}.{key}" if key else var)
                q.returns.append((var, key, alias))
                if not self.maybe(","):
                    break
        if self.maybe("ORDER"):
            self.take("BY")
            while True:
                q.order.append((self.key(), not self.maybe("DESC") and (self.maybe("ASC") or True)))
                if not self.maybe(","):
                    break
        if self.maybe("LIMIT"):
            q.limit = int(self.take())
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r}")
        if not q.returns:
            q.returns = [(n.var, None, n.var) for n in q.nodes if not n.var.startswith("_")]
        known = {n.var for n in q.nodes} | {r.var for r in q.rels if r.var}
        for v in [f[0] for f in q.filters] + [r[0] for r in q.returns]:
            if v not in known:
                raise ValueError(f"unknown variable: {v}")
        return q

    def key(self) -> object:
        if self.word() == "DISTANCE":
            self.take()
            self.take("(")
            var = self.name()
            self.take(".")
            col = self.name()
            self.take(",")
            self.take("[")
            values = [float(self.literal())]  # type: ignore[arg-type]
            while self.maybe(","):
                values.append(float(self.literal()))  # type: ignore[arg-type]
            self.take("]")
            metric = str(self.literal()) if self.maybe(",") else "l2"
            self.take(")")
            return ("distance", var, col, values, metric_name(metric))
        var = self.name()
        return ("column", var, self.name() if self.maybe(".") else None)


def parse(text: str) -> Query:
    return Parser(text).parse()


def _compare(c: Column, op: str, v: object) -> Column:
    if v is None:
        return c.isNull() if op == "=" else c.isNotNull()
    return {"=": c == v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def run(graph: Graph, text: str, user: str | None = None, grants: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """The query's rows. A returned variable is a struct of its row; ``distance`` is added where rows are ordered by one.

    Filters apply to their own node before any join; hops are equi-joins through the edges, variable lengths a union of
    chains from the nodes reached so far. A chain takes no edge twice, so that one without an upper bound ends: it is
    written round by round until no chain grows. Missing vectors sort last. With a user, both ends of every hop must be readable, those within a variable
    length too.
    """
    q = parse(text)
    if any(n.label is None for n in q.nodes):
        raise ValueError("every node needs a label")

    def side(n: Node) -> DataFrame:
        if n.label not in graph.tables:
            raise ValueError(f"unknown label: {n.label}")
        df, key = graph.tables[n.label], graph.keys[n.label]
        if user is not None:
            df = acl.readable(df, n.label, grants, roles, user, key=key)
        for var, col, op, v in q.filters:
            if var == n.var:
                df = df.where(_compare(F.col(col), op, v))
        return df.select(F.col(key).cast("long").alias(f"{n.var}__id"), F.struct("*").alias(n.var))

    def open_to_user(e: DataFrame) -> DataFrame:
        """Edges between readable rows."""
        for end in ("src", "dst"):
            parts = [acl.readable(df, label, grants, roles, user, key=graph.keys[label]).select(F.lit(label).alias("__ot"), F.col(graph.keys[label]).cast("long").alias("__oi")) for label, df in graph.tables.items()]
            e = e.join(functools.reduce(DataFrame.unionByName, parts), (F.col(f"{end}_table") == F.col("__ot")) & (F.col(f"{end}_id") == F.col("__oi")), "left_semi")
        return e

    out = side(q.nodes[0])
    for r, a, b in zip(q.rels, q.nodes, q.nodes[1:]):
        e = graph.edges if r.kind is None else graph.edges.where(F.col("rel_type") == r.kind)
        many = r.high is None or r.high > 1
        if user is not None and many:
            e = open_to_user(e)
        if r.var:
            for var, col, op, v in q.filters:
                if var == r.var:
                    e = e.where(_compare(F.col(col) if col in e.columns else F.col("props")[col], op, v))
        e = e if r.forward else e.select("edge_id", F.col("dst_table").alias("src_table"), F.col("dst_id").alias("src_id"), "rel_type", F.col("src_table").alias("dst_table"), F.col("src_id").alias("dst_id"), "props")
        hop = e.select(*[F.col(c).alias(f"__{c}") for c in ("src_table", "src_id", "dst_table", "dst_id")], F.struct("edge_id", "rel_type", "props").alias(r.var or "__rel"))
        step, chain, n = None, hop, 1
        if many:
            edge = F.struct("__rel_id", *[f"__{c}" for c in ("src_table", "src_id", "dst_table", "dst_id")])
            hop = hop.withColumn("__rel_id", F.struct(f"{r.var or '__rel'}.edge_id", f"{r.var or '__rel'}.rel_type")).withColumn("__edge", edge).drop("__rel_id")
            starts = out.select(F.col(f"{a.var}__id").alias("__start"))
            chain = hop.where(F.col("__src_table") == a.label).join(starts, F.col("__src_id") == F.col("__start"), "left_semi")
            chain = chain.withColumn("__path", F.array("__edge")).drop("__edge")
        while True:
            if n >= r.low:
                step = chain if step is None else step.unionByName(chain)
            if n == r.high:
                break
            nxt = hop.select(F.col("__src_table").alias("__t"), F.col("__src_id").alias("__i"), F.col("__dst_table").alias("__nt"), F.col("__dst_id").alias("__ni"), "__edge")
            goes_on = (F.col("__dst_table") == F.col("__t")) & (F.col("__dst_id") == F.col("__i")) & ~F.array_contains("__path", F.col("__edge"))
            chain = chain.join(nxt, goes_on).select(
                "__src_table", "__src_id", F.col("__nt").alias("__dst_table"), F.col("__ni").alias("__dst_id"), r.var or "__rel", F.concat("__path", F.array("__edge")).alias("__path"))
            n += 1
            if r.high is None:
                chain = Rounds(graph.spark).save(chain, f"paths-{n}")
                if chain.isEmpty():
                    step = chain if step is None else step
                    break
        step = step.where((F.col("__src_table") == a.label) & (F.col("__dst_table") == b.label))
        again = f"{b.var}__id" in out.columns  # a variable that was bound before closes a ring
        out = out.join(step, F.col(f"{a.var}__id") == F.col("__src_id"))
        if again:
            out = out.where(F.col(f"{b.var}__id") == F.col("__dst_id"))
        else:
            out = out.join(side(b), F.col("__dst_id") == F.col(f"{b.var}__id"))
        out = out.drop("__src_table", "__src_id", "__dst_table", "__dst_id", "__rel", "__path")

    cols = [(F.col(f"{v}.{k}") if k else F.col(v)).alias(alias) for v, k, alias in q.returns]
    order, extra = [], []
    for i, (key, up) in enumerate(q.order):
        if key[0] == "distance":
            c = distance(f"{key[1]}.{key[2]}", key[3], key[4], safe=True)
            name = "distance" if "distance" not in [r[2] for r in q.returns] else f"__order{i}"
            extra.append(c.alias(name))
        else:
            name = f"__order{i}"
            extra.append((F.col(f"{key[1]}.{key[2]}") if key[2] else F.col(key[1])).alias(name))
        order.append(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last())
    ids = [c for c in out.columns if c.endswith("__id")]
    if q.distinct:
        out = out.select(*cols, *extra).distinct()
        out = out.orderBy(*order) if order else out
    elif order:
        out = out.select(*cols, *extra, *ids).orderBy(*order, *ids)  # equal keys by node ids
    else:
        out = out.select(*cols, *ids)
    out = out.limit(q.limit) if q.limit is not None else out
    return out.drop(*ids, *[f"__order{i}" for i in range(len(q.order))])
