"""Policy graphs as rows: questions to a policy's graph answered in one Arrow pass.

The operators of ``graph``, ``kgraph`` and ``analyses`` state each step as joins over (policy, node), so a
policy of any size is spread over all tasks, but every round of a closure is written to disk, many times the
edges' own size. Here the edges of a policy are brought together once, and closure, types and flows never leave
its row. That holds for policies of up to ``MOST`` rows; larger ones go through the joins. Both forms give the
same rows; the tests compare them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clauseweave.operators import graph as G
from clauseweave.operators.hierarchy import clean_term
from clauseweave.plans.session import cut

MOST = 1000  # rows of a policy that is one row here: its closure has at most 2^20 pairs
CHUNK = 50_000  # rows of a result batch
COLLECT_LIKE = frozenset(G.POSITIVE + G.NEGATIVE)
VAGUE = re.compile(r" (information|data|details)\Z")  # without the line ends before which $ matches, too
CLASS = re.compile(r"([a-z]+)\Z")

Edge = tuple[str, str, str]


class Policy:
    """One policy's graph: edges (src, dst, key) with the labels of their purposes."""

    def __init__(self, edges: dict[Edge, set[str]]) -> None:
        self.labels = edges
        self.collects = [e for e in edges if e[2] in COLLECT_LIKE]
        self.positive = [e for e in self.collects if not e[2].startswith("NOT_")]
        self.nodes = {x for e in edges for x in e[:2]}
        self.under: dict[str, list[str]] = {}
        for s, d, k in edges:
            if k == "SUBSUM":
                self.under.setdefault(s, []).append(d)
        self._down: dict[str, dict[str, int]] = {}

    def down(self, node: str) -> dict[str, int]:
        """Node -> distance of all that ``node`` subsumes, itself at 0."""
        if node not in self._down:
            found, now = {node: 0}, [node]
            while now:
                at, now = now, []
                for x in at:
                    for y in self.under.get(x, ()):
                        if y not in found:
                            found[y] = found[x] + 1
                            now.append(y)
            self._down[node] = found
        return self._down[node]

    @cached_property
    def actors(self) -> set[str]:
        """Sources of collect-like edges and what SUBSUM ties to them; all other nodes are data."""
        ties: dict[str, list[str]] = {}
        for s, ds in self.under.items():
            for d in ds:
                ties.setdefault(s, []).append(d)
                ties.setdefault(d, []).append(s)
        found = {s for s, _, _ in self.collects}
        todo = list(found)
        while todo:
            for y in ties.get(todo.pop(), ()):
                if y not in found:
                    found.add(y)
                    todo.append(y)
        return found

    def covered(self, edges: Iterable[Edge]) -> set[tuple[str, str]]:
        """(entity, datatype) that ``edges`` cover: actors below their sources with data below their targets."""
        out: set[tuple[str, str]] = set()
        for s, d in {e[:2] for e in edges}:
            data = [x for x in self.down(d) if x not in self.actors]
            if data:
                out.update((e, x) for e in self.down(s) if e in self.actors for x in data)
        return out

    def who_collect(self) -> set[tuple[str, str]]:
        return self.covered(self.positive)

    def cannot_collect(self) -> set[tuple[str, str]]:
        return self.covered(e for e in self.collects if e[2].startswith("NOT_"))

    def validate_collection(self) -> set[tuple[str]]:
        return {(x,) for _, x in self.who_collect()}

    def subsum_pairs(self) -> Iterator[tuple[str, str, str, int]]:
        """(type, wide, narrow, dist) of nodes of one type, reflexive."""
        for wide in self.nodes:
            actor = wide in self.actors
            for narrow, dist in self.down(wide).items():
                if (narrow in self.actors) == actor:
                    yield "ACTOR" if actor else "DATA", wide, narrow, dist

    def purposes(self) -> Iterator[tuple[str, str, str]]:
        """(entity, datatype, label): purposes of the edges on all shortest ways from entity to datatype."""
        best: dict[tuple[str, str], tuple[int, set[str]]] = {}
        for edge in self.positive:
            data = [(x, n) for x, n in self.down(edge[1]).items() if x not in self.actors]
            for e, m in self.down(edge[0]).items() if data else ():
                if e in self.actors:
                    for x, n in data:
                        old = best.get((e, x))
                        if old is None or m + n < old[0]:
                            best[e, x] = (m + n, set(self.labels[edge]))
                        elif m + n == old[0]:
                            old[1].update(self.labels[edge])
        return ((e, x, label) for (e, x), (_, labels) in best.items() for label in labels)

    def consistency(self) -> Iterator[tuple[str, str, str, str]]:
        """(entity, datatype, collection_consistency, entity_consistency); see ``analyses.consistency``."""
        probes = {("we", d) for _, d, _ in self.collects} | {("trusted partner", d) for ds in self.under.values() for d in ds if d not in self.actors}
        direct, said = {e[:2] for e in self.positive}, self.who_collect()
        named, covered = {d for _, d in direct}, {d for _, d in said}
        for e, d in probes:
            own = "clear" if (e, d) in direct else "vague" if (e, d) in said or ("third party", d) in said else "omitted"
            yield e, d, "clear" if d in named else "vague" if d in covered else "omitted", own

    def generic_term(self) -> list[tuple[str]]:
        """The first data term over terms of several classes, the last words, that a third party collects."""
        third = {d for e, d in self.who_collect() if e not in ("we", "us")}
        wide = [x for x in third if len({_class(y) for y in self._under(x)}) > 1]
        return [(min(wide),)] if wide else []

    def _under(self, node: str) -> set[str]:
        """All that a way of at least one edge leads to, ``node`` too if it lies on a loop."""
        return {y for x in self.under.get(node, ()) for y in self.down(x)}

    def accept_unspecific(self) -> set[Edge]:
        """The collect-like edges, those to a vague term also to each data type."""
        data = self.nodes - self.actors
        return {*self.collects, *((s, x, k) for s, d, k in self.collects if VAGUE.search(d) for x in data)}


def _class(term: str) -> str:
    found = CLASS.search(term)
    return found[1] if found else ""


def _graphs(batch: pa.RecordBatch) -> Iterator[tuple[str, Policy]]:
    """The policies of a batch (policy_id, e: list of (src, dst, key[, labels]))."""
    lists = batch.column(1)
    ends = lists.offsets.to_pylist()
    flat = lists.values
    src, dst, key = (flat.field(i).to_pylist() for i in range(3))
    labels = flat.field(3).to_pylist() if flat.type.num_fields > 3 else None
    for k, policy in enumerate(batch.column(0).to_pylist()):
        edges: dict[Edge, set[str]] = {}
        for i in range(ends[k], ends[k + 1]):
            said = edges.setdefault((src[i], dst[i], key[i]), set())
            if labels and labels[i]:
                said.update(labels[i])
        yield policy, Policy(edges)


def answers(kg: DataFrame, ask: Callable[[Policy], Iterable[tuple]], columns: str, joined: Callable[[DataFrame], DataFrame], labels: bool = False) -> DataFrame:
    """(policy_id, columns): what ``ask`` tells of each policy of ``kg``, a table like kg_edges.

    ``ask`` gives each row once. ``joined`` gives the same rows from a table like kg_edges; it is asked for
    the policies of more than ``MOST`` rows. With ``labels`` edges carry the labels of their purposes.
    """
    kg = kg.where("policy_id is not null")
    rows = kg.groupBy("policy_id").agg(F.count("*").alias("n"))
    if (rows.agg(F.max("n")).first()[0] or 0) <= MOST:
        return _pass(kg, ask, columns, labels)
    large = cut(rows.where(F.col("n") > MOST).select("policy_id"))
    small = _pass(kg.join(large, "policy_id", "left_anti"), ask, columns, labels)
    return small.unionByName(joined(kg.join(large, "policy_id", "left_semi")).select(*small.columns))


def _pass(kg: DataFrame, ask: Callable[[Policy], Iterable[tuple]], columns: str, labels: bool) -> DataFrame:
    names = ["policy_id", *(c.split()[0] for c in columns.split(", "))]
    kinds = [pa.string(), *({"string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for policy, graph in _graphs(b):
                out += [(policy, *r) for r in ask(graph)]
                if len(out) >= CHUNK:
                    yield _batch(out, names, kinds)
                    out = []
        if out:
            yield _batch(out, names, kinds)

    said = [F.transform(F.filter(F.map_entries("purposes"), lambda m: F.size(m["value"]) > 0), lambda m: m["key"]).alias("labels")] if labels else []
    e = kg.select("policy_id", clean_term(F.col("source")).alias("src"), clean_term(F.col("target")).alias("dst"), F.upper(clean_term(F.col("key"))).alias("key"), *said)
    e = e.dropna(subset=["src", "dst", "key"])
    one = e.groupBy("policy_id").agg(F.collect_list(F.struct(*e.columns[1:])).alias("e"))
    return one.mapInArrow(run, "policy_id string, " + columns)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
