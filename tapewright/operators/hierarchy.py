"""Parent-child rows to full hierarchies: cycles, paths, depths, roots and descendants.

Method: connected components are found, each component is co-located, and an iterative depth-first
traversal with node colouring walks it; a back edge (into a grey node) closes a cycle, and low-links over
the back edges give each cycle's members. A component of more than `max_edges` edges is more than one task may
hold: its nodes are coloured by rounds over its edges instead (`coloured`) and its paths grow level by level, with
the same rows. Cycles are sought only among edges that are left once nodes without parents or without children are
peeled off, so most of a hierarchy never reaches the traversal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.text_keys import hash_key
from tapewright.operators import graph
from tapewright.operators.components import connected_components, node_id
from tapewright.runtime import cut

#: Relations that make parent_hash a parent of child_hash (fixed values of the data model).
HIERARCHY_RELATIONS = ("feeds", "derives", "produces")
#: Most edges of a component that one task may hold (about 150 MB in a Python worker).
MAX_EDGES = 400_000
_EMIT = 20_000

CYCLE_SCHEMA = "artifact_hash string, cycle_hash string"
PATH_SCHEMA = "artifact_hash string, root_hash string, depth int, max_depth int, n_paths double, path array<string>"
CLOSURE_SCHEMA = "artifact_hash string, descendant_hash string, distance int"
REACH_SCHEMA = "start string, node string, distance int, path array<string>"


def hierarchy_edges(lineage: DataFrame) -> DataFrame:
    """Distinct (parent, child) of the hierarchy rows of `lineage`; null hashes or relations and mere references go."""
    return _hierarchy_rows(lineage).distinct()


def _hierarchy_rows(lineage: DataFrame) -> DataFrame:
    rel = F.lower(F.regexp_replace("relation", r"^\s+|\s+$", ""))
    named = lineage.where(rel.isin(*HIERARCHY_RELATIONS) & F.col("parent_hash").isNotNull() & F.col("child_hash").isNotNull())
    return named.select(hash_key("parent_hash").alias("parent"), hash_key("child_hash").alias("child"))


class _Graph:
    """One component in a task: nodes as numbers in order of their names."""

    def __init__(self, parents: list[str], children: list[str]):
        self.names = sorted({*parents, *children})
        number = {x: i for i, x in enumerate(self.names)}
        self.down: list[list[int]] = [[] for _ in self.names]
        for p, c in zip(parents, children):
            self.down[number[p]].append(number[c])
        self.cycle = self._cycles()

    def _cycles(self) -> list[int]:
        """For each node the smallest node of its cycle, or -1. Iterative, so depth is no limit."""
        n = len(self.names)
        white, grey = -1, 1
        seen, low, colour = [white] * n, [0] * n, [0] * n
        cycle, open_, clock = [-1] * n, [], 0
        for start in range(n):
            if seen[start] != white:
                continue
            stack = [(start, iter(self.down[start]))]
            seen[start] = low[start] = clock
            clock += 1
            colour[start] = grey
            open_.append(start)
            while stack:
                u, rest = stack[-1]
                for v in rest:
                    if seen[v] == white:
                        seen[v] = low[v] = clock
                        clock += 1
                        colour[v] = grey
                        open_.append(v)
                        stack.append((v, iter(self.down[v])))
                        break
                    if colour[v] == grey:  # back or cross edge into what is still open
                        low[u] = min(low[u], seen[v])
                else:
                    stack.pop()
                    if stack:
                        low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
                    if low[u] == seen[u]:
                        group = []
                        while True:
                            w = open_.pop()
                            colour[w] = 0
                            group.append(w)
                            if w == u:
                                break
                        if len(group) > 1 or u in self.down[u]:
                            least = min(group)
                            for w in group:
                                cycle[w] = least
        return cycle

    def condensed(self) -> tuple[list[list[int]], list[int]]:
        """Children and in-degrees once each cycle is one node, its smallest."""
        n = len(self.names)
        at = [c if c >= 0 else i for i, c in enumerate(self.cycle)]
        down = [set() for _ in range(n)]
        for u in range(n):
            for v in self.down[u]:
                if at[u] != at[v]:
                    down[at[u]].add(at[v])
        into = [0] * n
        for u in range(n):
            for v in down[u]:
                into[v] += 1
        return [sorted(x) for x in down], into

    def topological(self, down: list[list[int]], into: list[int]) -> list[int]:
        left, order = list(into), []
        ready = [u for u in range(len(down)) if not left[u] and self.cycle[u] in (-1, u)]
        while ready:
            u = ready.pop()
            order.append(u)
            for v in down[u]:
                left[v] -= 1
                if not left[v]:
                    ready.append(v)
        return order

    def cycles(self) -> Iterator[tuple]:
        for i, c in enumerate(self.cycle):
            if c >= 0:
                yield self.names[i], self.names[c]

    def paths(self) -> Iterator[tuple]:
        down, into = self.condensed()
        order = self.topological(down, into)
        place = {u: i for i, u in enumerate(order)}
        for root in sorted(u for u in order if not into[u]):
            reach, todo = {root}, [root]
            while todo:
                for v in down[todo.pop()]:
                    if v not in reach:
                        reach.add(v)
                        todo.append(v)
            best: dict[int, tuple[int, tuple]] = {root: (0, (root,))}
            most, ways = {root: 0}, {root: 1}
            for u in sorted(reach, key=place.__getitem__):
                d, path = best.pop(u)
                yield self.names[u], self.names[root], d, most[u], float(min(ways[u], 10**300)), [self.names[x] for x in path]
                for v in down[u]:
                    new = (d + 1, (*path, v))
                    if v not in best or new < best[v]:
                        best[v] = new
                    most[v] = max(most.get(v, 0), most[u] + 1)
                    ways[v] = ways.get(v, 0) + ways[u]

    def every_path(self) -> Iterator[tuple]:
        """Depth-first from each root; only the path walked is held, each step down is one row."""
        down, into = self.condensed()
        order = self.topological(down, into)
        place = {u: i for i, u in enumerate(order)}
        for root in sorted(u for u in order if not into[u]):
            reach, todo = {root}, [root]
            while todo:
                for v in down[todo.pop()]:
                    if v not in reach:
                        reach.add(v)
                        todo.append(v)
            most, ways = {root: 0}, {root: 1}
            for u in sorted(reach, key=place.__getitem__):
                for v in down[u]:
                    most[v] = max(most.get(v, 0), most[u] + 1)
                    ways[v] = ways.get(v, 0) + ways[u]
            path, stack = [self.names[root]], [iter(down[root])]
            yield path[0], path[0], 0, 0, 1.0, [*path]
            while stack:
                v = next(stack[-1], None)
                if v is None:
                    stack.pop()
                    path.pop()
                else:
                    path.append(self.names[v])
                    stack.append(iter(down[v]))
                    yield path[-1], path[0], len(path) - 1, most[v], float(min(ways[v], 10**300)), [*path]

    def from_roots(self) -> Iterator[tuple]:
        yield from self._breadth_first([sorted(x) for x in self.down])

    def from_roots_undirected(self) -> Iterator[tuple]:
        near: list[set[int]] = [set(x) for x in self.down]
        for u, x in enumerate(self.down):
            for v in x:
                near[v].add(u)
        yield from self._breadth_first([sorted(x) for x in near])

    def _breadth_first(self, near: list[list[int]]) -> Iterator[tuple]:
        """From each node without a parent; nodes are met in order of their paths, so the first way to a node is the smallest shortest."""
        for root in sorted({*range(len(near))} - {v for x in self.down for v in x}):
            before, edge, step = {root: -1}, [root], 0
            while edge:
                ahead = []
                for u in edge:
                    path, x = [], u
                    while x >= 0:
                        path.append(self.names[x])
                        x = before[x]
                    yield self.names[root], self.names[u], step, path[::-1]
                    for v in near[u]:
                        if v not in before:
                            before[v] = u
                            ahead.append(v)
                edge, step = ahead, step + 1

    def closure(self) -> Iterator[tuple]:
        for u in range(len(self.names)):
            far, edge, step = {}, [u], 0
            while edge:
                step, ahead = step + 1, []
                for x in edge:
                    for v in self.down[x]:
                        if v not in far:
                            far[v] = step
                            ahead.append(v)
                edge = ahead
            for v, d in far.items():
                yield self.names[u], self.names[v], d


def _per_component(what: str, columns: list[str]) -> Callable:
    """A mapInPandas function over partitions sorted by component; holds one component at a time."""

    def emit(parents: list[str], children: list[str]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        weight = 0
        for row in getattr(_Graph(parents, children), what)():
            held.append(row)
            weight += len(row[-1]) if isinstance(row[-1], list) else 1
            if weight >= _EMIT:
                yield pd.DataFrame(held, columns=columns)
                held, weight = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parents, children = None, [], []
        for b in batches:
            comp = b["component"].to_numpy()
            p, c = b["parent"].tolist(), b["child"].tolist()
            starts = [0, *(i for i in range(1, len(comp)) if comp[i] != comp[i - 1]), len(comp)]
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                if comp[i] != now:
                    if parents:
                        yield from emit(parents, children)
                    now, parents, children = comp[i], [], []
                parents += p[i:j]
                children += c[i:j]
        if parents:
            yield from emit(parents, children)

    def small_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Joins the many tiny results of small components into fewer frames."""
        held, size = [], 0
        for x in run(batches):
            held.append(x)
            size += int(x["path"].map(len).sum()) if "path" in x else len(x)
            if len(held) >= 500 or size >= 2 * _EMIT:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return small_frames


def _split(edges: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges with their component: those to co-locate and, if any, those of components beyond `max_edges`. Ends may be names or `node_id`s."""
    edges = cut(edges)
    labels = connected_components(edges, "parent", "child")
    node = node_id("parent") if edges.schema["parent"].dataType.typeName() == "string" else F.col("parent")
    with_comp = cut(edges.join(labels, node == F.col("node")).select("component", "parent", "child"))
    big = with_comp.groupBy("component").count().where(F.col("count") > max_edges).select("component")
    if not big.take(1):
        return with_comp, None
    big = cut(big)
    return with_comp.join(big, "component", "left_anti"), with_comp.join(big, "component", "left_semi")


def _colocated(edges: DataFrame, what: str, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return edges.repartition("component").sortWithinPartitions("component").mapInPandas(_per_component(what, names), schema)


def _reach_by_doubling(edges: DataFrame) -> DataFrame:
    """(a, d, distance): every pair with a directed walk of one step or more from a to d, for giant components."""
    reach = cut(edges.select(F.col("parent").alias("a"), F.col("child").alias("d"), F.lit(1).alias("distance")).distinct())
    size = reach.count()
    while True:
        right = reach.select(F.col("a").alias("d"), F.col("d").alias("e"), F.col("distance").alias("more"))
        longer = reach.join(right, "d").select("a", F.col("e").alias("d"), (F.col("distance") + F.col("more")).alias("distance"))
        new = cut(reach.union(longer).groupBy("a", "d").agg(F.min("distance").alias("distance")))
        state = new.agg(F.count("*"), F.sum("distance")).first()
        if tuple(state) == size:
            return new
        size, reach = tuple(state), new


def _peel(edges: DataFrame) -> DataFrame:
    """Edges from a node with a parent to a node with children: all others lie on no cycle."""
    kept = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
    return cut(kept.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))


def _peeled(edges: DataFrame, least: float = 0.2) -> DataFrame:
    """`edges` peeled as long as a round takes off a share of `least` or more (0: until nothing goes)."""
    n = edges.count()
    while n:
        edges = _peel(edges)
        left = edges.count()
        if n - left <= least * n:
            break
        n = left
    return edges


def _reached(edges: DataFrame, label: DataFrame) -> DataFrame:
    """`label` (node, colour) carried along the edges until each node has the smallest label of what reaches it.

    A node also takes the label of its label, which reaches it as well, so long chains take few rounds.
    """
    state = None
    while True:
        moved = edges.join(label.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "colour")
        ahead = label.select(F.col("node").alias("colour"), F.col("colour").alias("further"))
        jumped = label.join(ahead, "colour", "left").select("node", F.least("colour", "further").alias("colour"))
        label = cut(jumped.union(moved).groupBy("node").agg(F.min("colour").alias("colour")))
        now = label.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return label
        state = now


def coloured(edges: DataFrame) -> DataFrame:
    """(artifact_hash, cycle_hash) of parent-child `edges`: every node on a cycle with the smallest node of its cycle.

    Nodes are coloured forward with the smallest node that reaches them; those of a colour that also reach its own node
    are one strongly connected set. They are taken off and the rest is coloured again. Rows of a round are the edges
    and nodes that are left; nothing is paired and no task holds a component.
    """
    found: DataFrame | None = None
    while (edges := _peeled(edges, 0.0)).take(1):
        nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
        label = _reached(edges, nodes.select("node", F.col("node").alias("colour")))
        side = lambda c: label.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = cut(edges.join(side("parent"), "parent").join(side("child"), "child").where("parent_colour = child_colour").select("parent", "child"))
        members = cut(label.where("node = colour"))
        edge = members
        while edge.take(1):
            back = same.join(edge.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "colour").distinct()
            edge = cut(back.join(members, "node", "left_anti"))
            members = members.union(edge)
        members = cut(members)
        loops = edges.where("parent = child").select(F.col("parent").alias("node"))
        alone = members.groupBy("colour").agg(F.count("*").alias("n")).where("n = 1").select("colour").join(loops.withColumnRenamed("node", "colour"), "colour", "left_anti")
        new = members.join(alone, "colour", "left_anti").select(F.col("node").alias("artifact_hash"), F.col("colour").alias("cycle_hash"))
        found = new if found is None else found.union(new)
        gone = members.select("node")
        edges = cut(edges.join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("node", "child"), "child", "left_anti").select("parent", "child"))
    return edges.toDF("artifact_hash", "cycle_hash") if found is None else found


def _giant_dag(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges once each cycle is one node, and level 0: every root with the path of itself."""
    cyc = cut(coloured(edges.select("parent", "child")))
    as_ = lambda side: cyc.select(F.col("artifact_hash").alias(side), F.col("cycle_hash").alias(f"{side}_cycle"))
    dag = edges.select("parent", "child").join(as_("parent"), "parent", "left").join(as_("child"), "child", "left")
    dag = dag.select(F.coalesce("parent_cycle", "parent").alias("parent"), F.coalesce("child_cycle", "child").alias("child")).where("parent <> child").distinct()
    dag = cut(dag)
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("x")).distinct().join(as_("x"), "x", "left")
    nodes = nodes.select(F.coalesce("x_cycle", "x").alias("x")).distinct()
    roots = nodes.join(dag.select(F.col("child").alias("x")), "x", "left_anti")
    return dag, cut(roots.select(F.col("x").alias("root"), F.col("x").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("ways"), F.array("x").alias("path")))


def _giant_paths(edges: DataFrame) -> DataFrame:
    dag, level = _giant_dag(edges)
    levels = level
    while level.take(1):
        step = level.join(dag.select(F.col("parent").alias("node"), "child"), "node")
        step = step.select("root", F.col("child").alias("node"), F.col("depth") + 1, "ways", F.concat("path", F.array("child")).alias("path")).toDF("root", "node", "depth", "ways", "path")
        level = cut(step.groupBy("root", "node", "depth").agg(F.sum("ways").alias("ways"), F.min("path").alias("path")))
        levels = levels.union(level)
    return levels.groupBy("root", "node").agg(F.min("depth").alias("depth"), F.max("depth").alias("max_depth"), F.sum("ways").alias("n_paths"), F.min_by("path", "depth").alias("path")).select(F.col("node").alias("artifact_hash"), F.col("root").alias("root_hash"), "depth", "max_depth", "n_paths", "path")


def _giant_every_path(edges: DataFrame) -> DataFrame:
    dag, level = _giant_dag(edges)
    levels = level = level.drop("ways")
    while level.take(1):
        step = level.join(dag.select(F.col("parent").alias("node"), "child"), "node")
        level = cut(step.select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")))
        levels = levels.union(level)
    pairs = levels.groupBy("root", "node").agg(F.max("depth").alias("max_depth"), F.count("*").cast("double").alias("n_paths"))
    return levels.join(pairs, ["root", "node"]).select(F.col("node").alias("artifact_hash"), F.col("root").alias("root_hash"), "depth", "max_depth", "n_paths", "path")


def cycles(lineage: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(artifact_hash, cycle_hash): every artifact on a directed cycle, self-edges included.

    cycle_hash is the smallest member of the cycle (strongly connected set). Null hashes or relations, other
    relations, repeated edges and extra columns change nothing; an empty table gives no rows.
    """
    rows = _hierarchy_rows(lineage)
    edges = _peeled(cut(rows.select(node_id("parent").alias("parent"), node_id("child").alias("child")).distinct()))
    small, giant = _split(edges, max_edges)
    out = _colocated(small, "cycles", CYCLE_SCHEMA.replace("string", "binary"))
    if giant is not None:
        out = out.union(coloured(giant.select("parent", "child")))
    # names come back for what is on a cycle; the smallest id of a cycle stands for it until its smallest name is known
    names = rows.select(F.explode(F.array("parent", "child")).alias("name")).select(node_id("name").alias("artifact_hash"), "name")
    named = cut(names.join(out, "artifact_hash").groupBy("artifact_hash", "cycle_hash").agg(F.first("name").alias("name")))
    least = named.groupBy("cycle_hash").agg(F.min("name").alias("least"))
    return named.join(least, "cycle_hash").select(F.col("name").alias("artifact_hash"), F.col("least").alias("cycle_hash"))


def paths(lineage: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row per artifact and root above it: the shortest path (ties: the smallest), its depth, the longest depth, the number of paths.

    A root has itself as root at depth 0. A cycle is one node, named by its smallest hash (its members are
    listed by `cycles`), so nothing is followed for ever and what lies below a cycle still gets its paths.
    n_paths is a DOUBLE since it may be very large.
    """
    small, giant = _split(hierarchy_edges(lineage), max_edges)
    out = _colocated(small, "paths", PATH_SCHEMA)
    return out if giant is None else out.union(_giant_paths(giant))


def every_path(lineage: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row per path from a root to an artifact: its steps (depth), the path, and of its artifact and root the longest depth and number of paths.

    Roots and cycles as in `paths`. The rows are as many as the paths, which may grow exponentially where parents
    multiply; they are streamed, so a task holds one path and what it has not yet sent.
    """
    small, giant = _split(hierarchy_edges(lineage), max_edges)
    out = _colocated(small, "every_path", PATH_SCHEMA)
    return out if giant is None else out.union(_giant_every_path(giant))


def descendants(lineage: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(artifact_hash, descendant_hash, distance): all descendants with the fewest steps; a cycle's member is its own descendant."""
    small, giant = _split(hierarchy_edges(lineage), max_edges)
    out = _colocated(small, "closure", CLOSURE_SCHEMA)
    return out if giant is None else out.union(_reach_by_doubling(giant).toDF("artifact_hash", "descendant_hash", "distance"))


def shortest_from_roots(lineage: DataFrame, directed: bool = True, max_edges: int = MAX_EDGES) -> DataFrame:
    """(start, node, distance, path): `graph.shortest_paths` from every artifact without a parent, with no limit of steps.

    Components are co-located, so depth costs no jobs; those beyond `max_edges` go level by level.
    """
    small, giant = _split(hierarchy_edges(lineage), max_edges)
    out = _colocated(small, "from_roots" if directed else "from_roots_undirected", REACH_SCHEMA)
    if giant is None:
        return out
    starts = giant.select(F.col("parent").alias("start")).distinct().join(giant.select(F.col("child").alias("start")), "start", "left_anti")
    return out.union(graph.shortest_paths(giant.select("parent", "child"), starts, directed))
