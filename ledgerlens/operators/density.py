"""Density clusters (T6): minimum spanning tree, condensed tree, stable clusters, noise [Campello et al. 2013].

The input is a neighbour graph (``neighbours.nearest``). An edge weighs the
mutual reachability of its ends: their distance, or the distance within which
one of them has ``min_samples`` points (itself included), whichever is largest.

Everything that would be one long loop over sorted edges is done in rounds of
joins, their number growing with the logarithm of the number of points:

* ``spanning_forest``: Borůvka rounds. Every component picks its lightest edge,
  picks are contracted (pointers to the smaller end of the pair that picks the
  same edge, doubled until they rest), and of parallel edges the lightest stays.
* ``chains``: the single-linkage tree out of the same rounds. A forest edge
  belongs to the first component of the rounds that holds it and whose own
  pick is heavier. A component's edges in ascending order are a chain: each
  joins what the lighter ones made with one other component, which that edge
  was the pick of; the component's pick goes on from the chain's end. So a
  component's chain needs only those of earlier rounds.
* ``condense``: round by round, chains are streamed in ascending order with
  what their side components came to (``_State``). Joining two parts of
  ``min_size`` points or more closes both clusters - their stability, and
  whether it is at least what their own parts gained, is known then - and opens
  a new one; smaller parts fall to the cluster that takes them.
* ``labels``: a cluster is selected when it wins and no cluster above it does,
  found by doubling pointers up the cluster tree. A point goes to the selected
  cluster at or above the first cluster that holds it, or is noise (-1).

Ties between edges go by their ends, so the result is one for a given graph. A
chain is streamed by one task, sorted by Spark and in constant memory; no
table of edges, clusters or points goes through the driver. A graph in several
components is a tree whose components part at once; when only one of them has
``min_size`` points it is the root and, like any root, no cluster itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from .relational import row_positions

NOISE = -1
#: Distances are given to nine places; nothing is denser than this.
LEAST = 1e-9


def mutual_reachability(graph: DataFrame, min_samples: int = 5) -> DataFrame:
    """u, v, w (u < v) of every edge of ``graph`` (u, rank, v, distance), which holds ``min_samples - 1`` neighbours of a row or all there are."""
    core = graph.where(F.col("rank") < max(min_samples, 2)).groupBy("u").agg(F.max("distance").alias("core"))
    if min_samples < 2:
        core = core.withColumn("core", F.lit(0.0))
    pairs = graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "distance").where("u < v").groupBy("u", "v").agg(F.min("distance").alias("d"))
    j = pairs.join(core.withColumnRenamed("core", "cu"), "u").join(core.select(F.col("u").alias("v"), F.col("core").alias("cv")), "v")
    return j.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))


def _roots(parents: DataFrame) -> DataFrame:
    """a, up: where the pointers (a, parent) lead; a root points to itself."""
    now = parents.select("a", F.col("parent").alias("up"))
    while True:
        on = now.select(F.col("a").alias("up"), F.col("up").alias("next"))
        new = write_once(now.join(on, "up").select("a", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "pointers")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def spanning_forest(edges: DataFrame) -> list[DataFrame]:
    """The rounds over ``edges`` (u, v, w): a (a component), w, u, v (its pick), other (the pick's far end), mutual (other's pick too), up (the component it becomes).

    The first round's components are the points, a later one's are named after one of them.
    """
    rounds = []
    now = write_once(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"), "edges")
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
        best = both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("m")).select("a", "m.w", "m.u", "m.v", F.col("m.b").alias("other"))
        best = write_once(best, "best")
        back = best.select(F.col("a").alias("other"), F.col("u").alias("u2"), F.col("v").alias("v2"))
        picks = best.join(back, "other").withColumn("mutual", (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2"))).drop("u2", "v2")
        picks = write_once(picks.withColumn("parent", F.when(F.col("mutual") & (F.col("a") < F.col("other")), F.col("a")).otherwise(F.col("other"))), "picks")
        up = _roots(picks)
        rounds.append(write_once(picks.drop("parent").join(up, "a"), "round"))
        moved = now.join(up.withColumnRenamed("up", "x"), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        now = write_once(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("m"))
                         .select("a", "b", "m.w", "m.u", "m.v"), "edges")
    return rounds


def forest_edges(rounds: list[DataFrame]) -> DataFrame | None:
    """u, v, w of the spanning forest, each edge once."""
    out = None
    for r in rounds:
        e = r.where(~F.col("mutual") | (F.col("a") < F.col("other"))).select("u", "v", "w")
        out = e if out is None else out.unionByName(e)
    return out


def chains(rounds: list[DataFrame]) -> list[DataFrame]:
    """For each round the chains of the components that it made: vertex, w, u, v, side_round, side, side2 (the components that the edge joins to the chain)."""
    out, carried = [], None
    for i, r in enumerate(rounds):
        rows = r.where(~F.col("mutual") | (F.col("a") < F.col("other"))).select(
            F.col("up").alias("vertex"), "w", "u", "v", F.lit(i).alias("side_round"), F.col("a").alias("side"), F.when(F.col("mutual"), F.col("other")).alias("side2"))
        rows = rows if carried is None else rows.unionByName(carried)
        if i + 1 < len(rounds):
            pick = rounds[i + 1].select(F.col("a").alias("vertex"), F.struct("w", "u", "v").alias("pick"), "up")
            j = rows.join(pick, "vertex", "left")
            j = write_once(j.withColumn("here", F.col("pick").isNull() | (F.struct("w", "u", "v") < F.col("pick"))).drop("pick"), "chains")
            out.append(j.where("here").drop("here", "up"))
            carried = j.where("not here").drop("vertex", "here").withColumnRenamed("up", "vertex").select(*rows.columns)
        else:
            out.append(write_once(rows, "chains"))
    return out


@dataclass(frozen=True)
class _State:
    """A part of the tree from below: its points and, from ``min_size`` points on, the open cluster that holds them.

    ``gained`` is the sum over the cluster's points of the density at which
    each left it; ``kids`` what the clusters below it gain at best, null without any.
    """

    size: int
    cluster: tuple[int, int] | None = None
    gained: float = 0.0
    kids: float | None = None


def _close(s: _State, density: float, parent: tuple[int, int] | None) -> tuple[float, tuple]:
    """(the best that the cluster and those below it gain, the row of the cluster) when it ends at ``density``."""
    stability = s.gained - density * s.size
    wins = s.kids is None or stability >= s.kids
    return (stability if wins else s.kids), (*s.cluster, *(parent or (None, None)), density, stability, s.size, wins)


def _join(a: _State, b: _State, edge: tuple[int, int], w: float, min_size: int, closed: list[tuple]) -> _State:
    """Two parts joined by an edge; appends the clusters that this closes."""
    density, size = 1.0 / max(w, LEAST), a.size + b.size
    if a.cluster and b.cluster:
        (x, row), (y, other) = (_close(s, density, edge) for s in (a, b))
        closed += [row, other]
        return _State(size, edge, density * size, x + y)
    if a.cluster or b.cluster:
        big, few = (a, b) if a.cluster else (b, a)
        return replace(big, size=size, gained=big.gained + density * few.size)
    return _State(size, edge, density * size) if size >= min_size else _State(size)


_KINDS = {
    # what a component came to; which cluster an edge's points are in (null: none yet); a closed cluster
    "kind": pa.string(), "vertex": pa.int64(), "u": pa.int64(), "v": pa.int64(), "cu": pa.int64(), "cv": pa.int64(),
    "size": pa.int64(), "gained": pa.float64(), "kids": pa.float64(),
    "pu": pa.int64(), "pv": pa.int64(), "density": pa.float64(), "stability": pa.float64(), "wins": pa.bool_()}
_KINDS_SQL = ("kind string, vertex long, u long, v long, cu long, cv long, size long, gained double, kids double, "
              "pu long, pv long, density double, stability double, wins boolean")


def _walk(min_size: int):
    """The streaming pass over chains sorted by vertex, w, u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertex, state, waiting = None, None, []  # edges below min_size points: fewer than that

        def shown(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _KINDS.items()], schema=pa.schema(list(_KINDS.items())))

        def edge_row(u, v, s):
            cu, cv = s.cluster or (None, None)
            return {"kind": "edge", "vertex": vertex, "u": u, "v": v, "cu": cu, "cv": cv}

        def end():
            cu, cv = state.cluster or (None, None)
            return [edge_row(u, v, state) for u, v in waiting] + [
                {"kind": "state", "vertex": vertex, "cu": cu, "cv": cv, "size": state.size, "gained": state.gained, "kids": state.kids}]

        def part(r, n):
            cluster = None if r[f"cu{n}"] is None else (r[f"cu{n}"], r[f"cv{n}"])
            return _State(r[f"size{n}"], cluster, r[f"gained{n}"] or 0.0, r[f"kids{n}"])

        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                if r["vertex"] != vertex:
                    out += end() if state else []
                    vertex, state, waiting = r["vertex"], part(r, 2), []  # a chain's first edge joins two components
                closed: list[tuple] = []
                state = _join(state, part(r, 1), (r["u"], r["v"]), r["w"], min_size, closed)
                out += [{"kind": "cluster", "cu": c[0], "cv": c[1], "pu": c[2], "pv": c[3], "density": c[4], "stability": c[5], "size": c[6], "wins": c[7]} for c in closed]
                if state.cluster:
                    out += [edge_row(u, v, state) for u, v in waiting] + [edge_row(r["u"], r["v"], state)]
                    waiting = []
                else:
                    waiting.append((r["u"], r["v"]))
            if out:
                yield shown(out)
        if state:
            yield shown(end())

    return run


def condense(rounds: list[DataFrame], min_size: int = 5) -> tuple[DataFrame, DataFrame] | None:
    """(clusters: cu, cv, pu, pv, density, stability, size, wins; edges: u, v, round, vertex, cu, cv), or None without edges.

    A cluster is named after the edge that made it, pu and pv name the one
    above it, ``density`` is where it parts from that one.
    """
    if not rounds:
        return None
    points = F.lit(1).cast("long")
    states = clusters = edges = roots = None
    for i, c in enumerate(chains(rounds)):
        for n, side in ((1, "side"), (2, "side2")):
            cols = [f"{x}{n}" for x in ("size", "cu", "cv", "gained", "kids")]
            if states is None:
                c = c.select("*", *[(points if x.startswith("size") else F.lit(None).cast("double" if x[0] in "gk" else "long")).alias(x) for x in cols])
            else:
                s = states.select(F.col("round").alias("side_round"), F.col("vertex").alias(side), *[F.col(x[:-1]).alias(x) for x in cols])
                c = c.join(s, ["side_round", side], "left").withColumn(f"size{n}", F.coalesce(f"size{n}", points))
        sort = c.drop("side_round", "side", "side2").repartition("vertex").sortWithinPartitions("vertex", "w", "u", "v")
        out = write_once(sort.mapInArrow(_walk(min_size), _KINDS_SQL).withColumn("round", F.lit(i + 1)), "condensed")
        new = out.where("kind = 'state'").select("round", "vertex", "size", "cu", "cv", "gained", "kids")
        ended = new if i + 1 == len(rounds) else new.join(rounds[i + 1].select(F.col("a").alias("vertex")), "vertex", "left_anti").select(*new.columns)
        more = (new, out.where("kind = 'cluster'").select("cu", "cv", "pu", "pv", "density", "stability", "size", "wins"),
                out.where("kind = 'edge'").select("u", "v", "round", "vertex", "cu", "cv"), ended.where("cu is not null"))
        states, clusters, edges, roots = more if states is None else (x.unionByName(y) for x, y in zip((states, clusters, edges, roots), more))
    several = roots.limit(2).count() > 1
    top = roots.select("cu", "cv", F.lit(None).cast("long").alias("pu"), F.lit(None).cast("long").alias("pv"), F.lit(0.0).alias("density"), F.col("gained").alias("stability"), "size",
                       (F.lit(several) & (F.col("kids").isNull() | (F.col("gained") >= F.col("kids")))).alias("wins"))
    return write_once(clusters.unionByName(top), "clusters"), edges


def _selected(clusters: DataFrame) -> DataFrame:
    """cu, cv, su, sv: the selected cluster at or above each cluster (the highest that wins), null where there is none."""
    own = F.when(F.col("wins"), F.struct(F.col("cu").alias("u"), F.col("cv").alias("v")))
    now = write_once(clusters.select("cu", "cv", "pu", "pv", own.alias("top")), "selected")
    while not now.where("pu is not null").isEmpty():
        above = now.select(F.col("cu").alias("pu"), F.col("cv").alias("pv"), F.col("pu").alias("nu"), F.col("pv").alias("nv"), F.col("top").alias("higher"))
        done = now.where("pu is null")
        moved = now.where("pu is not null").join(above, ["pu", "pv"]).select(
            "cu", "cv", F.col("nu").alias("pu"), F.col("nv").alias("pv"), F.coalesce("higher", "top").alias("top"))
        now = write_once(done.unionByName(moved), "selected")
    return now.select("cu", "cv", F.col("top.u").alias("su"), F.col("top.v").alias("sv"))


def labels(points: DataFrame, graph: DataFrame, min_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """key, cluster of every row of ``points`` (key) over their neighbour ``graph``: 0, 1, ... by falling size, ties by the smallest key; noise -1."""
    rounds = spanning_forest(mutual_reachability(graph, min_samples or min_size))
    found = condense(rounds, min_size)
    if found is None:
        return points.select("key", F.lit(NOISE).alias("cluster"))
    clusters, edges = found
    picks = None
    for i, r in enumerate(rounds):
        p = r.select(F.lit(i).alias("round"), F.col("a").alias("vertex"), "u", "v")
        picks = p if picks is None else picks.unionByName(p)
    # from a point along picks to the first edge whose points are in a cluster; each step is to a later round
    step = write_once(picks.join(edges.select("u", "v", F.col("round").alias("next_round"), F.col("vertex").alias("next"), "cu", "cv"), ["u", "v"]).drop("u", "v"), "steps")
    now, placed = points.select("key", F.lit(0).alias("round"), F.col("key").alias("vertex")), None
    for _ in rounds:
        j = write_once(now.join(step, ["round", "vertex"]), "climb")
        got = j.where("cu is not null").select("key", "cu", "cv")
        placed = got if placed is None else placed.unionByName(got)
        now = j.where("cu is null").select("key", F.col("next_round").alias("round"), F.col("next").alias("vertex"))
        if now.isEmpty():
            break
    member = write_once(placed.join(_selected(clusters), ["cu", "cv"]).where("su is not null").select("key", "su", "sv"), "members")
    sizes = member.groupBy("su", "sv").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    numbers = row_positions(sizes, [F.desc("n"), F.asc("least")], "cluster").select("su", "sv", F.col("cluster").cast("int").alias("cluster"))
    named = member.join(numbers, ["su", "sv"]).select("key", "cluster")
    return points.select("key").join(named, "key", "left").select("key", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
