"""Iterative graph helpers: cycles, breadth-first search, and moves of subtrees in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import dealt, discard, settle


def _pointers(edges: DataFrame, doc: str) -> DataFrame:
    """(doc, at, to): vertices with a single outgoing edge, and where it leads."""
    return edges.groupBy(doc, F.col("s").alias("at")).agg(F.count("*").alias("n"), F.min("t").alias("to")).where("n = 1").drop("n")


def _jumps(pointers: DataFrame, doc: str) -> list[DataFrame]:
    """Tables (doc, at, to) of 1, 2, 4, ... steps along the pointers, as far as they go.
    The last one leads out of the pointers, or, from a vertex that runs into a ring of them, into the ring."""
    tables, total = [settle(pointers)], None
    while True:
        last = tables[-1]
        on = last.select(doc, F.col("at").alias("to"), F.col("to").alias("beyond"))
        moved = last.join(on, [doc, "to"], "left").select(doc, "at", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
        moved = settle(moved)
        total = total or last.count()
        # A ring never ends; steps as many as there are pointers are known to be in it.
        if moved.where("moved").isEmpty() or 2 ** (len(tables) - 1) >= total:
            discard(moved)
            return tables
        tables.append(moved.select(doc, "at", "to"))
        tables[-1].settled_at = moved.settled_at


def _contract(edges: DataFrame, doc: str) -> dict | None:
    """One level: every vertex with a single outgoing edge is merged into where its pointers lead.

    What leaves it can only go along the pointer, so an edge into it lies on a cycle exactly
    if the edge drawn to the end of the pointers does."""
    jumps = _jumps(_pointers(edges, doc), doc)
    if jumps[0].isEmpty():
        discard(*jumps)
        return None
    at = jumps[0].select(doc, F.col("at").alias("s"))
    ends = jumps[-1].select(doc, F.col("at").alias("t"), F.col("to").alias("root"))
    # A ring of pointers has no way out: its vertices are the ends that are pointers themselves.
    ring = settle(ends.join(at.withColumnRenamed("s", "root"), [doc, "root"], "left_semi").select(doc, F.col("root").alias("at")).distinct())
    outer = edges.join(at, [doc, "s"], "left_anti").join(ends, [doc, "t"], "left").select(doc, "s", "t", F.coalesce("root", "t").alias("root"))
    outer = settle(outer.join(ring.select(doc, F.col("at").alias("root")), [doc, "root"], "left_anti"))
    return {"jumps": jumps, "ring": ring, "outer": outer}


def _expand(level: dict, on: DataFrame, doc: str) -> DataFrame:
    """The edges (doc, s, t) on cycles of a level from those (doc, s, t) of the contracted graph."""
    outer, jumps = level["outer"], level["jumps"]
    hit = outer.join(on.select(doc, "s", F.col("t").alias("root")), [doc, "s", "root"], "left_semi").select(doc, "s", "t")
    hit = settle(hit.unionByName(outer.where("s = root").select(doc, "s", "t")))
    # All pointers behind the end of such an edge are on the same cycle: marks go on by halving steps.
    marks = settle(hit.select(doc, F.col("t").alias("at")).unionByName(level["ring"]).distinct())
    for table in [] if marks.isEmpty() else reversed(jumps):
        more = settle(marks.unionByName(marks.join(table, [doc, "at"]).select(doc, F.col("to").alias("at"))).distinct())
        discard(marks)
        marks = more
    inner = jumps[0].join(marks, [doc, "at"], "left_semi").select(doc, F.col("at").alias("s"), F.col("to").alias("t"))
    out = settle(hit.unionByName(inner))
    discard(hit, marks, outer, level["ring"], *jumps)
    return out


def _coloured(edges: DataFrame, doc: str) -> DataFrame:
    """The edges (doc, s, t) inside strongly connected components, for a graph that cannot be
    contracted: every vertex takes the largest colour that reaches it, each colour's own vertex is
    followed backwards within its colour, what it meets is a component, and the rest goes on
    within its colours. A round works on the vertices that changed in the one before."""
    found, left = [], settle(edges)
    while not left.isEmpty():
        vertices = left.select(doc, F.col("s").alias("v")).union(left.select(doc, F.col("t").alias("v"))).distinct()
        # Colours in an order that has nothing to do with the graph's own: a pass then splits it well.
        colour = settle(vertices.withColumn("c", F.struct(F.xxhash64("v").alias("h"), "v")))
        fresh = colour
        while True:
            pushed = left.join(fresh.select(doc, F.col("v").alias("s"), "c"), [doc, "s"]).groupBy(doc, F.col("t").alias("v")).agg(F.max("c").alias("new"))
            both = settle(colour.join(pushed, [doc, "v"], "left").select(doc, "v", F.greatest("c", "new").alias("c"), F.coalesce(F.col("new") > F.col("c"), F.lit(False)).alias("up")))
            discard(colour)
            colour, fresh = both.drop("up"), both.where("up").drop("up")
            colour.settled_at = both.settled_at
            if fresh.isEmpty():
                break
        ends = lambda x: colour.select(doc, F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
        same = settle(left.join(ends("s"), [doc, "s"]).join(ends("t"), [doc, "t"]).where("c_s = c_t").select(doc, "s", "t", F.col("c_s").alias("c")))
        part = settle(colour.where("v = c.v"))
        reached = fresh = part
        used = [part]
        while True:
            back = same.join(fresh.select(doc, F.col("v").alias("t"), "c"), [doc, "t", "c"]).select(doc, F.col("s").alias("v"), "c").distinct()
            fresh = settle(back.join(reached.select(doc, "v"), [doc, "v"], "left_anti"))
            used.append(fresh)
            if fresh.isEmpty():
                break
            reached = reached.unionByName(fresh)
        inside = settle(reached.select(doc, "v"))
        of = lambda e, x, how: e.join(inside.select(doc, F.col("v").alias(x)), [doc, x], how)
        found.append(settle(of(of(same, "s", "left_semi"), "t", "left_semi").select(doc, "s", "t")))
        rest = settle(of(of(same, "s", "left_anti"), "t", "left_anti").select(doc, "s", "t"))
        discard(left, colour, same, inside, *used)
        left = rest
    out = left
    for f in found:
        out = out.unionByName(f)
    return out


#: A document of so many edges at most is looked at by itself, in one pass.
SERIAL_EDGES = 1 << 17
#: Types of ids that are equal in Python exactly if they are in Spark.
PLAIN_IDS = {"string", "bigint", "int", "smallint", "tinyint"}


def _components(pairs: set[tuple]) -> dict:
    """Every vertex of the edges with the name of its strongly connected component (Tarjan, without recursion)."""
    out: dict = {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
    index, low, of, open_ = {}, {}, {}, []
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        open_.append(root)
        path = [(root, iter(out[root]))]
        while path:
            v, ways = path[-1]
            for w in ways:
                if w not in index:
                    index[w] = low[w] = len(index)
                    open_.append(w)
                    path.append((w, iter(out.get(w, ()))))
                    break
                if w not in of and index[w] < low[v]:
                    low[v] = index[w]
            else:
                path.pop()
                if path and low[v] < low[path[-1][0]]:
                    low[path[-1][0]] = low[v]
                while low[v] == index[v] and v not in of:
                    of[open_.pop()] = v
    return of


def _on_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, s, t) sorted by document: those on cycles. Only the edges of one document are kept."""
    key, pairs, found, schema = None, set(), [], None

    def close():
        of = _components(pairs)
        found.extend((key, s, t) for s, t in pairs if of[s] == of[t])

    def rows():
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        found.clear()
        return made

    for batch in batches:
        schema = batch.schema
        for at, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != key:
                close()
                key, pairs = at, set()
            pairs.add((s, t))
        if len(found) >= 10000:
            yield rows()
    close()
    if found:
        yield rows()


def cyclic_edges(edges: DataFrame, doc: str = "doc_id", src: str = "source_node_id", dst: str = "target_node_id", serial: int = SERIAL_EDGES) -> DataFrame:
    """The edges that lie on a cycle, that is whose ends are in one strongly connected component.

    Documents of up to ``serial`` edges are dealt out and looked at one by one, in one pass; larger
    ones are worked on by all tasks together (``_spread_cycles``). Null ends make no edge."""
    base = settle(edges.select(doc, F.col(src).alias("s"), F.col(dst).alias("t")).where("s IS NOT NULL AND t IS NOT NULL"))
    types = dict(base.dtypes)
    if types[doc] not in PLAIN_IDS or types["s"] not in PLAIN_IDS or types["s"] != types["t"]:
        serial = 0
    # Without a document no edge meets another one; a loop is a cycle by itself.
    loops = settle(base.where(f"s = t AND `{doc}` IS NULL").distinct())
    known = base.where(f"`{doc}` IS NOT NULL")
    large = settle(known.groupBy(doc).agg(F.count("*").alias("n")).where(F.col("n") > serial).select(doc))
    some = not large.isEmpty()
    small = known.join(dealt(large), doc, "left_anti") if some else known
    line = small.repartition(doc).sortWithinPartitions(doc)
    out = settle(line.mapInArrow(_on_cycles, f"`{doc}` {types[doc]}, s {types['s']}, t {types['t']}")).unionByName(loops)
    if some:
        out = out.unionByName(_spread_cycles(known.join(dealt(large), doc, "left_semi"), doc))
    discard(base, large)
    return out.select(doc, F.col("s").alias(src), F.col("t").alias(dst))


def _spread_cycles(edges: DataFrame, doc: str) -> DataFrame:
    """The edges (doc, s, t) on cycles, of documents of any size.

    Vertices with a single outgoing edge are merged into where it leads, by doubled pointers, then
    those with a single incoming edge, and edges at dead ends are trimmed, as long as that takes
    off a good part; so trees and chains are gone in rounds that grow with the logarithm of their length.
    What cannot be contracted is coloured. The levels are then unfolded again, which tells the
    edges on a cycle from those between cycles."""
    base = edges.distinct()
    loops = settle(base.where("s = t"))
    turned = lambda e: e.select(doc, F.col("t").alias("s"), F.col("s").alias("t"))
    now = settle(base.where("s <> t"))
    levels: list[tuple[dict, bool]] = []
    quiet, flipped, size = 0, False, now.count()
    while size and quiet < 2:
        sources = now.select(doc, F.col("s").alias("t")).distinct()
        targets = now.select(doc, F.col("t").alias("s")).distinct()
        live = settle(now.join(sources, [doc, "t"], "left_semi").join(targets, [doc, "s"], "left_semi"))
        discard(now)
        level = _contract(live, doc)
        now = live
        if level:
            levels.append((level, flipped))
            now = settle(level["outer"].where("s <> root").select(doc, "s", F.col("root").alias("t")).distinct())
            discard(live)
        # A level has a price; what shrinks no more by a quarter is coloured.
        before, size = size, now.count()
        quiet = quiet + 1 if 4 * size > 3 * before else 0
        turned_now = settle(turned(now))
        discard(now)
        now, flipped = turned_now, not flipped
    on = settle(_coloured(now, doc))
    on = turned(on) if flipped else on
    for level, was in reversed(levels):
        on = _expand(level, turned(on) if was else on, doc)
        on = turned(on) if was else on
    return on.unionByName(loops)


def cyclic_documents(edges: DataFrame, doc: str = "doc_id", **cols) -> DataFrame:
    """(doc, n): documents whose edges contain a cycle and how many edges lie on one."""
    return cyclic_edges(edges, doc, **cols).groupBy(doc).agg(F.count("*").alias("n"))


def expand_hops(
    seeds: DataFrame, edges: DataFrame, depth: int, keys: list[str], node: str = "entity_id",
) -> DataFrame:
    """Breadth-first search from many seed sets at once.

    ``seeds`` has ``keys``, ``node`` and ``max_depth``; ``edges`` has a scope, ``src`` and ``dst`` in both
    directions plus ``relationship_type``.  Returns the least hop per (keys, node).  A
    round expands only the newest frontier, so a node is expanded once per key.
    """
    seen = seeds.select(*keys, node, F.lit(0).alias("hop"))
    frontier = seeds
    for hop in range(1, depth + 1):
        step = (
            frontier.where(F.col("max_depth") >= hop)
            .join(dealt(edges), [F.col(node) == F.col("src"), F.col("version_id") == F.col("edge_version")])
            .where("relationship_types IS NULL OR size(relationship_types) = 0 OR "
                   "array_contains(relationship_types, relationship_type)")
            .select(*[c for c in frontier.columns if c != node], F.col("dst").alias(node))
            .distinct()
        )
        fresh = settle(step.join(dealt(seen.select(*keys, node)), [*keys, node], "left_anti"))
        seen = seen.unionByName(fresh.select(*keys, node, F.lit(hop).alias("hop")))
        if fresh.isEmpty():
            break
        frontier = fresh
    return seen


MOVES_PER_BATCH = 4096


def nearest_marked(links: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, top): the nearest marked node at or above every node of ``links`` (keys,
    node_id, parent_id), by doubled pointers; null where none is met. ``marked`` has keys, node_id."""
    flag = marked.select(*keys, "node_id", F.lit(True).alias("_m"))
    ups = links.join(flag, [*keys, "node_id"], "full_outer")
    now = settle(ups.select(*keys, "node_id", F.when(F.col("_m"), F.col("node_id")).otherwise(F.col("parent_id")).alias("top"), F.coalesce("_m", F.lit(False)).alias("closed")))
    # A ring without a marked node never closes; it is known by the number of steps.
    size, steps = now.count(), 1
    while steps <= size and not now.where("NOT closed").isEmpty():
        far = now.select(*keys, F.col("node_id").alias("top"), F.col("top").alias("_far"), F.col("closed").alias("_end"))
        jumped = now.where("NOT closed").join(far, [*keys, "top"], "left").select(*keys, "node_id", F.col("_far").alias("top"), F.coalesce("_end", F.lit(True)).alias("closed"))
        more = settle(now.where("closed").unionByName(jumped))
        discard(now)
        now, steps = more, 2 * steps
    out = now.select(*keys, "node_id", F.when(F.col("closed"), F.col("top")).alias("top"))
    out.settled_at = now.settled_at
    return out


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay of the moves over the links between their nodes: rows (keys, n, node_id, top) sorted by
    keys and n, links (without n) first. One pass; only the links of one group are kept."""
    key, up = None, {}
    for batch in batches:
        *keys, ns, nodes, tops = (c.to_pylist() for c in batch.columns)
        kept, bad = [], []
        for i, (*at_key, n, node, top) in enumerate(zip(*keys, ns, nodes, tops, strict=True)):
            if at_key != key:
                key, up = at_key, {}
            at = top
            while n is not None and at is not None and at != node:
                at = up.get(at)
            if n is not None:
                kept.append(i)
                bad.append(at is not None)
            if n is None or at is None:
                up[node] = top
        moves = batch.select(range(len(keys) + 1)).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*moves.columns, pa.array(bad, pa.bool_())], [*moves.schema.names, "bad"])


def rejected_moves(parents: DataFrame, moves: DataFrame, keys: tuple[str, ...] = ("doc_id",), batch: int = MOVES_PER_BATCH) -> DataFrame:
    """Moves (keys, ord, node_id, parent_id) that would close a cycle when replayed in order, as
    rows (keys, ord). ``parents`` has doc_id, node_id, parent_id.

    The moves of a document are taken in batches of a bounded number. Within a batch only its own
    nodes change their parents, so every path is reduced to those: the nearest of them above a node
    is found for all nodes by doubled pointers over the links as of the start of the batch. The
    replay of a batch then reads nothing but its moves and these links, in one pass over the sorted rows.
    Rounds: batches of the longest log times the logarithm of the depth, however many moves fail.
    """
    keys = list(keys)
    log = Window.partitionBy(*keys).orderBy("ord")
    numbered = settle(moves.select(*keys, "ord", "node_id", "parent_id", (F.row_number().over(log) - 1).cast("long").alias("n")))
    last = numbered.agg(F.max("n")).first()[0]
    links = settle(numbered.select(*keys).distinct().join(parents.select("doc_id", "node_id", "parent_id"), "doc_id").select(*keys, "node_id", "parent_id"))
    types = dict(numbered.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, bad boolean"
    rejected = numbered.select(*keys, "ord").limit(0)
    for first in range(0, 0 if last is None else last + 1, batch):
        now = numbered.where(F.col("n").between(first, first + batch - 1))
        marked = settle(now.select(*keys, "node_id").distinct())
        own = links.join(now.select(*keys).distinct(), keys, "left_semi")
        near = nearest_marked(own, marked, keys)
        at_parent = near.withColumnRenamed("node_id", "parent_id")
        asked = now.join(at_parent, [*keys, "parent_id"], "left").select(*keys, "n", "node_id", "top")
        known = own.join(marked, [*keys, "node_id"], "left_semi").join(at_parent, [*keys, "parent_id"]).where("top IS NOT NULL")
        rows = asked.unionByName(known.select(*keys, F.lit(None).cast("long").alias("n"), "node_id", "top"))
        line = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("n"))
        decided = settle(line.mapInArrow(_decide, schema))
        result = settle(now.join(decided, [*keys, "n"]))
        rejected = rejected.unionByName(result.where("bad").select(*keys, "ord"))
        new = result.where("NOT bad").groupBy(*keys, "node_id").agg(F.max_by("parent_id", "n").alias("_new"))
        after = settle(links.join(new, [*keys, "node_id"], "full_outer").select(*keys, "node_id", F.coalesce("_new", "parent_id").alias("parent_id")))
        discard(links, near, marked, decided)
        links = after
    out = settle(rejected)
    discard(links, numbered)
    return out
