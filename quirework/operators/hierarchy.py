"""Section hierarchy, reading graph and their checks.

The open headings above a block are the last heading of each level that no later
heading of a smaller level has closed, so the whole ancestor path comes from six
running values and needs no iterative parent join.  Only nested list items need a
serial rule; it runs on the few columns it uses, chunk by chunk, with the open list
stack carried from one chunk to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK_ROWS, near, running

TARGETS = "('TABLE', 'EQUATION', 'CODE')"
NODE = "struct<seq:bigint,id:string,level:int,title:string,kind:string>"
LEVELS = range(1, 7)
NEST, OUTDENT = 10.0, 5.0


def _alive(stack, margin, kind):
    """Pop what a row at ``margin`` closes; stack items are (seq, margin, id, title)."""
    if kind == 1:
        while stack and not margin > stack[-1][1] + NEST:
            stack.pop()
    else:
        while stack and margin < stack[-1][1] - OUTDENT:
            stack.pop()
    return stack


_IN = ["doc", "chunk", "sec", "seq", "kind", "margin", "id", "title"]


def _stack_of(row_seq, row_margin, row_id, row_title):
    if row_seq is None:
        return []
    return list(zip([int(x) for x in row_seq], [float(x) for x in row_margin], list(row_id), list(row_title)))


def _open_lists(batches):
    """Per row: the open list items it sits in (serial inside one chunk)."""
    key, sec, stack = None, None, []
    for pdf in batches:
        seqs, ids, titles = [], [], []
        carry = zip(pdf["c_sec"].tolist(), pdf["c_seq"], pdf["c_margin"], pdf["c_id"], pdf["c_title"])
        for (doc, ch, s, seq, kind, margin, bid, title), c in zip(zip(*[pdf[n].tolist() for n in _IN]), carry):
            if key != (doc, ch):
                key, sec = (doc, ch), s
                stack = _stack_of(*c[1:]) if c[0] is not None and c[0] == s else []
            elif s != sec:
                sec, stack = s, []
            view = _alive(list(stack) if kind == 2 else stack, margin, kind)
            seqs.append([x[0] for x in view])
            ids.append([x[2] for x in view])
            titles.append([x[3] for x in view])
            if kind == 1:
                stack.append((seq, margin, bid, title))
        yield pdf[["doc", "chunk", "seq"]].assign(l_seq=seqs, l_id=ids, l_title=titles)


def _chunk_summaries(batches):
    """What one chunk leaves open and what it closes, if nothing were carried in."""
    import pandas as pd

    state = None

    def emit():
        if state is None:
            return []
        key, first, sec, stack, ml, mc = state
        return [(*key, first, sec, ml, mc, [x[0] for x in stack], [x[1] for x in stack],
                 [x[2] for x in stack], [x[3] for x in stack])]

    cols = ["doc", "chunk", "first_sec", "last_sec", "min_list", "min_text", "s_seq", "s_margin", "s_id", "s_title"]
    inf = float("inf")
    for pdf in batches:
        out = []
        for doc, ch, s, seq, kind, margin, bid, title in zip(*[pdf[n].tolist() for n in _IN]):
            if state is None or state[0] != (doc, ch):
                out += emit()
                state = [(doc, ch), s, s, [], inf, inf]
            elif s != state[2]:
                state[2:] = [s, [], inf, inf]
            if kind == 2:
                continue
            _alive(state[3], margin, kind)
            if kind == 1:
                state[3].append((seq, margin, bid, title))
                state[4] = min(state[4], margin)
            else:
                state[5] = min(state[5], margin)
        yield pd.DataFrame(out, columns=cols)
    yield pd.DataFrame(emit(), columns=cols)


def _carry_in(batches):
    """Open list stack at the start of every chunk, from the chunk summaries in order."""
    doc, sec, stack = None, None, []
    for pdf in batches:
        secs, out = [], []
        for r in pdf.itertuples(index=False):
            if r.doc != doc:
                doc, sec, stack = r.doc, None, []
            secs.append(sec)
            out.append(list(stack))
            own = _stack_of(r.s_seq, r.s_margin, r.s_id, r.s_title)
            if r.first_sec == r.last_sec == sec:
                stack = [x for x in stack if x[1] < r.min_list - NEST and x[1] <= r.min_text + OUTDENT] + own
            else:
                stack = own
            sec = r.last_sec
        res = pdf[["doc", "chunk"]].copy()
        res["c_sec"] = [None if x is None else int(x) for x in secs]
        res["c_sec"] = res["c_sec"].astype("Int64")
        for i, n in enumerate(("c_seq", "c_margin", "c_id", "c_title")):
            res[n] = [[x[i] for x in st] for st in out]
        yield res


def _list_paths(todo: DataFrame, doc_type: str, rows: int) -> DataFrame:
    """(doc, chunk, seq) with the open list items, outermost first."""
    by_chunk = lambda df: df.repartition("doc", "chunk").sortWithinPartitions("doc", "chunk", "seq")
    sums = by_chunk(todo.where(F.col("doc_rows") > rows).select(*_IN)).mapInPandas(
        _chunk_summaries,
        f"doc {doc_type}, chunk bigint, first_sec bigint, last_sec bigint, min_list double, min_text double, "
        "s_seq array<bigint>, s_margin array<double>, s_id array<string>, s_title array<string>",
    )
    carry = sums.repartition("doc").sortWithinPartitions("doc", "chunk").mapInPandas(
        _carry_in,
        f"doc {doc_type}, chunk bigint, c_sec bigint, c_seq array<bigint>, c_margin array<double>, "
        "c_id array<string>, c_title array<string>",
    )
    # Empty lists, not nulls: what is written to Python goes over a run of null lists again with every row.
    some = {c: F.coalesce(c, F.array().cast(carry.schema[c].dataType)) for c in ("c_seq", "c_margin", "c_id", "c_title")}
    first = todo.select(*_IN).join(carry, ["doc", "chunk"], "left").withColumns(some)
    return by_chunk(first).mapInPandas(
        _open_lists,
        f"doc {doc_type}, chunk bigint, seq bigint, l_seq array<bigint>, l_id array<string>, l_title array<string>",
    )


def hierarchy(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``path`` (ancestors, root first), parent, depth, chapter and section ids."""
    if "doc_rows" not in blocks.columns:
        raise ValueError("blocks need doc_rows, an upper bound of seq + 1 per document")
    if "margin_left" not in blocks.columns:
        blocks = blocks.withColumn("margin_left", F.col("x0"))
    look = ("block_type", "margin_left", "seq", "block_id", "_title")

    def around(w):
        return {f"_p_{c}": F.lag(c).over(w) for c in look} | {f"_n_{c}": F.lead(c).over(w) for c in look}

    # Texts that come up in paths: of headings and list items, and beside a caption that of its target.
    named = F.expr(f"IF(block_type IN ('HEADING', 'LIST') OR block_type IN {TARGETS}, text, NULL)")
    # Links and paths are found on keys and titles; the other columns meet them once, at the end.
    narrow = blocks.select("doc_id", "block_id", "seq", "doc_rows", "block_type", "heading_level", "margin_left", named.alias("_title"))
    df = near(narrow, around, rows=rows)
    df = df.withColumn(
        "_side",
        F.expr(
            f"CASE WHEN block_type <> 'CAPTION' THEN NULL WHEN _p_block_type IN {TARGETS} THEN '_p' "
            f"WHEN _n_block_type IN {TARGETS} THEN '_n' END"
        ),
    )
    beside = " ".join(
        f"WHEN '{s}' THEN named_struct('seq', {s}_seq, 'id', {s}_block_id, 'level', CAST(NULL AS INT), 'title', {s}__title, "
        f"'kind', {s}_block_type, 'margin', {s}_margin_left)"
        for s in ("_p", "_n")
    )
    df = df.withColumns(
        {
            "_target": F.expr(f"CASE _side {beside} END"),
            "previous_block_id": F.col("_p_block_id"), "next_block_id": F.col("_n_block_id"),
        }
    ).drop(*[f"_{s}_{c}" for s in "pn" for c in look], "_side")
    specs = {
        f"_h{k}": (
            "last",
            F.expr(f"IF(block_type = 'HEADING' AND heading_level = {k}, "
                   f"named_struct('seq', seq, 'id', block_id, 'level', {k}, 'title', _title, 'kind', 'HEADING'), NULL)"),
        )
        for k in LEVELS
    } | {"_list": ("last", F.expr("IF(block_type = 'LIST', seq, NULL)"))}
    df = running(df, specs, rows=rows)

    def open_heading(k: int) -> str:
        closed = "".join(f" AND _h{k}.seq > coalesce(_h{j}.seq, -1)" for j in range(1, k))
        return f"IF({k} < _own{closed}, _h{k}, NULL)"

    df = df.withColumn("_own", F.expr("IF(block_type = 'HEADING', heading_level, 7)"))
    df = df.withColumn("_heads", F.expr(f"array_compact(array({', '.join(open_heading(k) for k in LEVELS)}))"))
    df = df.withColumn("_sec", F.expr("coalesce(try_element_at(_heads, -1).seq, -1L)"))
    todo = df.where("block_type <> 'HEADING' AND _list > _sec").selectExpr(
        "doc_id AS doc", "chunk", "_sec AS sec", "seq", "doc_rows",
        "CASE WHEN _target IS NOT NULL THEN 2 WHEN block_type = 'LIST' THEN 1 ELSE 0 END AS kind",
        "IF(_target IS NOT NULL, _target.margin, margin_left) AS margin",
        "block_id AS id", "IF(block_type = 'LIST', _title, NULL) AS title",
    )
    lists = _list_paths(todo, blocks.schema["doc_id"].dataType.simpleString(), rows)
    lists = lists.select(F.col("doc").alias("_l_doc"), F.col("seq").alias("_l_at"), "l_seq", "l_id", "l_title")
    # The headings of each level stay behind: their texts are in ``_heads`` where they are open.
    added = ("chunk", "_target", "_heads", "previous_block_id", "next_block_id")
    links = df.select(F.col("doc_id").alias("_doc"), F.col("seq").alias("_at"), *added)
    links = links.join(lists, F.expr("_doc <=> _l_doc AND _at = _l_at"), "left").drop("_l_doc", "_l_at")
    df = blocks.drop(*added).join(links, F.expr("doc_id <=> _doc AND seq = _at")).drop("_doc", "_at")
    path = (
        "concat(_heads, coalesce(transform(arrays_zip(l_seq, l_id, l_title), x -> named_struct('seq', x.l_seq, "
        "'id', x.l_id, 'level', CAST(NULL AS INT), 'title', x.l_title, 'kind', 'LIST')), array()), "
        "IF(_target IS NULL, array(), array(named_struct('seq', _target.seq, 'id', _target.id, 'level', _target.level, "
        "'title', _target.title, 'kind', _target.kind))))"
    )
    df = df.withColumn("path", F.expr(f"CAST({path} AS array<{NODE}>)"))
    out = df.withColumns(
        {
            "parent_block_id": F.expr("try_element_at(path, -1).id"),
            "parent_seq": F.expr("try_element_at(path, -1).seq"),
            "depth": F.expr("size(path)"),
            "chapter_id": F.expr(
                "IF(block_type = 'HEADING' AND heading_level = 1, block_id, "
                "try_element_at(filter(path, x -> x.level = 1), -1).id)"
            ),
            "section_id": F.expr(
                "IF(block_type = 'HEADING', block_id, try_element_at(filter(path, x -> x.level IS NOT NULL), -1).id)"
            ),
            "caption_target_id": F.expr("_target.id"),
        }
    )
    return out.drop("_target", "_heads", "l_seq", "l_id", "l_title")


def subtrees(h: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Per node with children: subtree size, last position, children, last descendant in preorder.

    The subtree of a heading or a list item is an interval of positions from the node to
    ``last_seq``, the row behind which it is no longer open. Each row names only what closes behind
    it, so a node comes up once and no path is exploded. Every other node holds nothing but the
    captions beside it; its ``last_seq`` is null.
    """
    narrow = h.select(
        "doc_id", "block_id", "seq", "doc_rows", "parent_seq",
        F.expr("transform(filter(path, x -> x.kind IN ('HEADING', 'LIST')), x -> x.seq)").alias("_open"),
    )

    def around(w):
        return {"_still": F.lead("_open").over(w), "_p_parent": F.lag("parent_seq").over(w), "_p_id": F.lag("block_id").over(w)}

    # A caption that stands before its target follows it in preorder.
    ends = near(narrow, around, rows=rows).select(
        "doc_id", F.col("seq").alias("last_seq"), F.expr("IF(_p_parent = seq, _p_id, block_id)").alias("last_descendant"),
        F.explode(F.expr("array_except(_open, coalesce(_still, array()))")).alias("node_seq"),
    )
    kids = h.where("parent_seq IS NOT NULL").groupBy("doc_id", F.col("parent_seq").alias("node_seq")).agg(
        F.count("*").alias("child_count"),
        F.min_by("block_id", "seq").alias("first_descendant"),
        F.max_by("block_id", "seq").alias("_last_child"),
    )
    return kids.join(ends, ["doc_id", "node_seq"], "left").select(
        "doc_id", "node_seq", F.expr("coalesce(last_seq - node_seq, child_count) + 1").alias("subtree_size"), "child_count",
        "first_descendant", F.coalesce("last_descendant", "_last_child").alias("last_descendant"), "last_seq",
    )


def hierarchy_rows(h: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per block: parent, counts of children and siblings, subtree, section bounds.

    Children and siblings are not packed into arrays (one node may hold most of a
    document); ``children`` lists them as rows and siblings share ``parent_block_id``.
    """
    sub = subtrees(h, rows)
    kids = sub.select("doc_id", F.col("node_seq").alias("parent_seq"), F.col("child_count").alias("_siblings"))
    me = sub.withColumnRenamed("node_seq", "seq")
    df = h.join(me, ["doc_id", "seq"], "left").join(kids, ["doc_id", "parent_seq"], "left")
    head = "block_type = 'HEADING'"
    return df.withColumns(
        {
            "subtree_size": F.expr("coalesce(subtree_size, 1L)"),
            "last_seq": F.expr("IF(block_type IN ('HEADING', 'LIST'), coalesce(last_seq, seq), NULL)"),
            "child_count": F.expr("coalesce(child_count, 0L)"),
            "sibling_count": F.expr("coalesce(_siblings - 1, 0L)"),
            "first_descendant": F.expr(f"IF({head}, first_descendant, NULL)"),
            "last_descendant": F.expr(f"IF({head}, coalesce(last_descendant, block_id), NULL)"),
            "relation_type": F.expr(f"IF({head}, 'heading_hierarchy', 'parent_child_containment')"),
        }
    ).drop("_siblings")


def children(h: DataFrame) -> DataFrame:
    return h.where("parent_seq IS NOT NULL").select(
        "doc_id", F.col("parent_block_id").alias("block_id"), F.col("block_id").alias("child_id"), "seq"
    )


def reading_edges(h: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Parent, sibling, flow and caption edges, all derived from one pass over the blocks."""
    base = h.drop("chunk").select(
        "doc_id", "block_id", "seq", "parent_seq", "parent_block_id", "previous_block_id", "caption_target_id",
        "doc_rows",
    )
    df = running(base, {"_sib": ("last", F.col("block_id"))}, rows=rows, doc=["doc_id", "parent_seq"], before=True)
    edge = lambda cond, src, kind, conf: (
        f"IF({cond}, named_struct('source_id', {src}, 'target_id', block_id, 'edge_type', '{kind}', "
        f"'confidence', {conf}D), NULL)"
    )
    items = ", ".join(
        (
            edge("parent_block_id IS NOT NULL", "parent_block_id", "PARENT_CHILD", 0.90),
            edge("parent_block_id IS NOT NULL AND _sib IS NOT NULL", "_sib", "SIBLING", 0.95),
            edge("previous_block_id IS NOT NULL", "previous_block_id", "READING_FLOW", 0.99),
            edge("caption_target_id IS NOT NULL", "caption_target_id", "CAPTION_ASSOCIATION", 0.95),
        )
    )
    return df.select("doc_id", F.expr(f"inline(array_compact(array({items})))"))


def navigation(edges: DataFrame) -> DataFrame:
    """Parent, next and previous block of every block, from the edges alone."""
    both = edges.where("edge_type IN ('PARENT_CHILD', 'READING_FLOW')").select(
        "doc_id",
        F.expr(
            "inline(array(named_struct('block_id', target_id, 'other', source_id, 'kind', "
            "IF(edge_type = 'PARENT_CHILD', 'parent', 'previous')), named_struct('block_id', source_id, 'other', "
            "target_id, 'kind', IF(edge_type = 'PARENT_CHILD', 'child', 'next'))))"
        ),
    )
    pick = lambda k: F.expr(f"max(other) FILTER (WHERE kind = '{k}')").alias(f"{k}_id")
    return both.groupBy("doc_id", "block_id").agg(
        pick("parent"), pick("next"), pick("previous"), F.expr("count_if(kind = 'child')").alias("child_count")
    )


def closure(h: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) rows."""
    return h.select(
        "doc_id", F.col("block_id").alias("descendant_id"), F.col("depth"),
        F.posexplode("path").alias("_i", "_a"),
    ).selectExpr("doc_id", "_a.id AS ancestor_id", "descendant_id", "depth - _i AS distance")


def breadcrumbs(h: DataFrame) -> DataFrame:
    """Titles from the root down to the parent, and the enclosing section's title."""
    return h.select(
        "doc_id", "block_id",
        F.expr("filter(transform(path, x -> x.title), t -> t <> '')").alias("breadcrumb"),
        "section_id",
        F.expr("IF(block_type = 'HEADING', text, try_element_at(filter(path, x -> x.level IS NOT NULL), -1).title)")
        .alias("section_title"),
    )


ROOT_TYPES = "('HEADING', 'HEADER', 'FOOTER', 'PAGE_NUMBER')"


def validate(h: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Per document: orphans, heading jumps, depth, roots and the consistency score.

    ``cycles`` (doc_id, n) counts blocks on parent cycles when the links come from
    elsewhere; links built here are acyclic by construction.
    """
    jump = (
        "block_type = 'HEADING' AND try_element_at(path, -1).level IS NOT NULL "
        "AND heading_level > try_element_at(path, -1).level + 1"
    )
    agg = h.groupBy("doc_id").agg(
        F.count("*").alias("blocks"),
        F.expr("count_if(block_type = 'HEADING')").alias("headings"),
        F.expr(f"count_if(parent_block_id IS NULL AND block_type NOT IN {ROOT_TYPES})").alias("_loose"),
        F.expr("count_if(parent_block_id IS NULL AND block_type = 'CAPTION')").alias("_loose_captions"),
        F.expr(f"count_if({jump})").alias("heading_jumps"),
        F.expr("count_if(parent_block_id IS NULL)").alias("root_count"),
        F.max("depth").alias("max_depth"),
    )
    if cycles is not None:
        agg = agg.join(cycles.select("doc_id", F.col("n").alias("_c")), "doc_id", "left")
    else:
        agg = agg.withColumn("_c", F.lit(0).cast("long"))
    return agg.withColumns(
        {
            "orphan_count": F.expr("IF(headings > 0, _loose, 0L) + _loose_captions"),
            "cycle_detected": F.expr("coalesce(_c, 0L) > 0"),
        }
    ).withColumn("warning_count", F.expr("orphan_count + heading_jumps + coalesce(_c, 0L)")).withColumn(
        "consistency_score", F.expr("1D - least(1D, warning_count / blocks)")
    ).drop("_loose", "_loose_captions", "_c")
