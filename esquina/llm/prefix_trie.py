"""Conversation prefix trie: a z-fast trie over the turns of rebuilt conversations.

Only branching points, ends and the root are nodes; the turns between two nodes are the lower one's edge. A prefix is
named by a key of 128 bits (a running hash of position, role and text), so a node is found by joining on a key. Each
node is hashed under its handle: the prefix whose depth is the two-fattest number (most trailing zero bits) of its
edge. A conversation finds its exit node by fat binary search: each step halves the depths that are left and is one
join with the handles. Conversations are inserted in batches that grow: what a batch shares with the trie is only
located, edges are split where its conversations leave them, and the rest is grouped into new edges. Sums over
subtrees are taken by doubling the distance to an ancestor, and edges are expanded to one row per depth at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from esquina.operators.stage import settle

# Conversations whose id is divisible by this lend their first turns, at most one less than SHARES, to those after them.
FAMILY, SHARES = 100, 6
# Of 32 parts of the distinct conversations, where the batches end.
PARTS, BATCH_ENDS = 32, (1, 8, 32)
# Ids of one list that are put into one text at a time, by range of id.
IDS_SHIFT = 10
STEP = "struct<depth: int, k1: long, k2: long, chars: long>"
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = ["k1", "k2", "depth", "chars", "p1", "p2", "parent_depth", "parent_chars", "edge"]


@dataclass
class Trie:
    """``paths``: prefix keys per conversation; ``classes``: one row per distinct one; ``nodes``: the compacted trie."""

    paths: DataFrame
    classes: DataFrame
    nodes: DataFrame


def own_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, role, digest, chars``: turns in order, ties by role and digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return flat.withColumn("pos", F.row_number().over(in_order)).drop("turn")


def rebuilt_turns(own: DataFrame) -> DataFrame:
    """``conv_id, part, pos, role, digest, chars``: a mark, the turns taken from the family's first, then its own."""
    shares = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARES)).cast("int")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    turn = ["role", "digest", "chars"]
    marks = own.filter("pos = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in zip(turn, ("string", "string", "long"))])
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARES)).select(F.col("conv_id").alias("family"), "pos", *turn)
    taken = (
        marks.select("conv_id", family.alias("family"), shares.alias("n")).filter("n > 0")
        .join(heads, "family").filter("pos <= n").select("conv_id", F.lit(1).alias("part"), "pos", *turn)
    )
    rest = own.filter(F.col("pos") > shares).select("conv_id", F.lit(2).alias("part"), "pos", *turn)
    return marks.unionByName(taken).unionByName(rest)


def prefix_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: key and length of every prefix, the empty one first."""
    w = Window.partitionBy("conv_id").orderBy("part", "pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("depth", F.row_number().over(w) - 1)
    keys = {
        f"k{i}": F.bit_xor(F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "role", "digest")).otherwise(F.lit(0))).over(so_far)
        for i in (1, 2)
    }
    steps = numbered.withColumns(keys).withColumn("so_far", F.coalesce(F.sum("chars").over(so_far), F.lit(0)))
    step = F.struct("depth", "k1", "k2", F.col("so_far").alias("chars"))
    return steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).cast(f"array<{STEP}>").alias("path"))


def end_of(path: str) -> Column:
    return F.element_at(path, -1)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One row per distinct path: ``k1, k2, members, cid`` (the least member) and the path."""
    last = paths.select("conv_id", "path", end_of("path").alias("e")).select("conv_id", "path", "e.k1", "e.k2")
    return last.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("cid"), F.first("path").alias("path"))


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


def root(classes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    at = F.struct(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"))
    columns = [zero, zero, F.lit(0), zero, none, none, F.lit(-1), zero, F.array(at)]
    return classes.sparkSession.range(1).select(*[c.alias(n) for c, n in zip(columns, NODE)])


def handles(nodes: DataFrame) -> DataFrame:
    """Nodes under the key of their two-fattest depth."""
    fat = two_fattest("parent_depth", "depth")
    at = F.get("edge", fat - F.col("parent_depth") - 1)
    inner = nodes.filter("depth > 0").withColumn("at", at)
    return inner.select(F.col("at.k1").alias("h1"), F.col("at.k2").alias("h2"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("depth").alias("n_depth"), F.col("parent_depth").alias("n_above"))


def locate(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cid, path, a``: depth of the deepest node that begins each pattern (``cid, path``), by fat binary search."""
    table = settle(handles(nodes), "trie-handles")
    active = patterns.select("cid", "path", F.lit(0).alias("a"), (F.size("path") - 1).alias("b"))
    found: list[DataFrame] = []
    while True:
        probe = active.withColumn("f", two_fattest("a", "b")).withColumn("at", F.get("path", F.col("f")))
        met = probe.join(table, (F.col("at.k1") == F.col("h1")) & (F.col("at.k2") == F.col("h2")), "left")
        extent = F.get("path", F.col("n_depth"))
        whole = F.coalesce((extent["k1"] == F.col("n1")) & (extent["k2"] == F.col("n2")), F.lit(False))
        low = F.when(F.col("n_depth").isNull(), F.col("a")).when(whole, F.col("n_depth")).otherwise(F.col("n_above"))
        high = F.when(F.col("n_depth").isNull(), F.col("f") - 1).when(whole, F.col("b")).otherwise(F.col("n_above"))
        searched = met.filter("a < b").select("cid", "path", low.alias("a"), high.alias("b"))
        over = active.filter("a >= b").select("cid", "path", "a", "b")
        now = settle(searched.unionByName(over) if not found else searched, "trie-search")
        found.append(now.filter("a >= b").select("cid", "path", "a"))
        active = now.filter("a < b")
        if active.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exits(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cid, path, shared, v1, v2``: turns that a pattern shares with the trie, and the node whose edge it leaves or ends in."""
    at = locate(patterns, nodes)
    none = F.lit(None).cast("long")
    whole = at.filter(F.col("a") == F.size("path") - 1).select("cid", "path", F.col("a").alias("shared"), none.alias("v1"), none.alias("v2"))
    below = nodes.filter("depth > 0").select(
        F.get("edge", F.lit(0)).getField("k1").alias("f1"), F.get("edge", F.lit(0)).getField("k2").alias("f2"),
        F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("depth").alias("n_depth"), F.col("edge").alias("n_edge"),
    )
    going = at.filter(F.col("a") < F.size("path") - 1).withColumn("next", F.get("path", F.col("a") + 1))
    met = going.join(below, (F.col("next.k1") == F.col("f1")) & (F.col("next.k2") == F.col("f2")), "left")
    same = F.expr(
        "size(filter(sequence(1, least(size(path) - 1, n_depth) - a),"
        " i -> path[a + i].k1 = n_edge[i - 1].k1 AND path[a + i].k2 = n_edge[i - 1].k2))"
    )
    left = met.withColumn("shared", F.col("a") + F.when(F.col("n_depth").isNull(), F.lit(0)).otherwise(same))
    inside = F.col("shared") < F.col("n_depth")
    return whole.unionByName(left.select("cid", "path", "shared", F.when(inside, F.col("n1")).alias("v1"), F.when(inside, F.col("n2")).alias("v2")))


def split_edges(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """The nodes, and new ones where a pattern leaves an edge or ends in it."""
    cuts = left.filter("v1 IS NOT NULL").groupBy(F.col("v1").alias("k1"), F.col("v2").alias("k2")).agg(F.collect_set("shared").alias("cuts"))
    cut = nodes.join(cuts, ["k1", "k2"], "left").withColumn("bounds", F.expr("concat(coalesce(array_sort(cuts), array()), array(depth))"))
    pieces = cut.select("*", F.posexplode("bounds").alias("at", "hi")).withColumn("lo", F.when(F.col("at") == 0, F.col("parent_depth")).otherwise(F.get("bounds", F.col("at") - 1)))
    edge = F.expr("slice(edge, lo - parent_depth + 1, hi - lo)")
    above = F.get("edge", F.col("lo") - F.col("parent_depth") - 1)
    first = F.col("at") == 0
    last = F.element_at("piece", -1)
    return pieces.withColumn("piece", edge).withColumn("above", F.when(~first, above)).select(
        last["k1"].alias("k1"), last["k2"].alias("k2"), last["depth"].alias("depth"), last["chars"].alias("chars"),
        F.when(first, F.col("p1")).otherwise(F.col("above.k1")).alias("p1"),
        F.when(first, F.col("p2")).otherwise(F.col("above.k2")).alias("p2"),
        F.col("lo").alias("parent_depth"),
        F.when(first, F.col("parent_chars")).otherwise(F.col("above.chars")).alias("parent_chars"),
        F.col("piece").alias("edge"),
    )


def new_edges(left: DataFrame) -> DataFrame:
    """Nodes for what the patterns have beyond the trie: ends and branching points, each with the edge above it."""
    steps = F.expr(
        "transform(sequence(shared + 1, size(path) - 1), i -> struct(path[i] AS e, path[i - 1] AS above, get(path, i + 1) AS next))"
    )
    rows = left.filter(F.col("shared") < F.size("path") - 1).select("cid", F.inline(steps))
    # Prefixes with the same conversations below them have the same least one, so a new edge belongs to one path.
    grouped = rows.groupBy(F.col("e.k1").alias("k1"), F.col("e.k2").alias("k2")).agg(
        F.min("e.depth").alias("depth"), F.min("e.chars").alias("chars"), F.min("cid").alias("owner"),
        F.min("above.k1").alias("a1"), F.min("above.k2").alias("a2"), F.min("above.chars").alias("a_chars"),
        F.max(F.col("next").isNull()).alias("ends"),
        ((F.min("next.k1") != F.max("next.k1")) | (F.min("next.k2") != F.max("next.k2"))).alias("branches"),
    )
    upward = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    is_node = F.col("ends") | F.coalesce("branches", F.lit(False))
    numbered = grouped.withColumn("segment", F.sum(is_node.cast("int")).over(upward))
    edges = numbered.groupBy("owner", "segment").agg(
        F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "chars"))).cast(f"array<{STEP}>").alias("edge"),
        F.min(F.struct("depth", "a1", "a2", "a_chars")).alias("top"),
    )
    last = F.element_at("edge", -1)
    return edges.select(
        last["k1"].alias("k1"), last["k2"].alias("k2"), last["depth"].alias("depth"), last["chars"].alias("chars"),
        F.col("top.a1").alias("p1"), F.col("top.a2").alias("p2"), (F.col("top.depth") - 1).alias("parent_depth"),
        F.col("top.a_chars").alias("parent_chars"), "edge",
    )


def insert(nodes: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The trie with the patterns of a batch (``cid, path``) put in; ``None`` is the empty trie."""
    if nodes is None:
        none = F.lit(None).cast("long")
        left = batch.select("cid", "path", F.lit(0).alias("shared"), none.alias("v1"), none.alias("v2"))
        return settle(root(batch).unionByName(new_edges(left)), "trie")
    left = settle(exits(batch, nodes), "trie-exits")
    return settle(split_edges(nodes, left).unionByName(new_edges(left)), "trie")


def build(conversations: DataFrame) -> Trie:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text)."""
    own = settle(own_turns(conversations), "turns")
    paths = settle(prefix_paths(rebuilt_turns(own)), "prefix-paths")
    classes = settle(distinct_paths(paths), "distinct-paths")
    part = F.pmod(F.xxhash64("cid"), F.lit(PARTS))
    nodes, begin = None, 0
    for end in BATCH_ENDS:
        nodes = insert(nodes, classes.filter((part >= begin) & (part < end)).select("cid", "path"))
        begin = end
    return Trie(paths, classes, nodes)


SUMS = ["n", "conv", "total", "owned", "leaves"]


def subtree_sums(trie: Trie) -> DataFrame:
    """Per node: conversations below, the least, their lengths, lengths of all edges below, and leaves.

    In round i a node holds the sums of what lies less than 2^i edges below it and adds those of the nodes at
    exactly that distance, so the rounds grow with the logarithm of the trie's height.
    """
    ends = trie.classes.select("k1", "k2", "members", "cid")
    branching = trie.nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    current = settle(
        trie.nodes.join(ends, ["k1", "k2"], "left").join(branching, ["k1", "k2"], "left").select(
            "k1", "k2", F.col("p1").alias("j1"), F.col("p2").alias("j2"),
            F.coalesce("children", F.lit(0)).alias("children"),
            F.coalesce("members", F.lit(0)).alias("n"), F.col("cid").alias("conv"),
            (F.coalesce("members", F.lit(0)) * F.col("chars")).alias("total"),
            (F.col("chars") - F.col("parent_chars")).alias("owned"),
            F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ),
        "trie-sums",
    )
    while not current.filter("j1 IS NOT NULL").isEmpty():
        added = current.filter("j1 IS NOT NULL").groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(
            *[(F.min if c == "conv" else F.sum)(c).alias(f"add_{c}") for c in SUMS]
        )
        summed = current.join(added, ["k1", "k2"], "left").select(
            "k1", "k2", "j1", "j2", "children",
            *[(F.least(c, f"add_{c}") if c == "conv" else F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in SUMS],
        )
        jumps = current.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("to1"), F.col("j2").alias("to2"))
        to_root = (F.col("j1") == 0) & (F.col("j2") == 0)
        more = summed.filter(~to_root).join(jumps, ["j1", "j2"]).select("k1", "k2", F.col("to1").alias("j1"), F.col("to2").alias("j2"), "children", *SUMS)
        none = F.lit(None).cast("long")
        over = summed.filter(to_root | F.col("j1").isNull()).withColumn("j1", none).withColumn("j2", none).select(*more.columns)
        current = settle(more.unionByName(over), "trie-sums")
    return current.drop("j1", "j2")


def list_digests(paths: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: of the ascending ids of the conversations that end at a node.

    Ids are joined to texts by range first. The digest of one list is sequential by its definition, so the texts of
    one node pass through one task, as a stream: nothing but the state of the hash is held.
    """
    ends = paths.select("conv_id", end_of("path").alias("e")).select("e.k1", "e.k2", "conv_id", F.shiftright("conv_id", IDS_SHIFT).alias("chunk"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ends.groupBy("k1", "k2", "chunk").agg(F.array_join(ids, ",").alias("ids"))
    names = ["k1", "k2", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) != key:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names)

    streamed = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return streamed.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def node_rows(trie: Trie) -> DataFrame:
    """Every prefix of a rebuilt conversation with its figures; edges are expanded to one row per depth."""
    sums = settle(subtree_sums(trie), "trie-totals")
    convs = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"))
    known = trie.nodes.join(sums, ["k1", "k2"]).join(convs, ["p1", "p2"], "left").join(list_digests(trie.paths), ["k1", "k2"], "left")
    before = F.expr("IF(at = 0, parent_chars, get(edge, at - 1).chars)")
    last = F.col("at") == F.size("edge") - 1
    rows = known.select("*", F.posexplode("edge").alias("at", "e")).withColumn("before", before)
    saved = F.col("total") - F.col("n") * F.col("before") - (F.col("chars") - F.col("before")) - (F.col("owned") - (F.col("chars") - F.col("parent_chars")))
    return rows.filter("n > 0").select(
        F.col("conv").alias("conv_id"),
        F.col("e.depth").cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_IDS))).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    Turns are ordered by ``turn``, null first, then role, then digest of the text; equal rows are turns of their own.
    Null role or text is empty. Rows without ``conv_id`` take no part, other columns neither; an empty table has
    no prefix, not even the empty one. The prefix keys of one conversation (28 bytes a turn) travel in one row, as its
    turns are one sequence; groups of conversations never do.
    """
    return node_rows(build(conversations))
