"""Prefix trie of conversations, with rollups by pointer jumping.

A turn's digest and place give two 64-bit values; the exclusive or of those of
the first d turns is the key of a depth-d node, so keys of all prefixes come from
running aggregates, in any number of steps. A turn's parent edge takes its own
values out again. Leaf counts and savings then climb by doubling: in round k a
node hands its sums to the ancestor 2^k levels up, sums for one ancestor are put
together before the shuffle, and every pointer is replaced by its target's own.
The number of rounds is the logarithm of the greatest depth.

Rows are ordered by range partitioning on (conversation, place), so a conversation
with most of the turns lies over many blocks; what crosses a block's edge is at
most one conversation for each block, and is broadcast.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, table

#: Heavy nodes at most, whose pointers are broadcast, since each has over 2 / HEAVY_NODES of all edges; with up to LIGHT edges a node is never heavy.
HEAVY_NODES, LIGHT = 50_000, 256
#: Identifiers that are joined into one piece of text before the digest of a node's conversations is taken.
PIECE = 4096


def ranked_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns in their order, and the pieces of conversations that they lie in.

    First (conv, block, pos from 1, digest, chars) for each row, then (conv, block,
    n) for each block of a conversation. Null turns come first, equal ones in the
    order of their digests; rows without an identifier are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    # The last key parts equal rows, whose order makes no difference.
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", F.col("turn").asc_nulls_first(), "digest", "tie").withColumn("block", F.spark_partition_id())
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "digest", "tie")
    rows = durable(rows.select("conv", "block", F.row_number().over(order).cast("long").alias("local"), "digest", "chars"))
    pieces = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One row at most for each block: only its first conversation can have begun before it.
    moved = pieces.select("conv", "block", before.alias("before")).where("before > 0")
    return rows.join(F.broadcast(moved), ["conv", "block"], "left").select("conv", "block", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "chars"), pieces


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred: crc32 of its decimal identifier modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of c - c % 100, h = `shared_turns`.

    Returns turns (conv, depth from 1, digest, chars) and conversations (conv),
    turnless ones too.
    """
    rows, pieces = ranked_turns(conversations)
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", shared_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % 100)
    found = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(found, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    # Joined by block as well, since a conversation may have most of the rows.
    own = rows.join(pieces.join(convs, "conv").select("conv", "block", "h", "taken"), ["conv", "block"]).where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    heads = rows.where("conv % 100 = 0 AND pos < 6").select(F.col("conv").alias("base"), "pos", "digest", "chars")
    lead = convs.where("taken > 0").join(heads, "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "digest", "chars")
    return own.unionByName(lead), convs.select("conv")


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (a, b) of all prefixes with those of their parents (pa, pb), and the key of each conversation's longest."""
    value = lambda seed: F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest"))
    ranged = turns.repartitionByRange("conv", "depth").select("conv", "depth", "chars", value(1).alias("za"), value(2).alias("zb"), F.spark_partition_id().alias("block"))
    so_far = Window.partitionBy("conv", "block").orderBy("depth")
    local = durable(ranged.select("conv", "block", "depth", "chars", "za", "zb", F.bit_xor("za").over(so_far).alias("la"), F.bit_xor("zb").over(so_far).alias("lb")))
    last = local.groupBy("conv", "block").agg(F.max(F.struct("depth", "la", "lb")).alias("last")).select("conv", "block", "last.la", "last.lb")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("conv", "block", "la", "lb", F.bit_xor("la").over(before).alias("ca"), F.bit_xor("lb").over(before).alias("cb"))
    a, b = (F.col(f"l{x}").bitwiseXOR(F.coalesce(f"c{x}", F.lit(0))) for x in "ab")
    # One row at most for each block.
    nodes = local.join(F.broadcast(last.where("ca IS NOT NULL").select("conv", "block", "ca", "cb")), ["conv", "block"], "left").select("conv", "depth", "chars", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("za")).alias("pa"), b.bitwiseXOR(F.col("zb")).alias("pb"))
    ends = last.groupBy("conv").agg(F.max(F.struct(F.col("block"), a.alias("a"), b.alias("b"))).alias("end")).select("conv", "end.a", "end.b")
    return nodes, ends


def _pieces(batches):
    """Sorted (a, b, conv) as joined identifiers: (a, b, first, ids), PIECE identifiers each at most."""
    key, ids = None, []

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        rows = []
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b) != key or len(ids) == PIECE:
                if ids:
                    rows.append({"a": key[0], "b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))})
                key, ids = (a, b), []
            ids.append(c)
        yield out(rows)
    if ids:
        yield out([{"a": key[0], "b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}])


def _digests(batches):
    """Sorted (a, b, first, ids) as (a, b, sha): SHA-256 of each node's identifiers, piece by piece."""
    key, h = None, None

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())]))

    for batch in batches:
        rows = []
        for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b) != key:
                if h is not None:
                    rows.append({"a": key[0], "b": key[1], "sha": h.hexdigest()})
                key, h = (a, b), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield out(rows)
    if h is not None:
        yield out([{"a": key[0], "b": key[1], "sha": h.hexdigest()}])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of the conversations that end in a node. A digest needs its text in order; thousands of identifiers come as one row."""
    ranged = ends.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    joined = ranged.mapInArrow(_pieces, "a long, b long, first long, ids string")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, sha string")


def _jump(state: DataFrame, total: int) -> DataFrame:
    """One round: sums go to the nodes that are pointed at, pointers to what their targets point at.

    `state` has a, b, pa, pb, leaves, saved and conv. A target of many pointers is
    one of a bounded number of heavy nodes, whose rows are broadcast; a row
    without a pointer, or with a heavy one, joins under its own key, so that these
    rows aren't one group. Also gives up_conv, the target's conv.
    """
    sums = state.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("m"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    target = state.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("pa").alias("ga"), F.col("pb").alias("gb"), F.col("conv").alias("up"))
    heavy = sums.where(F.col("m") > max(LIGHT, 2 * total // HEAVY_NODES)).select("a", "b").join(state.select("a", "b", F.col("pa").alias("ha"), F.col("pb").alias("hb"), F.col("conv").alias("hup")), ["a", "b"])
    heavy = heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "ha", "hb", "hup")
    grown = state.join(sums, ["a", "b"], "left").join(F.broadcast(heavy), ["pa", "pb"], "left")
    light = F.col("pa").isNotNull() & F.col("hup").isNull()
    grown = grown.withColumn("ka", F.when(light, F.col("pa")).otherwise(F.col("a"))).withColumn("kb", F.when(light, F.col("pb")).otherwise(F.col("b")))
    keep = [c for c in state.columns if c not in ("a", "b", "pa", "pb", "leaves", "saved")]
    return grown.join(target, ["ka", "kb"], "left").select(
        "a", "b", F.when(light, F.col("ga")).otherwise(F.col("ha")).alias("pa"), F.when(light, F.col("gb")).otherwise(F.col("hb")).alias("pb"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.when(light, F.col("up")).otherwise(F.col("hup")).alias("up_conv"), *keep,
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of all prefixes of ordered turns.

    `turns` has conv (not null), depth (1, 2, ... without gaps in each), digest
    and chars; `convs` has every conv once, turnless ones too. Returns one row per
    node, the root (depth 0) included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Without conversations there is no root either.
    """
    prefixes, ends = _prefixes(turns)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    every = prefixes.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("chars"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb")))
    nodes = every.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars"))
    nodes = durable(nodes)
    children = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    state = nodes.join(children, ["a", "b"], "left").select(
        "a", "b", "pa", "pb", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        "conv", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
    )
    deepest, total = nodes.agg(F.max("depth"), F.count("*")).first()
    state = durable(_jump(state, total)).withColumnRenamed("up_conv", "parent_conv_id")
    reach = 2
    while reach <= (deepest or 0):
        state = durable(_jump(state, total).drop("up_conv"))
        reach *= 2
    turnless = convs.join(turns.select("conv").distinct(), "conv", "left_anti").select("conv", zero.alias("a"), zero.alias("b"))
    shas = _end_digests(ends.unionByName(turnless))
    out = state.join(shas, ["a", "b"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """`prefix_trie` of the rebuilt `conversations` (conv_id, turn, role, text).

    Null roles and texts count as empty. Null turns come first; rows of one turn
    are ordered by the SHA-256 of `<code points of the role>:<role><text>`, and
    equal rows are turns each. Rows without conv_id belong to no conversation. An
    empty table has no nodes. Other columns are not looked at. Of a long text
    only the digest and the length leave the scan. A conversation may have any
    share of the rows. SHA-256 takes a node's identifiers one after the other:
    those of a node in which most conversations end are one task's, in pieces of
    4096.
    """
    turns, convs = rebuilt_turns(conversations)
    return prefix_trie(durable(turns), durable(convs))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt `conversations`."""
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


#: SQL has no crc32, so it is worked out from a byte table.
ORACLE_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, count(*) AS n, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: unicode(d)::BIGINT) AS bs FROM o GROUP BY 1),
hs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(bs, lambda s, b: xor(s // 256, t[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) % 6 AS h FROM cs, crc),
tk AS (SELECT hs.c, base, h, least(h, coalesce(n, 0)) AS taken FROM hs LEFT JOIN cs ON cs.c = base),
m AS (SELECT tk.c, p AS d, r, x FROM tk JOIN o ON o.c = base AND p <= h UNION ALL SELECT tk.c, p - h + taken, r, x FROM tk JOIN o ON o.c = tk.c AND p > h),
k AS (SELECT c, d, length(x) AS len, string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS key FROM m UNION ALL SELECT c, 0, 0, '' FROM tk),
e AS (SELECT c, max(d) AS last FROM k GROUP BY 1),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(len) AS len, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '') AS ends FROM k JOIN e USING (c) GROUP BY 1, 2),
up AS (SELECT n.key, p.key AS parent FROM n JOIN k p ON p.c = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY 1),
s AS (SELECT a.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, CAST(sum((u.n_convs - 1) * u.len) AS BIGINT) AS saved_tokens FROM n u LEFT JOIN kids ON kids.key = u.key JOIN k a ON a.c = u.conv_id AND a.d <= u.d GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN up ON up.key = n.key LEFT JOIN n p ON p.key = up.parent
"""
