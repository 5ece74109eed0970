"""The trie of conversation prefixes: every prefix that some conversation starts with is one node.

All prefixes are aggregated together by ROLLUP over positional turn-id columns. A conversation is cut in
blocks of WIDTH turns, a row each. ROLLUP over a block's columns gives a group for each of its prefixes, and
the number of columns that take part in a group (from grouping_id) is the depth of its node within the block.
A longer conversation goes on in further rows of the same columns, keyed by the node where its block before
ends, so one aggregation serves blocks at all depths and no step waits for the one above it.

A node's name is a pair of 64-bit sums (exclusive or) over hashes of its turns and their places, so a block
can name the nodes before and inside it without those before it being aggregated.

Sums over subtrees need no walk: a node's smallest member holds what the node adds, so what its subtree adds
is a sum over its members, which a second ROLLUP takes, less what its smallest member holds above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import crc, placed
from .shared import partitions, written

#: Turn columns of a block.
WIDTH = 8
#: How many of a shared conversation's first turns another one takes at most.
MOST_LENT = 5
COLUMNS = [f"t{k}" for k in range(1, WIDTH + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """A turn's digest and the code points of its text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.length(text).cast("string"))


def _name(place: Column, turn: Column) -> list[Column]:
    """The two hashes that a turn at a depth adds to the names of its node and those below; 0 where there is no turn."""
    return [F.coalesce(F.when(turn.isNotNull(), F.xxhash64(place, F.substring(turn, start, 16))), F.lit(0).cast("long")) for start in (1, 17)]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, id) of conversations that start like the first one of their hundred, and all conv_ids.

    Conversation c has the first h turns of conversation c - c % 100 (all if it has fewer, none if there is
    no such conversation), then its own turns after its first h; h is the unsigned CRC-32 of its decimal
    conv_id modulo 6. Turns are ordered by turn (nulls first), ties by their digests.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"))
    rows = placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("id")])
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (crc(F.col("conv_id").cast("string")) % 6).alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "h", "taken")
    own = rows.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "id")
    heads = rows.where(F.col("pos") <= MOST_LENT).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "id")
    lent = heads.join(plan, "base").where("d <= h").select("conv_id", "d", "id")
    return own.unionByName(lent), plan.select("conv_id")


def blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, block, one, two, t1 ..., ends, end_one, end_two): a row for each WIDTH turns of (conv_id, d, id).

    ``one`` and ``two`` name the node where the block before ends; ``ends`` says that the conversation ends in
    the block, at the node that ``end_one`` and ``end_two`` name. A conversation without turns has one block.
    """
    at = (F.col("d") - 1) % WIDTH
    one, two = _name(F.col("d"), F.col("id"))
    pivoted = [F.max(F.when(at == k, F.col("id"))).alias(c) for k, c in enumerate(COLUMNS)]
    rows = turns.groupBy("conv_id", F.floor((F.col("d") - 1) / WIDTH).alias("block")).agg(*pivoted, F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy("block")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"one": F.coalesce(F.bit_xor("x1").over(before), none), "two": F.coalesce(F.bit_xor("x2").over(before), none), "ends": F.lead("block").over(after).isNull()})
    every = conversations.join(rows, "conv_id", "left")
    named = {c: F.coalesce(c, none) for c in ("block", "one", "two", "x1", "x2")} | {"ends": F.coalesce("ends", F.lit(True))}
    every = every.withColumns(named)
    return every.select("conv_id", "block", "one", "two", *COLUMNS, "ends", F.col("one").bitwiseXOR(F.col("x1")).alias("end_one"), F.col("two").bitwiseXOR(F.col("x2")).alias("end_two"))


def rolled(rows: DataFrame, sums: str) -> DataFrame:
    """(one, two, depth, up_one, up_two, conv_id, n_convs, chars, <sums>): a row for each node of ``blocks``.

    ``up_one`` and ``up_two`` name the parent, ``chars`` are the code points of the node's last text.
    """
    columns = ", ".join(COLUMNS)
    groups = rows.sparkSession.sql(
        f"""SELECT block, one, two, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id, count(*) AS n_convs, {sums}
            FROM {{rows}} GROUP BY block, one, two, ROLLUP({columns})""",
        rows=rows,
    )
    last = F.when(F.col("level") > 0, F.element_at(F.array(*COLUMNS), F.greatest(F.col("level"), F.lit(1))))
    nodes = groups.withColumn("last", last).where("last is not null or (level = 0 and block = 0)")
    place = lambda k: F.col("block") * WIDTH + k
    made = {}
    for i, c in enumerate(("one", "two")):
        name = F.col(c)
        for k, t in enumerate(COLUMNS, 1):
            name = name.bitwiseXOR(_name(place(k), F.col(t))[i])
        made[c] = name
        made[f"up_{c}"] = name.bitwiseXOR(_name(place(F.col("level")), F.col("last"))[i])
    kept = [c for c in groups.columns if c not in ("block", "one", "two", "level", *COLUMNS)]
    return nodes.select(*[v.alias(k) for k, v in made.items()], place(F.col("level")).alias("depth"), F.coalesce(F.substring("last", 33, 20).cast("long"), F.lit(0)).alias("chars"), *kept)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after the other; what is held is one hash in the making."""
    names, schema = ("one", "two", "depth"), pa.schema([("one", pa.int64()), ("two", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])
    now, digest = None, None
    for batch in batches:
        done = []
        rows = batch.to_pydict()
        for one, two, depth, piece in zip(*(rows[n] for n in names), rows["piece"], strict=True):
            if (one, two, depth) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (one, two, depth), hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, digest.hexdigest()), schema, strict=True)], schema=schema)


def end_hashes(ends: DataFrame, per_piece: int = 14) -> DataFrame:
    """(one, two, depth, sha): SHA-256 of the ascending decimal conv_ids, joined by commas, of each node's rows.

    Ids go into pieces of 2 ** ``per_piece`` consecutive numbers first, so a node where very many
    conversations end is that much shorter when its pieces meet; they are hashed one by one.
    """
    pieces = ends.groupBy("one", "two", "depth", F.shiftright("conv_id", per_piece).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    line = pieces.repartition(partitions(ends.sparkSession), "one", "two").sortWithinPartitions("one", "two", "depth", "part")
    return line.select("one", "two", "depth", "piece").mapInArrow(_hashed, "one long, two long, depth long, sha string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv_id, d, id), d from 1 without gaps; ``conversations`` has all conv_ids.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree, code points of a node's last text for each member but one) and
    ends_sha256 (of the members that end here). The root has depth 0 and no parent; without conversations
    there is no node.
    """
    rows = written(blocks(turns, conversations), "blocks")
    nodes = written(rolled(rows, "count_if(ends) AS ending"), "nodes")
    key, up = ["one", "two", "depth"], [F.col("up_one"), F.col("up_two"), F.col("depth") - 1]
    children = nodes.where("depth > 0").groupBy(*[c.alias(n) for c, n in zip(up, key, strict=True)]).agg(F.count("*").alias("n_children"))
    valued = nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("chars")).join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # nodes with one smallest member lie on one path
    valued = valued.withColumn("held_above", F.coalesce(F.sum("value").over(above), F.lit(0)))
    held = valued.groupBy("conv_id").agg(F.sum("value").alias("held"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    again = rolled(rows.join(held, "conv_id", "left"), "coalesce(sum(held), 0) AS held, coalesce(sum(leaf), 0) AS n_leaves").select(*key, "held", "n_leaves")
    # a row that ends in a block ends at its last node
    place = F.col("block") * WIDTH + F.size(F.filter(F.array(*COLUMNS), lambda t: t.isNotNull()))
    ends = end_hashes(rows.where("ends").select(F.col("end_one").alias("one"), F.col("end_two").alias("two"), place.cast("long").alias("depth"), "conv_id"))
    parents = nodes.select(F.col("one").alias("up_one"), F.col("two").alias("up_two"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = valued.join(again, key).join(ends, key, "left").join(parents, ["up_one", "up_two", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("held") - F.col("held_above")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt ``conversations`` (conv_id, turn, role, text); see ``rebuilt`` and ``trie``.

    A null role or text is empty; rows without conv_id belong to no conversation and are left out; repeated rows
    are turns of their own; other columns, whatever their names, are left out. An empty table gives no row.
    """
    turns, every = rebuilt(conversations)
    return trie(turns, every)
