"""Prefix trie of conversations by ROLLUP.

A conversation is a row of turn ids at their positions, and ROLLUP over these columns counts all its prefixes at once;
grouping_id tells how long a prefix is. Conversations of more turns than there are columns go on in further blocks of
columns, each keyed by the node that the blocks before it end in. These nodes are found in the same way, with whole blocks
in the place of turns (and blocks of blocks, of longer conversations), so that rounds grow with the logarithm of the
longest conversation only. A node is known by its depth and the least id of its members, as each conversation has one
prefix of each length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.store import scope, written

#: Turn-id columns of a block.
WIDTH = 8
#: Ids of ended conversations that are joined to one text (by ranges of ids of this size), and blocks of a conversation whose sums share a window.
ENDS_TOGETHER, BLOCKS_TOGETHER = 4096, 1024
WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns by their place, as a written table: conv_id, pos (from 1), digest (SHA-256 of role and text), words.

    A conversation's turns are ordered by turn, null first, then by role and digest; null role and text are empty. Rows
    without a conversation id take no part. Repeated rows are repeated turns. All rows are sorted at once and numbered
    inside the sorted partitions, so that no task needs a whole conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("at"))
    keep: list[DataFrame] = []
    with scope(turns.sparkSession, keep):
        rows = written(rows, "turns").withColumn("part", F.shiftright("at", 33))
        per = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        per = written(per.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift")), "parts")
        out = written(rows.join(per.hint("merge"), ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "words"), "numbered")
        keep.append(out)
    return out


def _columns(width: int, letter: str = "t") -> list[str]:
    return [f"{letter}{k}" for k in range(1, width + 1)]


def _path(width: int) -> Column:
    """The ids that are there; they come before those that are not."""
    return F.array_compact(F.array(*_columns(width)))


def _blocks(rows: DataFrame, number: Column, values: dict[str, str], width: int) -> DataFrame:
    """conv_id, b and, for each of values (letter: column), the values of the block's rows in columns by their place. number: of a row in its conversation, from 0; a row of -1 stands for none."""
    at = F.pmod(number, F.lit(width))
    cells = [F.max(F.when((number >= 0) & (at == k), F.col(c))).alias(f"{letter}{k + 1}") for letter, c in values.items() for k in range(width)]
    return rows.groupBy("conv_id", F.floor(F.greatest(number, F.lit(0)) / width).alias("b")).agg(*cells)


def _rollup(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """All prefixes (path) of the blocks' columns by block and key, with measures."""
    ids = ", ".join(_columns(width))
    df = rows.sparkSession.sql(f"SELECT b, key, {ids}, grouping_id() AS rolled, min(conv_id) AS least, {measures} FROM {{rows}} GROUP BY b, key, ROLLUP ({ids})", rows=rows)
    df = df.withColumn("path", _path(width)).withColumn("level", F.size("path"))
    # a conversation that has ended leaves columns empty: these are not longer prefixes
    return df.where(F.col("rolled") == F.expr(f"shiftleft(1, {width} - level) - 1")).drop(*_columns(width), "rolled")


def _keyed(blocks: DataFrame, width: int) -> DataFrame:
    """blocks with key: the least member of the node that the blocks before end in, 0 for first blocks."""
    if blocks.where("b > 0").isEmpty():
        return blocks.withColumn("key", F.lit(0).cast("long"))
    ids = _columns(width)
    whole = blocks.where(F.col(ids[-1]).isNotNull())
    names = written(whole.groupBy(*ids).agg(F.count("*").alias("n")).drop("n").withColumn("id", F.monotonically_increasing_id()), "trie-names")
    upper = written(_blocks(whole.join(names.hint("merge"), ids).select("conv_id", "b", "id"), F.col("b"), {"t": "id"}, width), "trie-upper")
    upper = _keyed(upper, width)
    nodes = written(_rollup(upper, width, "count(*) AS n").where("level > 0").select("b", "key", "path", "least"), "trie-ends")
    path = _path(width)
    each = upper.select("conv_id", "b", "key", F.explode(F.sequence(F.lit(1), F.size(path))).alias("j"), path.alias("all"))
    each = each.select("conv_id", "b", "key", "j", F.slice("all", F.lit(1), F.col("j")).alias("path")).join(nodes.hint("merge"), ["b", "key", "path"])
    keys = written(each.select("conv_id", (F.col("b") * width + F.col("j")).alias("b"), F.col("least").alias("key")), "trie-keys")
    return written(blocks.join(keys, ["conv_id", "b"], "left").fillna(0, ["key"]), "trie-blocks")


def _later(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """For each conversation's block the sums of columns over its later blocks, as later_<column>; by stretches of blocks, whose sums are added up."""
    rows = rows.select("conv_id", "b", *columns, F.floor(F.col("b") / BLOCKS_TOGETHER).alias("stretch"))
    total = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    w = Window.partitionBy("conv_id").orderBy("stretch")
    sums = rows.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in columns]).select("conv_id", "stretch", *[total(c, w).alias(f"beyond_{c}") for c in columns])
    w = Window.partitionBy("conv_id", "stretch").orderBy("b")
    rows = rows.select("conv_id", "stretch", "b", *[total(c, w).alias(f"later_{c}") for c in columns]).join(sums, ["conv_id", "stretch"])
    return rows.select("conv_id", "b", *[(F.col(f"later_{c}") + F.col(f"beyond_{c}")).alias(f"later_{c}") for c in columns])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (least, depth, chunk, ids) in order: the SHA-256 of each node's ids, joined by commas, as they stream by."""
    schema = pa.schema([("least", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        out = []
        for least, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("least", "depth", "ids")), strict=True):
            if node != (least, depth):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (least, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=f.type) for k, f in enumerate(schema)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((*node, state.hexdigest()), schema, strict=True)], schema=schema)


def prefix_trie(rows: DataFrame, conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, pos, digest, words, as of numbered; each conversation's pos run from 1 without gaps. conversations: all
    conv_id, also of conversations without turns, whose only prefix is the root. Without conversations there are no rows.
    n_leaves and saved_tokens ((n_convs - 1) times the words of the last turn) are sums over the subtree, the node
    included; ends_sha256 is of the ids that end there, ascending, joined by commas. Hot prefixes, turns and groups of equal
    conversations are counted with map-side combining, and joins back to them can be split. Ids that end at one node are
    joined in ranges of ids, and the hash reads these one after the other.
    """
    spark = rows.sparkSession
    ids, words = _columns(width), _columns(width, "w")
    keep: list[DataFrame] = []
    with scope(spark, keep):
        names = written(rows.groupBy("digest").agg(F.count("*").alias("n")).drop("n").withColumn("id", F.monotonically_increasing_id()), "trie-turns")
        cells = rows.join(names.hint("merge"), "digest").select("conv_id", F.col("pos") - 1, "id", "words").toDF("conv_id", "number", "id", "words")
        none = conversations.select("conv_id", F.lit(-1).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")).toDF(*cells.columns)
        blocks = written(_blocks(cells.unionByName(none), F.col("number"), {"t": "id", "w": "words"}, width), "trie-blocks")
        blocks = _keyed(blocks, width)
        nodes = _rollup(blocks, width, "count(*) AS n_convs").where("level > 0 or b = 0").withColumn("depth", F.col("b") * width + F.col("level"))
        nodes = written(nodes, "trie-nodes")
        # parents: in the same block, or the node that keys it
        up = nodes.select("b", "key", F.col("path").alias("above"), F.col("least").alias("parent"))
        above = F.slice("path", F.lit(1), F.greatest(F.col("level") - 1, F.lit(0)))
        tree = nodes.where("depth > 0").withColumn("above", above).join(up.hint("merge"), ["b", "key", "above"], "left")
        tree = tree.withColumn("parent", F.when((F.col("level") == 1) & (F.col("b") > 0), F.col("key")).otherwise(F.col("parent")))
        root = nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
        tree = written(tree.drop("above").unionByName(root), "trie-tree")
        children = tree.where("depth > 0").groupBy(F.col("parent").alias("least"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        tree = tree.join(children, ["least", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        tree = written(tree.drop("path"), "trie-nodes")
        # what a node saves, and whether it is a leaf, is counted at its least member
        owned = [F.max(F.when(F.col("level") == k, F.col("n_convs"))).alias(f"n{k}") for k in range(1, width + 1)]
        owners = tree.groupBy(F.col("least").alias("conv_id"), "b").agg(*owned, F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        saves = [F.coalesce((F.col(f"n{k}") - 1) * F.col(f"w{k}"), F.lit(0)).alias(f"s{k}") for k in range(1, width + 1)]
        own = blocks.join(owners, ["conv_id", "b"], "left").select("conv_id", "b", "key", *ids, *saves, F.coalesce("leaf", F.lit(0)).alias("leaf"))
        own = written(own.withColumn("saved", sum((F.col(f"s{k}") for k in range(2, width + 1)), F.col("s1"))), "trie-owned")
        later = _later(own, ("saved", "leaf"))
        own = own.join(later, ["conv_id", "b"]).withColumn("leaves", F.col("leaf") + F.col("later_leaf"))
        sums = _rollup(own, width, ", ".join(["sum(leaves) AS n_leaves", "sum(later_saved) AS later", *(f"sum(s{k}) AS s{k}" for k in range(1, width + 1))]))
        saved = sum((F.when(F.col("level") <= k, F.col(f"s{k}")).otherwise(0) for k in range(1, width + 1)), F.col("later"))
        sums = sums.where("level > 0 or b = 0").select("least", (F.col("b") * width + F.col("level")).alias("depth"), "n_leaves", saved.alias("saved_tokens"))
        # conversations that end
        last = blocks.groupBy("conv_id").agg(F.max("b").alias("b"))
        ends = blocks.join(last, ["conv_id", "b"]).withColumn("path", _path(width)).withColumn("chunk", F.floor(F.col("conv_id") / ENDS_TOGETHER))
        ends = ends.groupBy("b", "key", "path", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
        ends = ends.join(nodes.select("b", "key", "path", "least", "depth").hint("merge"), ["b", "key", "path"]).select("least", "depth", "chunk", "ids")
        ends = ends.repartition("least", "depth").sortWithinPartitions("least", "depth", "chunk").mapInArrow(_hashed, "least long, depth long, ends_sha256 string")
        out = tree.join(sums, ["least", "depth"]).join(ends, ["least", "depth"], "left")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        out = written(
            out.select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")),
            "trie",
        )
        keep.append(out)
    return out


def of_conversations(turns: DataFrame, width: int = WIDTH, **columns: str) -> DataFrame:
    """prefix_trie of a table of turns as they are; columns: names, as for numbered."""
    rows = numbered(turns, **columns)
    return prefix_trie(rows, rows.select("conv_id").distinct(), width)


def with_heads(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """rows (as of numbered) of conversations that begin with turns of another: conversation c with the first h turns of c - c % every (all if fewer, none if absent), then its own after its first h; h is crc32 of c in decimal, modulo most. A head is asked for by fewer than every conversations."""
    ids = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    ids = ids.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("head"))
    tops = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("head"), "pos", "digest", "words")
    begin = ids.where("h > 0").join(tops, "head").where("pos <= h").select("conv_id", "pos", "digest", "words")
    have = ids.join(ids.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head")), "head", "left").select("conv_id", "h", F.least("h", F.coalesce("n_head", F.lit(0))).alias("got"))
    own = rows.join(have.hint("merge"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "words")
    return begin.unionByName(own)
