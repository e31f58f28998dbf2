"""A trie of conversations by their turns, built and summed up level by level.

A node of depth d is a distinct sequence of d turns (role and text); its members are the conversations that start with it, and the
smallest of their ids names it.  One pass a depth groups the conversations that are still live by (their node, their next turn);
of each group the least id becomes the child's name.  A node with one member starts a tail: nothing below it can be shared, so its
nodes come from the conversation's own turns, and it leaves the live ones.  So there are as many passes as the longest *shared*
prefix has turns, however long conversations are.  Then the levels are joined in reverse, each parent with the sums of its children.

Turns are known by the SHA-256 of role and text; each level is a table in the shared folder.  A first turn that very many
conversations share is counted in every task before it is shuffled, and its name goes back by a broadcast (of at most 100,000
nodes) or by a join that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import cut
from flowmill.llm.tokens import new_folder
from flowmill.storage import bounded

#: A conversation's rows are put in order by pieces of so many (as a power of two) successive turn numbers.
PIECE_BITS = 10

NO_IDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, key, chars``: each row with its place (from 0) in its conversation, its digest and its text's code points.

    The order is by turn (null first), then role, then text, as UTF-8.  A null role or text is empty; repeated rows are turns of their
    own; rows without an id belong to no conversation and are left out.  A conversation of very many turns is ordered in pieces.
    """
    turn = F.col(turn_col).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.shiftright(turn, PIECE_BITS).alias("piece"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("conv_id", "piece").count().withColumn("start", F.sum("count").over(earlier)).where(F.col("start") > 0)
    starts = bounded(cut(starts.select(F.col("conv_id").alias("of"), F.col("piece").alias("in"), "start")))
    place = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = own.select("conv_id", "piece", place.cast("long").alias("place"), key.alias("key"), F.length("text").cast("long").alias("chars"))
    joined = placed.join(starts, (F.col("conv_id") == F.col("of")) & F.col("piece").eqNullSafe(F.col("in")), "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "chars")


def spliced(turns: DataFrame, *, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation rebuilt, and ``conv_id, n_turns`` of each, also of those left without any.

    The first ``head`` turns (at most ``most``; an expression of conv_id) of conversation ``base`` come first (fewer, if it has
    fewer; none, if there is no such conversation), then the conversation's own turns after its first ``head``.
    """
    lengths = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("*", head.cast("long").alias("head"), base.cast("long").alias("base")))
    of_base = lengths.select(F.col("conv_id").alias("b"), F.col("n").alias("n_base"))
    given = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = lengths.join(of_base, F.col("base") == F.col("b"), "left").select("conv_id", "head", "base", given.alias("given"), (given + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_turns"))
    convs = cut(convs)
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("b"), "pos", "key", "chars")
    taken = convs.where("given > 0").join(first, (F.col("base") == F.col("b")) & (F.col("pos") < F.col("given"))).select("conv_id", "pos", "key", "chars")
    own = turns.join(convs, "conv_id").where(F.col("pos") >= F.col("head")).select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "key", "chars")
    return taken.unionAll(own), convs.select("conv_id", "n_turns")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``turns``: conv_id, pos (from 0, without gaps), key, chars; ``convs``: conv_id (distinct), n_turns.  n_leaves counts the
    childless nodes of the subtree, its top included; saved_tokens sums (n_convs - 1) * chars of the last turn over it;
    ends_sha256 is the digest of the ids, ascending, of the members that end here.  The root (depth 0) has no turn and no
    parent.  Without conversations there are no nodes.
    """
    spark, folder = turns.sparkSession, new_folder(turns.sparkSession, "trie")
    # Ordered by place, so that each pass reads the part of the files that has its turns.
    turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos").write.parquet(f"{folder}/turns")
    turns, convs = spark.read.parquet(f"{folder}/turns"), cut(convs)
    root = convs.agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.max("n_turns").alias("longest"))
    root = root.where("n_convs > 0").select("child", "n_convs", "longest", F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("chars"))
    root.write.parquet(f"{folder}/level0")
    top = spark.read.parquet(f"{folder}/level0").where("n_convs > 1").first()
    live, depth = convs.where(F.lit(top is not None)).select("conv_id", "n_turns", F.lit(top["child"] if top else None).cast("long").alias("node")), 0
    while True:
        live.where(F.col("n_turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id").write.mode("append").parquet(f"{folder}/ends")
        following = turns.where(F.col("pos") == depth).select("conv_id", "key", "chars")
        rows = cut(live.where(F.col("n_turns") > depth).join(following, "conv_id").select("conv_id", "n_turns", "node", "key", "chars"))
        groups = rows.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.max("n_turns").alias("longest"), F.max("chars").alias("chars"))
        depth += 1
        groups.write.parquet(f"{folder}/level{depth}")
        shared = bounded(spark.read.parquet(f"{folder}/level{depth}").where("n_convs > 1").select("node", "key", "child"))
        if shared.isEmpty():
            break
        live = rows.join(shared, ["node", "key"]).select("conv_id", "n_turns", F.col("child").alias("node"))
    _roll_up(spark, folder, depth)
    return _with_tails(turns, convs, folder)


def _roll_up(spark, folder: str, deepest: int) -> None:
    """The levels, deepest first, each with the sums of the one below, as one table ``nodes``."""
    below = None
    for depth in range(deepest, -1, -1):
        level = spark.read.parquet(f"{folder}/level{depth}").select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "longest", "chars")
        if below is None:
            level = level.select("*", *[F.lit(None).cast("long").alias(x) for x in ("children", "leaves", "saved")])
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(sums, "conv_id", "left")
        alone = F.col("n_convs") == 1  # what is below is a tail
        done = level.select(
            "conv_id",
            F.lit(depth).cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.when(alone, (F.col("longest") > depth).cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
            (alone & (F.col("longest") == depth)).alias("ends_alone"),
        )
        done.write.parquet(f"{folder}/nodes{depth}")
        below = spark.read.parquet(f"{folder}/nodes{depth}")
        below.write.mode("append").parquet(f"{folder}/nodes")


def _with_tails(turns: DataFrame, convs: DataFrame, folder: str) -> DataFrame:
    """The levels' nodes with the digests of who ends there, and the nodes of tails from the turns of their conversations."""
    spark = turns.sparkSession
    nodes, ends = spark.read.parquet(f"{folder}/nodes"), id_digests(spark.read.parquet(f"{folder}/ends"))
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    named = nodes.join(ends.select(F.col("depth").alias("d"), F.col("node").alias("conv"), "sha"), (F.col("conv_id") == F.col("conv")) & (F.col("depth") == F.col("d")), "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    named = named.select(*columns, F.when(F.col("ends_alone"), own).otherwise(F.coalesce("sha", F.lit(NO_IDS))).alias("ends_sha256"))
    tails = nodes.where("n_convs = 1 and not ends_alone").select(F.col("conv_id").alias("of"), F.col("depth").alias("start"))
    below = turns.select("conv_id", "pos").join(tails, (F.col("conv_id") == F.col("of")) & (F.col("pos") >= F.col("start"))).join(convs, "conv_id")
    last, one = F.col("pos") + 1 == F.col("n_turns"), F.lit(1).cast("long")
    return named.unionAll(
        below.select("conv_id", F.col("pos") + 1, F.col("conv_id"), one, F.when(last, F.lit(0).cast("long")).otherwise(one), one, F.lit(0).cast("long"), F.when(last, own).otherwise(F.lit(NO_IDS)))
    )


def id_digests(ends: DataFrame) -> DataFrame:
    """``depth, node, sha``: SHA-256 (hex) of the ids of ``ends`` (depth, node, conv_id) of each node, ascending, joined by commas.

    Ids are joined to strings in pieces of at most 1,024, in parallel; a node's pieces pass through one digest in order, and
    none but the present one is held.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", F.shiftright("conv_id", 10).alias("piece")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            found = []
            for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (depth, node) == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last:
                    found.append((*last, sha.hexdigest()))
                last, sha = (depth, node), hashlib.sha256(ids.encode())
            yield _digests(found)
        if last:
            yield _digests([(*last, sha.hexdigest())])

    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").mapInArrow(digest, "depth long, node long, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "sha"])
