"""Conversation prefix trie.

The distinct sequences of first turns of all conversations form a trie; a conversation is a member of the nodes on its path. Each
node is owned by its smallest member. A smallest member of a node is the smallest of every deeper node on its path, so what a
conversation owns is a suffix of its path, and each node is owned once: sums over a subtree are sums over the subtree's top's
members. One group-by of prefixes counts members and finds owners; a second one adds up, for each member of a node, the tokens
(code points) of its path from there on less those that it owns, whether its last node is a leaf that it owns, and whether it owns
the next node (a child).

Windows along a conversation, not over a prefix, mark what it owns and number its turns: the root and common first turns have all
conversations as members and must not meet in one task. They go over ranges of (conversation, turn), so that one conversation with
a large share of all turns has many tasks, too. Prefixes are 128-bit hashes of the turns and their places.

Conversation ids are integers. Results: turns are ordered by turn (null first), then by role and by hash of the text; null roles
and texts are empty; rows with a null conversation id belong to no conversation; repeated rows are turns of their own; other
columns are not read; without conversations there is no node."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.ordered import Ranges

from ._memory import frugal
from ._store import Scratch

#: Conversation ids that are equal but for so many low bits stand together in one piece of a list of members.
PIECE_BITS = 13


def hashed_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, h1, h2, chars): what the trie needs of a turn, without its text."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return conversations.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"), F.length(text).cast("long").alias("chars"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, h1, h2, chars): the place of a turn in its conversation, from 1."""
    ranges = Ranges(turns, ["conv_id", "turn", "role", "h1", "h2"])
    return ranges.running(["conv_id"], {"place": ("count", F.lit(1))}).select("conv_id", "place", "h1", "h2", "chars")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations whose turns (conv_id, place, h1, h2, chars) are numbered from 1; ``members`` (conv_id)
    names all conversations, those without turns, too. Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "tries")
    here = lambda h: F.xxhash64(F.col("place"), F.col(h))
    ranges = Ranges(turns, ["conv_id", "place"])
    found = ranges.running(["conv_id"], {"k1": ("bit_xor", here("h1")), "k2": ("bit_xor", here("h2")), "upto": ("sum", F.col("chars"))})
    ids = members.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    top = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "p1", "p2", "chars", "upto")))
    paths = found.select("conv_id", F.col("place").cast("long").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(here("h1")).alias("p1"), F.col("k2").bitwiseXOR(here("h2")).alias("p2"), "chars", "upto")
    paths = scratch.write(paths.unionByName(top), "paths")  # one row for each conversation and node on its path
    key = ["depth", "k1", "k2"]
    length = paths.groupBy("conv_id").agg(F.max("depth").alias("last"), F.max("upto").alias("total"))
    nodes = paths.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min(F.col("upto") - F.col("chars")).alias("before"))
    nodes = scratch.write(nodes, "nodes")
    above = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct().withColumn("inner", F.lit(True))
    owned = nodes.join(above, key, "left").groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("own_from"), F.min("before").alias("own_before"), F.max(F.col("inner").isNull()).alias("leaf"))
    told = scratch.write(length.join(owned, "conv_id", "left"), "members")
    rows = paths.join(told, "conv_id")
    owns_next = (F.col("depth") < F.col("last")) & (F.col("own_from") <= F.col("depth") + 1)
    spent = F.greatest(F.lit(0), F.coalesce("own_before", "total") - (F.col("upto") - F.col("chars")))  # tokens from here to what it owns
    sums = rows.groupBy(*key).agg(F.sum(spent).alias("saved_tokens"), F.sum(F.coalesce(owns_next, F.lit(False)).cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(False)).cast("long")).alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(sums, key).join(parents, ["depth", "p1", "p2"], "left").join(ends(rows.filter("depth = last").select(*key, "conv_id")), key, "left")
    empty = hashlib.sha256().hexdigest()
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def ends(rows: DataFrame) -> DataFrame:
    """Per (depth, k1, k2) the digest of its conv_ids, ascending and comma-joined. Ids come together in pieces of a bounded range
    each; the pieces of a node, however many, are streamed through its digest in order."""
    listed = rows.groupBy("depth", "k1", "k2", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        names, last, state = ["depth", "k1", "k2", "ends_sha256"], None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last:
                    if last:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                done = []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names)

    listed = listed.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "piece").select("depth", "k1", "k2", "ids")
    return listed.mapInArrow(frugal(run), "depth long, k1 long, k2 long, ends_sha256 string")
