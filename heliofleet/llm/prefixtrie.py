"""Prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of turns, a node a distinct prefix. Nothing walks a sequence turn by
turn: sequences are cut at half depth, over and over.

* ``block_names``: names of all aligned blocks of 1, 2, 4, ... turns, each the digest of its halves.
* ``prefix_names``: the cut prefix at half depth is named first; it is the context of the lower
  forest, while the upper trie keeps its own. Both halves are then cut again, in one keyed join for
  all forests of a depth: a position whose lowest set bit is 2^k takes the name at the cut 2^k turns
  above it and the name of the block between.
* ``grafted``: totals go up the same cuts in reverse. Inside blocks of 2^k depths every node knows its
  total; a node at the cut between two blocks hands its total to its ancestors in the upper one.

Rounds are logarithmic in the longest conversation, each round is joins and keyed sums over rows of
fixed size (digests, never texts), and a round of size 2^k touches only conversations that long. No
step gathers a conversation, a node's members or a subtree in one place. Round results are written to
the shared folder, so plans stay short and a lost executor rereads files.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet.llm.tables import staged

WORD = r"[^\x20\x09-\x0D]+"
GROUP, HEAD = 20, 4  # conversations that share a first part; its length is crc32 modulo HEAD
ID_RUN = 4096  # ids joined as text at once
ROOT = "00" * 16


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _read(paths: list[DataFrame]) -> DataFrame:
    out = paths[0]
    for other in paths[1:]:
        out = out.unionByName(other)
    return out


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, sym, words``: turns by number, counted from 1, as digests.

    Rows are sorted by range, so even one very long conversation is spread; a turn's position is its
    place in its range plus the rows of earlier ranges.
    """
    said, body = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = staged(turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said.alias("role"),
        _digest(F.octet_length(said).cast("string").cast("binary"), F.lit(b":"), said.cast("binary"), body.cast("binary")).alias("sym"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("words")), "trie-digests")  # texts are read once; sorting by range looks at its rows twice
    order = ["conv", F.asc_nulls_first("turn"), "role", "sym"]
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trie-turns")
    within = Window.partitionBy("part", "conv").orderBy(*order[1:])
    place = dealt.withColumn("at", F.row_number().over(within))
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))  # a row per range
    return place.join(before.where("base > 0").select("conv", "part", "base"), ["conv", "part"], "left").select(
        "conv", (F.coalesce("base", F.lit(0)) + F.col("at")).alias("pos"), "sym", "words")


def rebuilt(numbered: DataFrame, group: int = GROUP, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (``conv, d, sym, words``; d from 1) and all their ids.

    Conversation c takes the first h turns of conversation c - c % group (h: crc32 of c modulo head),
    then its own turns after its first h.
    """
    base = F.col("conv") - F.col("conv") % group
    take = F.crc32(F.col("conv").cast("string").cast("binary")) % head
    convs = staged(numbered.select("conv").distinct().select("conv", base.alias("base"), take.alias("h")), "trie-convs")
    heads = numbered.where(F.col("conv") % group == 0).where(F.col("pos") < head).select(F.col("conv").alias("base"), "pos", "sym", "words")
    first = convs.join(heads, "base").where("pos <= h").select("conv", F.col("pos").alias("d"), "sym", "words")
    kept = convs.join(heads.groupBy("base").agg(F.max("pos").alias("there")), "base", "left").select(
        "conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"))
    own = numbered.join(kept, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "sym", "words")
    return first.unionByName(own), convs.select("conv")


def block_names(steps: DataFrame, rounds: int) -> list[DataFrame]:
    """Per k below ``rounds``: ``conv, j, name`` of the j-th whole block of 2^k turns."""
    levels = [steps.select("conv", (F.col("d") - 1).alias("j"), F.col("sym").alias("name"))]
    for _ in range(1, rounds):
        halves = levels[-1].groupBy("conv", F.shiftright("j", 1).alias("i")).agg(
            F.max(F.when(F.col("j") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("j") % 2 == 1, F.col("name"))).alias("b"))
        levels.append(staged(halves.where("a is not null and b is not null").select(
            "conv", F.col("i").alias("j"), _digest(F.col("a"), F.col("b")).alias("name")), "trie-blocks"))
    return levels


def prefix_names(steps: DataFrame, convs: DataFrame, rounds: int) -> DataFrame:
    """``conv, last, d, name`` for every prefix, d from 0: equal names for equal prefixes. ``convs``: conv, last (its turns)."""
    blocks = block_names(steps, rounds)
    done = [convs.select("conv", "last", F.lit(0).cast("long").alias("d"), F.unhex(F.lit(ROOT)).alias("name"))]
    for k in range(rounds - 1, -1, -1):
        cut = blocks[k].where(F.col("j") % 2 == 0).select("conv", F.shiftleft("j", k).alias("d"), F.col("name").alias("block"))
        done.append(staged(_read(done).join(cut, ["conv", "d"]).select(
            "conv", "last", (F.col("d") + (1 << k)).alias("d"), _digest(F.col("name"), F.col("block")).alias("name")), "trie-names"))
    return _read(done)


def grafted(paths: DataFrame, nodes: DataFrame, values: list[str], rounds: int) -> DataFrame:
    """``d, name`` and the sum of each value over the node's subtree.

    ``paths`` (conv, last, d, name) are all prefixes; ``nodes`` (conv, d, name, values) names for each node
    one conversation that passes it.
    """
    keys, sums = ["d", "name"], [F.sum(v).alias(v) for v in values]
    got = [nodes.select(*keys, *values)]
    for k in range(rounds):
        whole, half = 1 << (k + 1), 1 << k
        at_cut = (F.col("d") >= half) & (F.col("d") % whole == half)
        total = _read(got).where(at_cut).groupBy(*keys).agg(*sums) if k else nodes.where(at_cut).select(*keys, *values)
        cut = nodes.where(at_cut).select("conv", *keys).join(total, keys).select(
            "conv", F.shiftright("d", k + 1).alias("block"), *values)
        upper = paths.where((F.col("last") >= half) & (F.col("d") % whole < half)).select("conv", F.shiftright("d", k + 1).alias("block"), *keys)
        got.append(staged(upper.join(cut, ["conv", "block"]).groupBy(*keys).agg(*sums), "trie-totals"))
    return _read(got).groupBy(*keys).agg(*sums)


def _hash_runs(batches):
    """SHA-256 of each node's joined ids; its runs arrive in order and only the hash is held."""
    now, state = None, None
    for batch in batches:
        out = []
        for d, name, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "name", "ids"))):
            if (d, name) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (d, name), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashes(out)
    if now is not None:
        yield _hashes([(*now, state.hexdigest())])


def _hashes(rows):
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())],
                                      names=["d", "name", "ends_sha256"])


def end_hashes(paths: DataFrame) -> DataFrame:
    """``d, name, ends_sha256`` of nodes at which a conversation ends: SHA-256 of the ids that end there, ascending.

    Ids become text in runs of at most ``ID_RUN``; a node's runs are sorted on disk and hashed as a stream.
    """
    ends = paths.where("d = last").select("d", "name", "conv", F.floor(F.col("conv") / ID_RUN).alias("run"))
    runs = ends.groupBy("d", "name", "run").agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    return runs.repartition("d", "name").sortWithinPartitions("d", "name", "run").mapInArrow(
        _hash_runs, "d long, name binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns go by number, null first; equal numbers go by role, then by the digest of role and text, so
    repeated rows count as turns of their own. Null role or text is the empty text. Rows without a
    conversation id take no part. A text of any length is read whole, once, and travels as a digest.
    Prefixes are the same when their 128-bit names are. A conversation left without turns is a member
    of the root. An empty table gives no rows. Further columns are ignored.
    """
    numbered = staged(numbered_turns(turns, conv_id, turn, role, text), "trie-numbered")
    steps, convs = rebuilt(numbered)
    steps = staged(steps, "trie-steps")
    lengths = steps.groupBy("conv").agg(F.max("d").alias("last"))
    convs = staged(convs.join(lengths, "conv", "left").select("conv", F.coalesce("last", F.lit(0)).alias("last")), "trie-lengths")
    rounds = int(convs.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]).bit_length()
    paths = staged(prefix_names(steps, convs, rounds), "trie-paths")
    before = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    seen = paths.join(before, ["conv", "d"], "left").join(steps.select("conv", "d", "words"), ["conv", "d"], "left")
    nodes = staged(seen.groupBy("d", "name").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.any_value("parent").alias("parent"),
        F.coalesce(F.any_value("words"), F.lit(0)).alias("words")), "trie-nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    valued = staged(nodes.join(children, ["d", "name"], "left").select(
        "conv", "d", "name", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-valued")
    totals = grafted(paths, valued, ["n_leaves", "saved_tokens"], rounds)
    own = valued.drop("n_leaves", "saved_tokens").join(totals, ["d", "name"]).join(end_hashes(paths), ["d", "name"], "left")
    above = valued.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return staged(own, "trie-totals").join(above, ["d", "parent"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
