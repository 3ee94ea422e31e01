"""The prefix trie of rebuilt conversations, by whole-sequence collapse.

Equal conversations become one weighted sequence with the list of its ends; sequences that are proper prefixes of others go by
anti-join, which leaves the leaves; the prefixes of the distinct sequences are then summed by weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import map_batches, ranged_sums, stored

#: Conversation ids that one row lists.
IDS_A_ROW = 4096

#: A prefix is known by its depth and four sums of 32 bits of hashes of its turns' SHA-256 (each taken with its place).
KEY = ["depth", "k0", "k1", "k2", "k3"]
PARENT = ["p0", "p1", "p2", "p3"]


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its group of five."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored (conv_id, n, digest, n_bytes): the turns in order, ``n`` from 0; ties in turn stand by role and then text.

    ``digest`` is of role and text, ``n_bytes`` counts the text's bytes in UTF-8.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = ["conv_id", "turn", "role", "text"]
    deal = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    kept = [F.col("conv_id"), digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one")]
    return ranged_sums(rows, order, ["conv_id"], {"one": "n"}, "turns", deal, kept).drop("one", "place")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, turns): all conversations, (conv_id, n_turns), and the turns of the rebuilt ones, (conv_id, depth, digest, n_bytes).

    A conversation c is the first h turns of conversation c - c % 5 (all of them if fewer) and its own turns but the first h.
    ``depth`` counts from 1.
    """
    ids = ordered.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": head_turns(F.col("conv_id"))})
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    ids = stored(ids.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0)))), "conversations")
    # the largest number of first turns is 8, so each row of these meets the few conversations of its group
    first = ordered.where("n < 8").withColumnRenamed("conv_id", "base")
    head = first.join(ids.select("conv_id", "base", "head"), "base").where("n < head").select("conv_id", (F.col("n") + 1).alias("depth"), "digest", "n_bytes")
    own = ordered.join(ids.select("conv_id", "h", "head"), "conv_id").where("n >= h").select("conv_id", (F.col("n") - F.col("h") + F.col("head") + 1).alias("depth"), "digest", "n_bytes")
    return ids.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), head.unionByName(own)


def prefixes(turned: DataFrame) -> DataFrame:
    """(conv_id, depth, k0..k3, p0..p3, n_bytes): the key of each prefix of each rebuilt conversation and that of its parent."""
    hashed = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in (1, 2)]
    halves = [half for h in hashed for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    parts = {f"h{i}": half for i, half in enumerate(halves)}
    rows = turned.withColumns(parts).select("conv_id", "depth", "n_bytes", *parts)
    summed = ranged_sums(rows, ["conv_id", "depth"], ["conv_id"], {f"h{i}": f"p{i}" for i in range(4)}, "prefixes")
    return summed.select("conv_id", "depth", "n_bytes", *((F.col(f"p{i}") + F.col(f"h{i}")).alias(f"k{i}") for i in range(4)), *PARENT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each key, whose rows come one after another in order."""
    at, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
        for key, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _table(out)
    if at is not None:
        yield _table([(*at, digest.hexdigest())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(KEY) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], names=[*KEY, "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(key, ids, first): the sorted ids of the conversations that end at each key, joined by commas, in rows of ``IDS_A_ROW`` at most.

    The ids are numbered in ranges, so many equal conversations spread over tasks; a later step meets one row for thousands.
    """
    numbered = ranged_sums(members.select(*KEY, "conv_id").withColumn("one", F.lit(1).cast("long")), [*KEY, "conv_id"], KEY, {"one": "n"}, "ends")
    listed = numbered.groupBy(*KEY, F.floor(F.col("n") / IDS_A_ROW).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    return listed.select(*KEY, "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def sequences(ids: DataFrame, keyed: DataFrame) -> DataFrame:
    """Stored (key, weight, conv_id, ends_sha256): the distinct whole sequences, how many conversations are equal to each, and the least."""
    whole = keyed.join(ids.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi").select("conv_id", *KEY)
    turnless = ids.where("n_turns = 0").select("conv_id", *(F.lit(0).cast("long").alias(k) for k in KEY))
    members = whole.unionByName(turnless)
    weighted = members.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    dealt = ends(members).repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
    digests = map_batches(dealt, _hashed, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")
    return stored(weighted.join(digests, KEY), "sequences")


def trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, one row each.

    A node is a distinct sequence of first turns; conv_id, its smallest member; depth; parent_conv_id, its parent's conv_id (null for the
    root); n_convs, members; n_children; n_leaves, childless nodes in its subtree (itself included); saved_tokens, over its
    subtree the bytes of each node's last text for each member but one; ends_sha256, of the members that end here.

    Turns stand by number, null first, ties by role and text; null role or text is empty; repeated rows are turns of their own.
    Rows with a null conv_id belong to no conversation and are left out, other columns too.  Each conversation keeps
    the first of its group's turns as ``rebuilt`` says; one that is left without a turn ends at the root.  An empty table has no conversation and gives no row.
    """
    ids, turned = rebuilt(turns(conversations, **columns))
    keyed = prefixes(turned)
    whole = sequences(ids, keyed)

    # the prefixes of each distinct sequence, taken from the least of its conversations
    rows = keyed.join(whole.select("conv_id", "weight", F.col("depth").alias("n_turns")), "conv_id").withColumn("last", F.col("depth") == F.col("n_turns"))
    zero = F.lit(0).cast("long")
    root = whole.select("conv_id", *(zero.alias(k) for k in (*KEY, *PARENT, "n_bytes")), "weight", F.col("depth").alias("n_turns"), (F.col("depth") == 0).alias("last"))
    rows = stored(rows.unionByName(root), "rows")
    leaves = whole.join(rows.where(~F.col("last")).select(*KEY).distinct(), KEY, "left_anti").select("conv_id")
    of_leaves = rows.join(leaves.withColumnRenamed("conv_id", "leaf"), F.col("conv_id") == F.col("leaf"), "left")
    nodes = of_leaves.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), *(F.max(p).alias(p) for p in PARENT), F.min("leaf").alias("owner"), F.count("leaf").alias("n_leaves"))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")

    # each node's savings count at one leaf below it; sums from the ends of the leaves' paths up to each depth then add up by node
    savings = nodes.select(F.col("owner").alias("conv_id"), "depth", "saved")
    paths = rows.join(leaves, "conv_id", "left_semi").select("conv_id", *KEY).join(savings, ["conv_id", "depth"], "left")
    paths = paths.select("conv_id", (-F.col("depth")).alias("up"), F.coalesce("saved", zero).alias("saved"), *KEY)
    below = ranged_sums(paths, ["conv_id", "up"], ["conv_id"], {"saved": "deeper"}, "paths")
    saved = below.groupBy(*KEY).agg(F.sum(F.col("saved") + F.col("deeper")).alias("saved_tokens"))

    parent = [(F.col("depth") - 1).alias("depth"), *(F.col(p).alias(k) for p, k in zip(PARENT, KEY[1:], strict=True))]
    children = nodes.where("depth > 0").select(parent).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(p) for p, k in zip(PARENT, KEY[1:], strict=True)), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    parts = [nodes.drop("saved", "n_bytes", "owner"), saved, children, whole.select(*KEY, "ends_sha256")]
    out = reduce(lambda a, b: a.join(b, KEY, "left"), parts).join(above, ["depth", *PARENT], "left")
    long = [F.coalesce(c, zero).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select("conv_id", "depth", "parent_conv_id", *long, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
