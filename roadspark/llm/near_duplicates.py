"""Near-duplicate documents by BagMinHash signatures, banding, and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import extended, map_batches, stored, with_fields
from roadspark.llm.components import components
from roadspark.llm.shingles import mix, multisets, overlap, units

#: Registers of a signature; bands of rows each.  At a similarity of 0.8 a pair shares no band once in 5,000 times.
REGISTERS, BANDS = 64, 16
SIMILARITY = 0.8
#: Members of one block when a bucket is compared in blocks.
BLOCK = 256
#: Elements of the incidence matrices of two blocks that are multiplied at once.
COLUMNS = 4096

_LEVEL = np.uint64(0xA24BAED4963EE407)
_POINT = np.uint64(0x9FB21C651E98DF25)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(s: np.ndarray, n: np.ndarray, doc: np.ndarray, until: np.ndarray, docs: int) -> np.ndarray:
    """Least arrival time in each register of each document, of the arrivals up to the document's ``until``.

    A shingle of weight n is a Poisson process over time and over weight [0, n).  The weights are cut into
    [0, 1), [1, 2), [2, 4), [4, 8), ...; each piece has arrivals of its own at a rate of its width, the same ones in
    every document, each with a weight and a register.  An arrival counts where its weight lies below n.
    """
    out = np.full(docs * REGISTERS, np.inf)
    low, high, level = 0, 1, 0
    while True:
        has = np.flatnonzero(n > low)
        if not len(has):
            return out.reshape(docs, REGISTERS)
        t, row, k = np.zeros(len(has)), has, 0
        while len(row):
            k += 1
            salt = (level * int(_LEVEL) + k * int(_POINT)) % (1 << 64)
            r = mix(s[row] + np.uint64(salt))
            t = t - np.log(_uniform(r)) / (high - low)
            soon = t <= until[doc[row]]
            t, row, r = t[soon], row[soon], mix(r[soon] ^ _LEVEL)
            counts = slice(None)
            if high - low > 1:
                counts = low + _uniform(mix(r ^ _POINT)) * (high - low) < n[row]
            np.minimum.at(out, doc[row][counts] * REGISTERS + (r[counts] % np.uint64(REGISTERS)).astype(np.int64), t[counts])
        low, high, level = high, 2 * high, level + 1


def signatures(s: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BagMinHash signature of each multiset of shingles ``s`` with counts ``n``; ``at`` tells where each starts.

    Two signatures agree in a register with the multisets' weighted Jaccard similarity as chance.  Arrivals are
    made in order of time up to a bound by which the registers are likely full; where one isn't, the bound grows.
    """
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.bincount(doc, n, len(sizes))
    until = REGISTERS * (np.log(REGISTERS) + 3) / np.maximum(weight, 1)
    out = _points(s, n, doc, until, len(sizes))
    while True:
        lacking = np.isinf(out).any(1) & (weight > 0)
        if not lacking.any():
            return out
        until = until * 2
        rows = lacking[doc]
        number = np.cumsum(lacking) - 1
        out[lacking] = _points(s[rows], n[rows], number[doc[rows]], until[lacking], int(lacking.sum()))


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``content`` (hash of the multiset of five-word shingles; null without a word) and ``bands``."""
    schema = with_fields(docs.drop(text), T.StructField("content", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())))
    rows = REGISTERS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n, at = multisets(batch.column(text))
            bits = signatures(s, n, at).view(np.uint64).reshape(-1, BANDS, rows)
            key = np.full(bits.shape[:2], 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(rows):
                key = mix(key * _LEVEL + bits[:, :, k])
            sums = np.concatenate([[0], np.cumsum(mix(s ^ mix(n.astype(np.uint64) * _POINT)))]).astype(np.uint64)
            content = (sums[at[1:]] - sums[at[:-1]]).view(np.int64)
            empty = np.diff(at) == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS, dtype="i4")), pa.array(key.reshape(-1).view(np.int64)))
            rest = batch.select([c for c in batch.schema.names if c != text])
            yield extended(rest, {"content": pa.array(content, mask=empty), "bands": bands})

    return map_batches(docs, run, schema)


def _units(docs: DataFrame) -> DataFrame:
    """``(node, units)``: the multiset of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [u.tobytes() for u in units(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "units"])

    return map_batches(docs.select("node", "text"), run, T.StructType([T.StructField("node", T.LongType()), T.StructField("units", T.BinaryType())]))


def _verified(pairs: DataFrame) -> DataFrame:
    """``(u, v, same)``: whether the multisets ``a`` and ``b`` of each pair overlap by ``SIMILARITY``."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (map(unpacked, batch.column(c)) for c in ("a", "b"))
            same = [overlap(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same)], names=["u", "v", "same"])

    return map_batches(pairs.select("u", "v", "a", "b"), run, schema)


def unpacked(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint64)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``, as a product of incidence matrices.

    Only elements that occur on both sides count; they are taken in runs of ``COLUMNS``.
    """
    out = np.zeros((len(a), len(b)))
    x, y = np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])
    shared = np.intersect1d(x, y)
    sides = []
    for all_of, sets in ((x, a), (y, b)):
        at = np.searchsorted(shared, all_of)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        there = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == all_of) if len(shared) else np.zeros(0, np.int64)
        there = there[np.argsort(at[there], kind="stable")]
        sides.append((row[there], at[there]))
    for low in range(0, len(shared), COLUMNS):
        parts = []
        for (row, at), sets in zip(sides, (a, b), strict=True):
            begin, end = np.searchsorted(at, [low, low + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), np.float32)
            part[row[begin:end], at[begin:end] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _compare_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one block of outsiders and one block of a bucket: enough to join what they join."""
    of = {}
    for outsider in (True, False):
        side = group[group["outsider"] == outsider]
        of[outsider] = side["component"].to_numpy(np.int64), [np.frombuffer(u, np.uint64) for u in side["units"]]
    (p, mine), (q, theirs) = of[True], of[False]
    both = intersections(mine, theirs)
    sizes = np.array([len(u) for u in mine])[:, None] + np.array([len(u) for u in theirs])[None]
    same = (both / np.maximum(sizes - both, 1) >= SIMILARITY) & (p[:, None] != q[None])
    i, j = np.nonzero(same)
    ends = np.unique(np.sort(np.stack([p[i], q[j]], 1), axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for u, v in ends.tolist():
        if root(u) != root(v):
            parent[root(u)] = root(v)
            out.append((u, v))
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def _unsettled(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, once for each pair of blocks where they are compared.

    The bucket's largest component needs no comparison inside: the others' members, the outsiders, are compared with
    all.  ``outsider`` tells on which side a row stands; ``i`` numbers the outsiders' block, ``j`` the bucket's.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("n")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("bucket", F.col("main.component").alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("main.size")).alias("out_blocks"))
    rows = stored(placed.select("bucket", "node", "component").join(main, "bucket"), "unsettled")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["bucket", "node", "component"]
    outside = rows.where("component <> main").select(*key, F.lit(True).alias("outsider"), mine("out_blocks").alias("i"), every("all_blocks").alias("j"))
    return outside.unionByName(rows.select(*key, F.lit(False).alias("outsider"), every("out_blocks").alias("i"), mine("all_blocks").alias("j")))


def row_keys(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    return [F.col(id_col).alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text")]


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k_id, k_text, class_id, kept)`` for each row of ``docs``: its id, its text's hash, the least id of its class.

    Texts of the same multiset of shingles are one node.  Nodes that share a band are compared with the
    least of their bucket; a link needs a multiset overlap of ``SIMILARITY``.  Where a bucket still holds
    several components, its members are compared across components in blocks of ``BLOCK``, so every candidate pair
    of different components is decided.  Classes are the components of the links; ``kept`` marks the row that
    represents its class: the least id (null last), then the least text hash.

    A text without a word (null, empty, signs only) is alone in its class.  Rows that repeat both id and text share
    their answer.  An empty table gives an empty one.
    """
    keyed = docs.select(*row_keys(docs, id_col, text), F.col(text).alias("text"))
    signed = stored(sign(keyed), "signed")
    row = F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text")
    nodes = stored(
        signed.where(F.col("content").isNotNull()).groupBy(F.col("content").alias("node")).agg(F.min(row).alias("row"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(buckets, "bucket"), "buckets")
    pairs = stored(shared.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), "pairs")

    needed = shared.select("node").distinct().join(nodes.select("node", "row.k_id", "row.k_text"), "node")
    same_row = [keyed["k_text"] == needed["k_text"], keyed["k_id"].eqNullSafe(needed["k_id"])]
    # a node's text occurs again in rows that repeat it: one of each is enough
    texts = keyed.join(needed, same_row).select("node", "text").dropDuplicates(["node"])
    sets = stored(_units(texts), "multisets")
    a, b = sets.select(F.col("node").alias("u"), F.col("units").alias("a")), sets.select(F.col("node").alias("v"), F.col("units").alias("b"))
    links = stored(_verified(pairs.join(a, "u").join(b, "v")).where("same").select("u", "v"), "links")
    found = components(links)

    placed = shared.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = _unsettled(placed).join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(_compare_block, "u long, v long")
    # the components are the nodes of a smaller graph, whose components are joined to those found
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("into"))

    placed = nodes.select("node", "row").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component"))
    heads = placed.groupBy("component").agg(F.min("row").alias("head"))
    heads = placed.select("node", "component").join(heads, "component").select(F.col("node").alias("content"), "head")
    alone = F.col("head").isNull()
    return signed.join(heads, "content", "left").select(
        "k_id",
        "k_text",
        F.when(alone, F.col("k_id")).otherwise(F.col("head.k_id")).alias("class_id"),
        (alone | ((F.col("head.k_text") == F.col("k_text")) & F.col("head.k_id").eqNullSafe(F.col("k_id")))).alias("kept"),
    )
