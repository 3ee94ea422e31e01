"""Near-duplicate vectors by an inverted multi-index over the halves of each vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import map_batches, stored
from roadspark.llm.components import components

#: Least cosine of a link.
COSINE = 0.9
#: Vectors from which the codebooks and the reach of a search are learned; every vector is indexed.
TRAIN_ROWS = 20_000
#: Share of the pairs right at ``COSINE`` that a search from one side alone has to reach.
RECALL = 0.99
#: Codes of a half at most; the sample has to fill them.
MOST_CODES = 2048
#: Rows of an index block and of the searches that meet it.  Searches go to each block and vectors to each part, so their copies fall with it.
BLOCK = 4096
#: Products held at once.
PRODUCTS = 1 << 20


class MultiIndex:
    """Codebooks ``u`` and ``v`` of the first and second half of unit vectors; their product is the grid of cells.

    A search takes the cells in ascending order of the sum of both squared distances and ends when that sum
    is ``reach`` above the nearest cell's.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, reach: float):
        self.u, self.v, self.reach = u, v, reach

    @property
    def half(self) -> int:
        return self.u.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row's halves to all codes; a row's own don't depend on the rows beside it."""
        out = []
        for halves, codes in ((x[:, : self.half], self.u), (x[:, self.half :], self.v)):
            step = max(1, (1 << 20) // max(codes.size, 1))
            parts = [((halves[k : k + step, None] - codes) ** 2).sum(-1) for k in range(0, len(x), step)]
            out.append(np.concatenate([*parts, np.zeros((0, len(codes)))]))
        return out[0], out[1]

    def bound(self, du: np.ndarray, dv: np.ndarray) -> np.ndarray:
        return du.min(-1) + dv.min(-1) + self.reach

    def runs(self, du: np.ndarray, dv: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Cells that one search visits: for each first code within reach, the run of second codes in order of distance."""
        order, rest = np.argsort(dv, kind="stable"), self.bound(du, dv) - du
        lengths = np.searchsorted(dv[order], rest, "right")
        return [(int(i), order[: lengths[i]]) for i in np.flatnonzero(lengths)]

    def visits(self, x: np.ndarray, bound: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the search of each row, which ends at its ``bound``, visits the cell (i, j); in line with ``runs``."""
        du, dv = ((x[:, : self.half] - self.u[i]) ** 2).sum(-1), ((x[:, self.half :] - self.v[j]) ** 2).sum(-1)
        return dv <= bound - du

    def traverse(self, du: np.ndarray, dv: np.ndarray) -> list[tuple[int, int]]:
        """The same cells of one search by multi-sequence traversal, nearest first."""
        cells = [(du[i] + dv[j], i, int(j)) for i, run in self.runs(du, dv) for j in run]
        return [(i, j) for _, i, j in sorted(cells)]


def _k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 7) -> MultiIndex:
    """Learn both codebooks from unit vectors, and the reach that finds ``recall`` of the pairs right at ``cosine``.

    The codes grow with the square root of ``rows``, so that a cell of the grid keeps about sixteen vectors.  For the reach, each sampled vector gets a partner at exactly
    that cosine in a random direction; the reach is the quantile of what a search needs to visit its cell.
    """
    random = np.random.default_rng(seed)
    k = int(np.clip(round(rows**0.5 / 4), 1, MOST_CODES))
    k = max(1, min(k, len(sample) // 4))
    half = sample.shape[1] // 2
    index = MultiIndex(_k_means(sample[:, :half], k, random), _k_means(sample[:, half:], k, random), 0.0)
    other = random.standard_normal(sample.shape)
    other -= (other * sample).sum(1)[:, None] * sample
    size = np.linalg.norm(other, axis=1)
    other = cosine * sample + np.sqrt(1 - cosine**2) * other / np.where(size > 0, size, 1)[:, None]
    (du, dv), (eu, ev) = index.distances(sample), index.distances(other)
    at = np.arange(len(sample))
    need = du[at, eu.argmin(1)] + dv[at, ev.argmin(1)] - du.min(1) - dv.min(1)
    index.reach = float(np.quantile(need, recall)) + 1e-9
    return index


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(nodes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """Of each node its cell (i, j), where its search ends, and the cells that it visits: for each first code the packed second codes."""
    visited = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("run", T.BinaryType())])
    fields = [("node", T.LongType()), ("n", T.LongType()), ("dim", T.IntegerType()), ("i", T.IntegerType()), ("j", T.IntegerType()), ("bound", T.DoubleType()), ("visits", T.ArrayType(visited)), ("unit", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for dim, group in frame.groupby(frame["vector"].map(len)):
                x = _units(list(group["vector"]))
                index = indexes.get(dim)
                if index is None:
                    i = j = bound = np.zeros(len(x), int)
                    runs = [[(0, np.zeros(1, int))]] * len(x)
                else:
                    du, dv = index.distances(x)
                    i, j, bound = du.argmin(1), dv.argmin(1), index.bound(du, dv)
                    runs = [index.runs(a, b) for a, b in zip(du, dv, strict=True)]
                offsets = np.cumsum([0] + [len(r) for r in runs]).astype("i4")
                first = pa.array([a for r in runs for a, _ in r], pa.int32())
                second = pa.array([b.astype("<u2").tobytes() for r in runs for _, b in r], pa.binary())
                visits = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([first, second], names=["i", "run"]))
                plain = [pa.array(c, t) for c, t in ((group["node"], pa.int64()), (group["n"], pa.int64()), ([dim] * len(x), pa.int32()), (i, pa.int32()), (j, pa.int32()), (bound, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*plain, visits, pa.array([r.tobytes() for r in x], pa.binary())], names=[f.name for f in schema.fields])

    return map_batches(nodes, run, schema)


def meetings(visited: np.ndarray, search: np.ndarray, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` of the pairs right at or above ``COSINE``, of those whose cell is visited; about ``PRODUCTS`` at a time at most.

    ``search`` tells which row of ``x`` visits the cell ``visited``; ``cells`` are those of ``y``.  Only searches and
    vectors that meet in a cell are multiplied.
    """
    by_cell, by_visit = np.argsort(cells, kind="stable"), np.argsort(visited, kind="stable")
    names, begins = np.unique(cells[by_cell], return_index=True)
    ends = np.append(begins[1:], len(cells))
    low, high = (np.searchsorted(visited[by_visit], names, side) for side in ("left", "right"))
    found, held = [], 0
    for k in np.flatnonzero(high > low):
        p, q = search[by_visit[low[k] : high[k]]], by_cell[begins[k] : ends[k]]
        step = max(1, PRODUCTS // len(q))
        for at in range(0, len(p), step):
            some = p[at : at + step]
            a, b = np.nonzero(x[some] @ y[q].T >= COSINE - 1e-9)
            found.append((some[a], q[b]))
            held += len(a)
            if held >= PRODUCTS:
                yield _exact(found, x, y)
                found, held = [], 0
    if held:
        yield _exact(found, x, y)


def _exact(found: list, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    # the products of a matrix depend on its shape in their last bits; these are the same from either side
    exact = (x[a] * y[b]).sum(1) >= COSINE
    return a[exact], b[exact]


def candidates(visited: np.ndarray, search: np.ndarray, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ``meetings`` at once."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *meetings(visited, search, cells, x, y)]
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    return a, b


def _verify(indexes: dict[int, MultiIndex]):
    """What to do with an index block of one first code and the searches that visit cells of it."""

    def run(key: tuple, searches: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["node", "links", "joined"]
        if not len(searches) or not len(block):
            return pd.DataFrame([], columns=names)
        dim = int(key[0])
        index = indexes.get(dim)
        x, y = (np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim) for packed in (searches["unit"], block["b_unit"]))
        xn, yn, xw, yw = searches["node"].to_numpy(), block["b_node"].to_numpy(), searches["n"].to_numpy(), block["b_n"].to_numpy()
        visited = np.frombuffer(b"".join(searches["run"]), "<u2").astype(np.int64)
        search = np.repeat(np.arange(len(x)), searches["run"].map(len).to_numpy() // 2)
        ids, where = np.unique(np.concatenate([xn, yn]), return_inverse=True)
        xi, yi = where[: len(xn)], where[len(xn) :]
        counts, label, linked = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        for a, b in meetings(visited, search, block["b_j"].to_numpy(), x, y):
            other = xn[a] != yn[b]
            a, b = a[other], b[other]
            p, q = xi[a], yi[b]
            np.add.at(counts, p, yw[b])
            linked[p] = linked[q] = True
            if index is not None:
                # the search from the other side counts the pair for itself, unless it doesn't visit this cell
                back = ~index.visits(y[b], block["b_bound"].to_numpy()[b], searches["own_i"].to_numpy()[a], searches["own_j"].to_numpy()[a])
                np.add.at(counts, q[back], xw[a[back]])
            # a node's label is the root of its tree, so trees of earlier pairs join by their roots
            while (apart := label[p] != label[q]).any():
                p, q = p[apart], q[apart]
                least = np.minimum(label[p], label[q])
                np.minimum.at(label, label[p], least)
                np.minimum.at(label, label[q], least)
                while (label[label] != label).any():
                    label = label[label]
        return pd.DataFrame({"node": ids[linked], "links": counts[linked], "joined": ids[label[linked]]})

    return run


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: ``key``, ``n_links`` (other rows linked directly), ``component_id`` (least key reachable) and ``kept``.

    A link is a cosine of ``COSINE`` or more in double precision, verified for every candidate; candidates come
    from the multi-index, from either side of a pair.  The posted lists of cells that share their first code lie together,
    ordered by the second; a search comes there once, with the second codes that its traversal visits, and is compared
    with the vectors of those cells only.  Equal vectors are one node of the index, each linked with
    the others.  Every first code's vectors and searches are cut into blocks of at most about ``BLOCK`` by hashes, so
    a crowded cell spreads over many tasks.  Other columns of ``vectors`` don't pass.  An empty table gives an empty one.  Vectors of different lengths don't link.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing and are their own component.
    Only a sample of at most ``TRAIN_ROWS`` vectors comes to the driver, for the codebooks.
    """
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(F.col(vector), lambda v: v != 0)
    keyed = vectors.select(F.col(key).alias("key"), F.when(fine, F.col(vector).cast("array<double>")).alias("vector"))
    rows = stored(keyed.select("key", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("node"), "vector"), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    nodes = stored(nodes, "nodes")
    there = nodes.count()
    part = min(1.0, TRAIN_ROWS / max(there, 1))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < round(part * (1 << 20))).select("vector").toPandas()["vector"]
    indexes = {dim: fit(_units(list(group)), round(len(group) / part)) for dim, group in sample.groupby(sample.map(len)) if dim > 1}

    placed = stored(_cells(nodes, indexes), "cells")
    searches = placed.select("node", "n", "dim", "i", "j", F.explode("visits").alias("v"), "unit").select("node", "n", "dim", F.col("i").alias("own_i"), F.col("j").alias("own_j"), "v.i", "v.run", "unit")
    indexed = placed.select("node", "n", "dim", "i", "j", "bound", "unit")
    block = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = indexed.groupBy("dim", "i").agg(F.count("*").alias("rows")).join(searches.groupBy("dim", "i").agg(F.count("*").alias("asks")), ["dim", "i"])
    sizes = stored(sizes.select("dim", "i", block("rows").alias("blocks"), block("asks").alias("parts")), "sizes")
    count = sizes.count()  # one row for each first code, MOST_CODES for each length at most
    sizes = F.broadcast(sizes) if count <= 10_000 else sizes
    ask = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    searches = searches.join(sizes, ["dim", "i"]).select("dim", "i", everywhere("blocks").alias("block"), ask.alias("part"), "node", "n", "own_i", "own_j", "run", "unit")
    indexed = indexed.join(sizes, ["dim", "i"]).select("dim", "i", mine.alias("block"), everywhere("parts").alias("part"), "j", "bound", "node", "n", "unit")
    indexed = indexed.toDF(*(f"b_{c}" for c in indexed.columns))
    group = ["dim", "i", "block", "part"]
    found = stored(searches.groupBy(*group).cogroup(indexed.groupBy(*(f"b_{c}" for c in group))).applyInPandas(_verify(indexes), "node long, links long, joined long"), "found")

    joined = components(found.select(F.col("node").alias("u"), F.col("joined").alias("v")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    state = nodes.select("node", "n").join(counted, "node", "left").join(joined, "node", "left")
    state = state.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"))
    state = state.join(least, "node")
    heads = state.groupBy("component").agg(F.min("least").alias("head"))
    state = state.join(heads, "component").select("node", "n_links", "head")
    out = rows.select("key", "node").join(state, "node", "left")
    head = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("head"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), head.cast("long").alias("component_id"), F.coalesce(F.col("key") == head, F.lit(False)).alias("kept"))
