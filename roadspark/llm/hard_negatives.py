"""Hard negatives by LEMP-style search: length buckets with sorted coordinate lists, feasible ranges, exact verification.

Scores are integer inner products.  Rows stand in the order of their length; a group of rows is one task's work and is cut into
buckets, and the anchors stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import map_batches, ranged_numbers, stored

#: Rows of one bucket at most; rows from which on it ends where lengths fall below this share of its longest; and bytes of the vectors (8 a component) of one group of buckets, which a worker holds.
BUCKET_ROWS = 2048
LEAST_ROWS, LENGTH_SHARE = 128, 0.9
GROUP_BYTES = 8 << 20

#: Coordinates whose feasible ranges are intersected, and the share of a bucket beyond which it is verified as a whole.
FOCUS = 4
WHOLE = 0.5

#: Lengths that the driver keeps of the groups, whatever their number.
KEPT_LENGTHS = 4096


def bucket_edges(lengths: np.ndarray) -> list[int]:
    """Where buckets of rows in the order of falling lengths begin, and the end of the last."""
    edges = [0]
    while edges[-1] < len(lengths):
        a = edges[-1]
        low = np.flatnonzero(lengths[a + LEAST_ROWS : a + BUCKET_ROWS] < LENGTH_SHARE * lengths[a])
        edges.append(min(a + LEAST_ROWS + int(low[0]) if len(low) else a + BUCKET_ROWS, len(lengths)))
    return edges


def integers(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """``vectors`` with ``v``, the floor of ``scale`` times each component, and its ``length``; null or non-finite vectors go.

    Components beyond the range of a long raise, as a cast does.
    """
    x = F.col(vec).cast("array<double>")
    sound = F.col(vec).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(sound).withColumn("v", F.transform(x, lambda c: F.floor(c * scale).cast("long")))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


class Bucket:
    """Rows of about one length: unit vectors, and for each coordinate its values in order with the rows they are of."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        lengths = np.sqrt((vectors.astype("f8") ** 2).sum(axis=1))
        self.longest, self.shortest = lengths.max(), lengths.min()
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T
        self.lists = np.take_along_axis(self.unit.T, self.order, axis=1)

    def candidates(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places of the rows whose score with an anchor may reach ``least``; None stands for all, an empty array for none.

        A cosine of c or more confines each coordinate of a row to a range round the anchor's; the ranges of the
        anchor's largest coordinates are cut out of the sorted lists and intersected.
        """
        reach = length * (self.longest if least > 0 else self.shortest)
        if reach <= 0:
            return np.empty(0, "i8") if least > 0 else None
        cosine = least / reach - 1e-9
        if cosine > 1:
            return np.empty(0, "i8")
        if cosine <= -1 or not len(unit):
            return None
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        beta, alpha = np.arccos(cosine), np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(alpha + beta, np.pi)) - 1e-9, np.cos(np.maximum(alpha - beta, 0)) + 1e-9
        cuts = [(np.searchsorted(self.lists[f], a, "left"), np.searchsorted(self.lists[f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        k = min(range(len(focus)), key=lambda i: cuts[i][1] - cuts[i][0])
        if cuts[k][1] - cuts[k][0] > WHOLE * len(self.ids):
            return None
        found = self.order[focus[k]][cuts[k][0] : cuts[k][1]]
        for i, f in enumerate(focus):
            if i != k:
                at = self.unit[found, f]
                found = found[(at >= low[i]) & (at <= high[i])]
        return found


class Group:
    """The buckets of a group, and the search of one anchor in them."""

    def __init__(self, rows: list[tuple[np.ndarray, ...]]):
        ids, labels, vectors = (np.concatenate([r[k] for r in rows]) for k in range(3))
        # sums of products below 2^53 are exact as doubles
        self.exact = bool(len(vectors)) and np.abs(vectors.astype("f8")).max(initial=0) ** 2 * max(vectors.shape[1], 1) < 2**53
        vectors = vectors.astype("f8" if self.exact else "i8")
        edges = bucket_edges(np.sqrt((vectors.astype("f8") ** 2).sum(axis=1)))
        self.buckets = [Bucket(ids[a:b], labels[a:b], vectors[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def search(self, anchor: int, label: int, vector: np.ndarray, same: bool, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the ids and scores of the first ``k`` rows in it, greatest score and then least id first.

        Rows have the anchor's label and aren't the anchor (``same``), or another label.  The least score that still counts
        rises with what was found, and prunes the buckets that follow.
        """
        vector = vector.astype("f8")
        length = float(np.sqrt((vector**2).sum()))
        unit = vector / length if length else vector
        exact = self.exact and np.abs(vector).max(initial=0) ** 2 * max(len(vector), 1) < 2**53
        vector = vector if exact else vector.astype("i8")
        best = [(np.empty(0, "i8"), np.empty(0, "i8"))] * len(windows)
        for bucket in self.buckets:
            bound = [max(low, s[k - 1]) if len(s) == k else low for (low, _), (_, s) in zip(windows, best, strict=True)]
            at = bucket.candidates(unit, length, min(bound))
            if at is None:
                at = slice(None)
            elif not len(at):
                continue
            of = bucket.vectors[at]
            score = (of if exact else of.astype("i8")) @ vector
            ids = bucket.ids[at]
            fit = (bucket.labels[at] == label) == same
            if same:
                fit &= ids != anchor
            fit &= score >= min(bound)
            score, ids = score[fit].astype("i8"), ids[fit]
            for i, (_, high) in enumerate(windows):
                inside = (score >= bound[i]) & (score <= high)
                if inside.any():
                    s, v = np.concatenate([best[i][1], score[inside]]), np.concatenate([best[i][0], ids[inside]])
                    first = np.lexsort((v, -s))[:k]
                    best[i] = v[first], s[first]
        return best


FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def searched(same: bool, k: int):
    """The function that reads groups, each followed by its anchors, and yields what the anchors find in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, group = None, [], None
        for batch in batches:
            groups, anchors = batch.column("group").to_numpy(), batch.column("is_anchor").to_numpy(zero_copy_only=False)
            ids, labels, vectors = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("v")
            flat, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(anchors.astype("i1")) != 0)) + 1
            out: list[list] = [[], [], [], [], []]
            for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a == b:
                    continue
                if groups[a] != at:
                    at, rows, group = groups[a], [], None
                if not anchors[a]:
                    rows.append((ids[a:b], labels[a:b], flat[ends[a] : ends[b]].reshape(b - a, -1)))
                    continue
                if not rows and group is None:
                    continue
                group, rows = group or Group(rows), []
                for i in range(a, b):
                    wanted = batch.column("wanted")[i].as_py() or [{"id": None, "score": None, "low": -np.inf, "high": np.inf}]
                    best = group.search(int(ids[i]), int(labels[i]), flat[ends[i] : ends[i + 1]], same, [(w["low"], w["high"]) for w in wanted], k)
                    for w, (found, score) in zip(wanted, best, strict=True):
                        for column, values in zip(out, ([ids[i]] * len(found), [w["id"]] * len(found), [w["score"]] * len(found), found, score), strict=True):
                            column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return run


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each ``by``, greatest score and then least id first, with ``rank`` from 1; groups bring ``k`` at most each."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _met(rows: DataFrame, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """``rows`` (with ``group``) and ``anchors`` (with ``first`` and ``last``, the groups to search, and ``wanted``) group by group.

    As many tasks as groups: the work of a group is its anchors times its rows, which its bytes don't tell.
    """
    columns = ["group", "is_anchor", "place", "vec_id", "label", "v", "wanted"]
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("score", T.LongType()), ("low", T.DoubleType()), ("high", T.DoubleType()))]))
    held = rows.select("group", F.lit(False).alias("is_anchor"), F.col("rank").alias("place"), "vec_id", "label", "v", F.lit(None).cast(kind).alias("wanted"))
    sent = anchors.where(F.col("last") >= F.col("first")).select(F.explode(F.sequence("first", "last")).alias("group"), F.lit(True).alias("is_anchor"), F.col("vec_id").alias("place"), "vec_id", "label", "v", F.col("wanted").cast(kind).alias("wanted"))
    dealt = held.select(columns).unionByName(sent.select(columns)).repartition(groups, "group").sortWithinPartitions("group", "is_anchor", "place")
    return map_batches(dealt, searched(same, k), FOUND)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vec: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """For each anchor and each of its first positives the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor is a row for which ``anchor`` holds.  Its positives are the ``positives`` best other rows of its label; negatives of a
    positive are the ``negatives`` best rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``.
    Greater scores come first, ties by the lesser id.

    Rows with a null id, label or vector or a null or non-finite component take no part.  Rows that repeat id, label and vector count once; an
    id of several labels or vectors stands for several rows, none of which is a positive of the others.  Missing components of
    shorter vectors count as 0, an empty vector as zeros; zero vectors score 0.  Other columns are left out.  An empty table, an anchor without another row
    of its label, or a positive without a fitting negative gives no row.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull()).withColumn("is_anchor", anchor)
    rows = integers(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("embedding"), "is_anchor"))
    rows = rows.groupBy("vec_id", "label", "v", "length").agg(F.max("is_anchor").alias("is_anchor"))
    rows = stored(rows, "integers")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or not width:
        width = 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    rows = rows.withColumn("shorter", -F.col("length"))
    in_group = max(BUCKET_ROWS, GROUP_BYTES // (8 * width))
    groups = max(1, -(-n // in_group))

    # positives: rows by label and length; an anchor visits the groups that hold its label
    by_label = ranged_numbers(rows, ["label", "shorter", "vec_id"], "rank", "by-label").withColumn("group", F.floor(F.col("rank") / in_group))
    spans = by_label.groupBy("label").agg(F.min("group").alias("first"), F.max("group").alias("last"))
    anchors = by_label.where("is_anchor").select("vec_id", "label", "v", "length")
    wanted = F.array().cast("array<struct<id:long,score:long,low:double,high:double>>")
    found = _met(by_label, anchors.join(spans, "label").withColumn("wanted", wanted), groups, True, positives)
    best = stored(first_of(found.select("anchor_id", "vec_id", "score").distinct(), ["anchor_id"], positives), "positives")

    # negatives: rows by length; an anchor visits the groups long enough for its least window
    by_length = ranged_numbers(rows.drop("is_anchor"), ["shorter", "vec_id"], "rank", "by-length").withColumn("group", F.floor(F.col("rank") / in_group))
    each = max(1, -(-groups // KEPT_LENGTHS))
    longest = by_length.groupBy((F.floor(F.col("group") / each)).alias("part")).agg(F.max("length").alias("length")).orderBy("part").collect()
    lengths = F.array(*(F.lit(r["length"]) for r in longest)) if longest else F.array().cast("array<double>")
    window = F.struct(F.col("vec_id").alias("id"), F.col("score"), F.ceil(F.col("score") * low / 100).cast("double").alias("low"), F.floor(F.col("score") * high / 100).cast("double").alias("high"))
    windows = best.where(F.col("score") * low <= F.col("score") * high).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window).alias("wanted"))
    least = F.array_min(F.transform("wanted", lambda w: w["low"]))
    sent = anchors.distinct().join(windows, "vec_id").withColumn("least", least)
    reached = F.size(F.filter(lengths, lambda x: x * F.col("length") * (1 + 1e-9) >= F.col("least")))
    sent = sent.withColumns({"first": F.lit(0).cast("long"), "last": F.least(reached * F.lit(each), F.lit(groups)).cast("long") - 1})
    found = _met(by_length, sent, groups, False, negatives)
    ranked = first_of(found.distinct(), ["anchor_id", "positive_id"], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
