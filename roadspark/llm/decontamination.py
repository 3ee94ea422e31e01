"""Benchmark decontamination: rare n-gram seeds find test items in texts, local alignment scores the copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import map_batches, stored
from roadspark.llm.shingles import shingles, words

#: Words of a seed.  A copy with a fifth of its words edited still has such a run unedited.
SEED = 3
#: A seed is rare if chance alone, from its words' frequencies, makes it this often in a million words of text.
RARE = 10.0
#: An item with fewer rare seeds than this uses all of its seeds.
LEAST_SEEDS = 8
#: Score of a match, a mismatch and a gap; least score of a copy as a share of a full match.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.6
#: Bits of a filter, whatever the number of items: a million for words, four million (twice) for seeds.
WORD_BITS, SEED_BITS = 20, 22


def _bits(df: DataFrame, column: str, bits: int, shift: int = 0) -> np.ndarray:
    """Bitmap of ``bits`` address bits of the hashes in ``column``; the addresses, at most 2^bits, come to the driver."""
    found = df.select(F.shiftright(column, shift).bitwiseAND((1 << bits) - 1).cast("int").alias("b")).distinct().toArrow()
    flags = np.zeros(1 << bits, bool)
    flags[found.column("b").to_numpy()] = True
    return np.packbits(flags, bitorder="little")


def _has(bitmap: np.ndarray, hashes: np.ndarray, bits: int, shift: int = 0) -> np.ndarray:
    at = (hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _item_seeds(items: DataFrame) -> DataFrame:
    """``(item, n_words, packed, seeds)``: each different text by its hash, with its seeds and the hashes of their words; fewer words give none."""
    schema = T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("packed", T.BinaryType()),
            T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("w", T.ArrayType(T.LongType()))]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = words(batch.column("text"))
            s, edge = shingles(batch.column("text"), SEED)
            rows = []
            for k, item in enumerate(batch.column("item").to_pylist()):
                w = h[at[k] : at[k + 1]]
                found = s[edge[k] : edge[k + 1]].view(np.int64) if len(w) >= SEED else ()
                seeds = [{"seed": int(x), "w": w[i : i + SEED].view(np.int64).tolist()} for i, x in enumerate(found)]
                rows.append({"item": item, "n_words": len(w), "packed": w.tobytes(), "seeds": seeds})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.int64()), ("n_words", pa.int64()), ("packed", pa.binary()), ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("w", pa.list_(pa.int64()))])))]))

    return map_batches(items.select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"]), run, schema)


def _word_counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(word, n)`` over all texts, for the words in ``bitmap``; the row with a null word counts all words."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _ = words(batch.column("text"))
            mine = np.sort(h[_has(bitmap, h, WORD_BITS)]).view(np.int64)
            first = np.flatnonzero(np.diff(mine, prepend=mine[:1] - 1)) if len(mine) else np.zeros(0, np.int64)
            word = pa.concat_arrays([pa.array(mine[first]), pa.nulls(1, pa.int64())])
            n = np.concatenate([np.diff(first, append=len(mine)), [len(h)]])
            yield pa.RecordBatch.from_arrays([word, pa.array(n, pa.int64())], names=["word", "n"])

    return map_batches(docs.select("text"), run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``(item, seed)``: the seeds of each item that chance makes rarely, given how often the corpus has each word.

    An item that has fewer than ``LEAST_SEEDS`` of them keeps all its seeds, so common words alone don't hide it.
    """
    seeds = items.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", "s.w").distinct()
    vocabulary = seeds.select(F.explode("w").alias("word")).distinct()
    counts = stored(_word_counts(docs, _bits(vocabulary, "word", WORD_BITS)), "words")
    all_words = counts.where("word IS NULL").select("n").first()
    total = float(all_words.n if all_words else 0) or 1.0
    share = F.log((F.coalesce("n", F.lit(0)) + 0.5) / total)
    spread = seeds.select("item", "seed", F.explode("w").alias("word")).join(counts.where("word IS NOT NULL"), "word", "left")
    chance = stored(spread.groupBy("item", "seed").agg((F.exp(F.sum(share)) * 1e6 <= RARE).alias("rare")), "chance")
    enough = chance.groupBy("item").agg((F.count_if("rare") >= LEAST_SEEDS).alias("enough"))
    return chance.join(enough, "item").where("rare OR NOT enough").select("item", "seed")


def _passages(docs: DataFrame, bitmaps: list[np.ndarray], margin: int) -> DataFrame:
    """Passages of each text around words that start a seed: ``(k_id, k_text, start, packed, seeds)``.

    Hits up to ``margin`` words apart share a passage, which reaches ``margin`` words beyond its outer hits.
    """
    keyed = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_text"), "text")
    schema = T.StructType(
        [
            *keyed.schema.fields[:2],
            T.StructField("start", T.LongType()),
            T.StructField("packed", T.BinaryType()),
            T.StructField("seeds", T.ArrayType(T.LongType())),
        ]
    )
    names = [f.name for f in schema.fields]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            h, at = words(text)
            s, edge = shingles(text, SEED)
            hits = np.flatnonzero(_has(bitmaps[0], s, SEED_BITS) & _has(bitmaps[1], s, SEED_BITS, SEED_BITS))
            doc = np.searchsorted(edge, hits, "right") - 1
            place = hits - edge[doc] + at[doc]
            cut = np.flatnonzero((np.diff(place, prepend=-1) > margin) | (np.diff(doc, prepend=-1) > 0)).tolist()
            out: list[list] = [[] for _ in types]
            of = []
            for a, b in zip(cut, [*cut[1:], len(hits)][: len(cut)], strict=True):
                d = int(doc[a])
                low, high = max(at[d], place[a] - margin), min(at[d + 1], place[b - 1] + SEED + margin)
                of.append(d)
                row = (int(low - at[d]), h[low:high].tobytes(), s[hits[a:b]].view(np.int64).tolist())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            keys = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("k_id", "k_text")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=names)

    return map_batches(keyed, run, schema)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment (Smith-Waterman) of two runs of words: its score and the passage's word behind it."""
    row = np.zeros(len(passage) + 1, np.int64)
    places = np.arange(len(passage) + 1)
    best, end = 0, 0
    for word in item:
        down = row + GAP
        down[1:] = np.maximum(down[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        np.maximum(down, 0, out=down)
        row = np.maximum.accumulate(down - places * GAP) + places * GAP
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _scored(pairs: DataFrame) -> DataFrame:
    schema = T.StructType([*[f for f in pairs.schema.fields if f.name in ("k_id", "k_text", "item")], T.StructField("score", T.DoubleType()), T.StructField("end", T.LongType())])
    names = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        for batch in batches:
            score, end = [], []
            rows = (batch.column(c).to_pylist() for c in ("whole", "packed", "start"))
            for item, packed, start in zip(*rows, strict=True):
                if (item, packed) not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[item, packed] = align(np.frombuffer(item, np.uint64), np.frombuffer(packed, np.uint64))
                best, at = known[item, packed]
                score.append(best / (MATCH * max(len(item) // 8, 1)))
                end.append(start + at)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64()), pa.array(end, pa.int64())], names=[*names, "score", "end"])

    return map_batches(pairs, run, schema)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(k_id, k_text, item_id, score, end)``: each row of ``docs`` (doc_id, text) with each item it holds a copy of.

    ``score`` is the best local alignment's share of the item's full match, ``LEAST_SCORE`` or more; ``end``
    is the number of the word behind it.  ``k_text`` is the text's hash.  A copy has three words of the item
    in a row: one with words replaced that scores so much does (but for items of a few words), as replacing one in every three
    leaves half the score; one with words put in between all others may not.  Each text of ``items`` counts by itself: those that share an id are all looked for, and
    the best of them is told; ids may be of any type, and null.  Items of fewer than three words
    match nothing; null texts count as empty; repeated rows share their answer; empty tables give an empty one.

    Only filters of a fixed size go to all tasks.  The passages that pass them meet the seeds, and then
    the items, in joins; a passage that a third of all texts have is joined like any other.
    """
    parsed = stored(_item_seeds(items), "items")
    seeds = stored(rare_seeds(parsed, docs), "seeds")
    longest = parsed.agg(F.max("n_words")).first()[0] or 0
    bitmaps = [_bits(seeds, "seed", SEED_BITS), _bits(seeds, "seed", SEED_BITS, SEED_BITS)]
    # the number of a passage stays, since the passages are read from files
    passages = stored(_passages(docs, bitmaps, longest).withColumn("passage", F.monotonically_increasing_id()), "passages")
    met = passages.select("passage", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds, "seed").select("passage", "item").distinct()
    whole = parsed.select("item", F.col("packed").alias("whole"))
    pairs = met.join(passages.drop("seeds"), "passage").join(whole, "item").select("k_id", "k_text", "start", "item", "packed", "whole")
    found = _scored(pairs).where(F.col("score") >= LEAST_SCORE)
    names = items.select(F.xxhash64("text").alias("item"), "item_id").distinct()
    best = F.max(F.struct("score", "end")).alias("best")
    return found.join(names, "item").groupBy("k_id", "k_text", "item_id").agg(best).select("k_id", "k_text", "item_id", "best.score", "best.end")
