"""Mixing sources to target weights: fixed-length blocks of words, drawn into output shards by source.

Column expressions, joins and aggregates only.  Words are the stretches between white space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import ranged_numbers, ranged_sums, stored

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Slots that one row is unfolded to at most.
SLOTS_A_ROW = 4096


def pseudorandom(*parts: Column | int) -> Column:
    """A long of at least 0 that depends on all ``parts`` alone."""
    return F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)).bitwiseAND(F.lit((1 << 62) - 1))


def permuted(df: DataFrame, name: str, index: Column, n: Column, key: Sequence[Column | int], rounds: int = 6) -> DataFrame:
    """``df`` with ``name``: where the permutation of 0 to n - 1 that ``key`` names puts ``index``.

    A Feistel network over a grid of about sqrt(n) by sqrt(n) cells that holds n or few more; an index that falls on a
    cell beyond n walks on until it comes back.  A grid has fewer than sqrt(n) cells beyond n, so the walk is that short, and
    over all indexes it costs less than one step an index.
    """
    wide = F.greatest(F.floor(F.sqrt(n)).cast("long"), F.lit(1).cast("long"))
    df = df.withColumns({"_n": n, "_wide": wide})
    df = df.withColumn("_high", F.floor((F.col("_n") + F.col("_wide") - 1) / F.col("_wide")).cast("long"))
    wide, high, beyond = F.col("_wide"), F.col("_high"), F.col("_wide") * F.col("_high") - F.col("_n")
    df = df.withColumns({"_left": F.floor(index / high).cast("long"), "_right": index % high})
    for r in range(rounds):
        if r % 2:
            df = df.withColumn("_right", (F.col("_right") + pseudorandom(*key, r, F.col("_left"))) % high)
        else:
            df = df.withColumn("_left", (F.col("_left") + pseudorandom(*key, r, F.col("_right"))) % wide)

    def one_round(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, (s["l"] + pseudorandom(*key, r, s["r"])) % wide).otherwise(s["l"])
        right = F.when(r % 2 == 1, (s["r"] + pseudorandom(*key, r, s["l"])) % high).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def step(x: Column) -> Column:
        cell = F.struct(F.floor(x / high).cast("long").alias("l"), (x % high).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), cell, one_round, lambda s: s["l"] * high + s["r"])

    df = df.withColumn("_at", F.col("_left") * high + F.col("_right"))
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(beyond, F.lit(1).cast("long"))), F.col("_at"), lambda x, _: F.when(x < F.col("_n"), x).otherwise(step(x)))
    at = F.when(F.col("_at") < F.col("_n"), F.col("_at")).otherwise(walk)
    return df.withColumn(name, at).drop("_n", "_wide", "_high", "_left", "_right", "_at")


def packed(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Stored rows (source_no, source, doc_id, size, start, row): each document's place in the stream of its source's words.

    Sources are numbered from 0 by code point, null last.  Documents of a source stand in the order of a hash of id and
    text; ``start`` counts the words before.  ``row`` tells all rows apart, repeated ones too.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(doc).alias("doc_id"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(doc, text).alias("hash"))
    rows = rows.withColumn("absent", F.col("source").isNull())
    order = ["absent", "source", "hash", "doc_id", "size"]
    placed = ranged_sums(rows, order, ["absent", "source"], {"size": "start"}, "packed").withColumnRenamed("place", "row")
    names = ranged_numbers(placed.select("absent", "source").distinct(), ["absent", "source"], "source_no", "sources")
    same = [placed["absent"] == names["absent"], placed["source"].eqNullSafe(names["source"])]
    return stored(placed.join(names, same).select("source_no", placed["source"], "doc_id", "size", "start", "row"), "packed")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source_no, n_words) with ``target``: ``share`` of all words by weight, none above ``most`` times its own.

    Weights go round the sources in their order.  What the capped sources leave is shared by weight among the others until none
    is above; each round is one aggregate, and only its three numbers come to the driver.
    """
    sizes = stored(sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))), "sizes")
    rate, capped = 0.0, -1
    while True:
        full = F.col("n_words") * most <= F.col("weight") * rate
        n, held, open_weight, words = sizes.agg(F.count_if(full), F.sum(F.when(full, F.col("n_words"))), F.sum(F.when(~full, F.col("weight"))), F.sum("n_words")).first()
        if n == capped:
            return sizes.withColumn("target", F.when(full, F.col("n_words") * most).otherwise(F.col("weight") * rate))
        capped = n
        rate = (share * (words or 0) - most * (held or 0)) / open_weight if open_weight else rate


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """(source_no, block, row, doc_id, first, n_words): the part of each document in each block of its source's stream."""
    begin, end = F.col("start"), F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))
    rows = placed.where("size > 0").select("source_no", "row", "doc_id", "start", "size", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("block") * block_words, begin)
    return rows.select("source_no", "block", "row", "doc_id", (low - begin).alias("first"), (F.least((F.col("block") + 1) * block_words, end) - low).alias("n_words"))


def tasks(df: DataFrame) -> int:
    """The tasks that rows about to be unfolded are dealt to; named, as the rows' own size would ask for one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_counts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, n, before): the multinomial count of each source's slots in each output shard.

    Each of a source's ``slots`` draws its shard, so a shard's counts are multinomial by the sources' targets, while each
    source's counts sum to its slots.  ``before`` counts the slots of the source in the shards before.
    """
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS_A_ROW))
    rows = quotas.where("slots > 0").select("source_no", "slots", F.explode(chunks).alias("chunk")).repartition(tasks(quotas), "source_no", "chunk")
    low = F.col("chunk") * SLOTS_A_ROW
    rows = rows.select("source_no", F.explode(F.sequence(low, F.least(low + SLOTS_A_ROW, F.col("slots")) - 1)).alias("slot"))
    drawn = rows.groupBy("source_no", (pseudorandom(seed, F.col("source_no"), F.col("slot")) % shards).alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, slot, source_no, block): the block that fills each slot.

    A source's slots are numbered through all shards; the n-th takes block ``n % blocks`` under the pseudorandom permutation of
    its pass ``n / blocks`` over the source, so no block comes twice before all came once.  In its shard a slot's place is
    permuted too, so sources alternate.
    """
    counts = shard_counts(quotas, shards, seed)
    inside = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"ahead": F.coalesce(F.sum("n").over(inside), F.lit(0)), "in_shard": F.sum("n").over(Window.partitionBy("shard"))})
    counts = counts.join(quotas.select("source_no", "blocks"), "source_no")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS_A_ROW))
    rows = counts.select("*", F.explode(chunks).alias("chunk")).repartition(tasks(quotas), "source_no", "shard", "chunk")
    low = F.col("chunk") * SLOTS_A_ROW
    rows = rows.select("*", F.explode(F.sequence(low, F.least(low + SLOTS_A_ROW, F.col("n")) - 1)).alias("k"))
    rows = rows.withColumn("nth", F.col("before") + F.col("k"))
    turn = F.floor(F.col("nth") / F.col("blocks"))
    rows = permuted(rows.withColumn("turn", turn), "block", F.col("nth") % F.col("blocks"), F.col("blocks"), [seed + 1, F.col("source_no"), F.col("turn")])
    rows = permuted(rows, "slot", F.col("ahead") + F.col("k"), F.col("in_shard"), [seed + 2, F.col("shard")])
    return rows.select("shard", "slot", "source_no", "block")


def plan(docs: DataFrame, weights: Sequence[float], share: float, most: float, block_words: int, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(placed, quotas): the documents in their sources' streams, and each source's target, blocks and slots.

    A source has as many slots as blocks of its mean length reach its target, rounded, and never over ``most`` times its blocks.
    """
    placed = packed(docs, **columns)
    sizes = targets(placed.groupBy("source_no").agg(F.sum("size").alias("n_words")), weights, share, most)
    blocks = F.ceil(F.col("n_words") / block_words)
    quotas = sizes.withColumn("blocks", blocks).withColumn("slots", F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("n_words"))), F.lit(0)).cast("long"))
    return placed, stored(quotas.withColumn("slots", F.least("slots", F.floor(F.col("blocks") * most))), "quotas")


def mix(placed: DataFrame, quotas: DataFrame, block_words: int = 128, shards: int = 64, seed: int = 11) -> DataFrame:
    """The mix, one row for each document's part in each slot: (shard, slot, source_no, block, row, doc_id, first, n_words).

    ``plan`` makes ``placed`` and ``quotas``.  A slot's block has ``block_words`` words (the last of a source may have fewer): of each document
    named, the ``n_words`` words from ``first`` on, in the order of ``row``; ``words_of`` cuts them out.  The same rows give the same mix in
    any number of tasks.
    """
    # a merge join: unfolded rows are many more than their size before says, so they aren't to be broadcast
    return slots(quotas, shards, seed).hint("merge").join(pieces(placed, block_words), ["source_no", "block"]).select("shard", "slot", "source_no", "block", "row", "doc_id", "first", "n_words")


def words_of(text: Column, first: Column, n_words: Column) -> Column:
    """The words of a text from ``first`` (0 is the first word) on, as an array."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), (first + 1).cast("int"), n_words.cast("int"))


def taken(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 128, shards: int = 64, seed: int = 11, **columns: str) -> DataFrame:
    """Per row of ``docs``: doc_id, source, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of it.

    Null and empty texts have no words and give none; a null source is one of its own, the last; a null id is an id; repeated rows
    count each; other columns are left out; an empty table gives an empty one.  A document's words come in ``most`` passes at
    most, so ``taken`` is never over ``most`` times its size.
    """
    placed, quotas = plan(docs, weights, share, most, block_words, **columns)
    used = mix(placed, quotas, block_words, shards, seed).groupBy("source_no", "row").agg(F.sum("n_words").alias("taken"))
    whole = placed.join(quotas.select("source_no", F.col("n_words").alias("source_size"), "target"), "source_no")
    return whole.join(used, ["source_no", "row"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
