"""Token ids as ORC files in document order: run-length encoded integers, row indexes and Bloom filters."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from roadspark.llm.common import extended, map_batches, shared_dir, stored, texts, with_fields

#: Chunks whose ids a worker keeps between batches, of Latin ones and of others; beyond it their store starts anew.
KEPT_CHUNKS = 900_000

#: Characters at which ``str.split`` splits though the tokenizer doesn't take them for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"

#: How this kind of tokenizer splits a chunk, and the printable bytes that stand for themselves.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Characters beyond Latin letters.
BEYOND = re.compile("[^\0-\u024f]")

_STATE: dict = {}


class Chunks(dict):
    """A tokenizer that drops white space, and the packed ids of the lower-cased Latin chunks between white space met so far.

    Such a tokenizer's ids of a text are those of its chunks, one after another.  A new chunk of Latin
    letters is split here and its words go to the tokenizer's model; any other chunk goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.others: dict[str, bytes] = {}
        self.split = regex.compile(WORDS).findall
        others = iter(range(256, 512))
        self.visible = {b: b if b in PRINTABLE else next(others) for b in range(256)}

    @classmethod
    def of(cls, path: str) -> Chunks:
        if path not in _STATE:
            _STATE[path] = cls(path)
        return _STATE[path]

    def word(self, word: str) -> bytes:
        seen = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.visible)
        return array("i", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            packed = self.word(chunk)
        elif chunk[-1] in ",." and chunk[:-1].isalpha():
            packed = self[chunk[:-1]] + self[chunk[-1]]
        else:
            packed = b"".join(map(self.word, self.split(chunk)))
        self[chunk] = packed
        return packed

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def other(self, chunk: str) -> bytes:
        if not BEYOND.search(chunk):
            return self[chunk.lower()]
        if chunk not in self.others:
            self.others[chunk] = self.whole(chunk)
        return self.others[chunk]

    def encode(self, text: str) -> bytes:
        lowered = text.lower()
        if any(c in text for c in SEPARATORS) or any(t in lowered for t in self.special):
            return self.whole(text)
        if BEYOND.search(text):
            return b"".join(map(self.other, text.split()))
        return b"".join(map(self.__getitem__, lowered.split()))

    def bound(self) -> None:
        """Start anew beyond the bound."""
        for store in (self, self.others):
            if len(store) > KEPT_CHUNKS:
                store.clear()


def tokenize(docs: DataFrame, path: str, end_id: int | None = None, text: str = "text", keep: bool = True) -> DataFrame:
    """Add ``ids``, the ids (array of int) of each whole text, with ``end_id`` behind them if given.

    ``path`` names a file of the tokenizers library whose tokenizer drops white space; every executor has
    it.  The string of an added token in a text gives that token's id, as in the library.  A null text counts as empty; repeated rows stay; an
    empty table gives an empty one.  Without ``keep`` the text itself goes.
    """
    schema = with_fields(docs if keep else docs.drop(text), T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks.of(path)
        for batch in batches:
            chunks.bound()
            packed = [chunks.encode(t) + end for t in texts(batch, text)]
            offsets = np.cumsum([0] + [len(x) // 4 for x in packed]).astype("i4")
            rest = batch if keep else batch.select([n for n in batch.schema.names if n != text])
            yield extended(rest, {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))})

    return map_batches(docs, run, schema)


def write(docs: DataFrame, tokenizer: str, to: str, end_id: int | None = None, stride: int = 2000) -> None:
    """Tokenize ``docs`` and write ``(doc_id, place, ids)`` to ORC files below ``to`` in ascending order of doc_id.

    The documents are ranged by id and text hash before they are tokenized, so that the sample behind the ranges doesn't
    tokenize, each file holds the ids of one range, and one id of many texts spreads over several.  ``place`` orders
    all rows as they stand in the files: the number of the range, then that of the row in it.  Equal ids are ordered by
    their text's hash; null ids come first; an empty table gives no row.
    ORC stores the integers run-length encoded in stripes that tasks read in parallel, with a row index every
    ``stride`` rows and a Bloom filter on doc_id by which a lookup skips stripes and row groups.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select("doc_id", F.monotonically_increasing_id().alias("place"), "text")
    (
        tokenize(placed, tokenizer, end_id, keep=False)
        .select("doc_id", "place", "ids")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", stride)
        .option("orc.compress", "ZSTD")
        .orc(to)
    )


def read(spark: SparkSession, at: str) -> DataFrame:
    """``(doc_id, place, ids)`` of the files below ``at``; filters on doc_id reach the stripes' Bloom filters and row indexes."""
    integers = [T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType())]
    return spark.read.schema(T.StructType([*integers, T.StructField("ids", T.ArrayType(T.IntegerType()))])).orc(at)


def positions(spark: SparkSession, at: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    The ids are read once and reduced to their count and checksum where they are read.  The starts are sums in the
    order of ``place`` in two steps, over ranges (one row each) and inside a range, so no task sees all documents.
    """
    integers = ("doc_id", "place", "n_tokens", "ids_crc32")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in integers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            new = [pa.array(np.diff(at).astype("i8")), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *new], names=list(integers))

    # the number of the range is in the upper bits of the place
    counted = stored(map_batches(read(spark, at), run, schema), "counted").withColumn("range", F.shiftright("place", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("inside", F.sum("n_tokens").over(before.partitionBy("range").orderBy("place")))
    sums = counted.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("range", F.sum("n").over(before.orderBy("range")).alias("before"))
    start = F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))
    return inside.join(sums, "range").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, to: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (below ``to``, else a new folder of the shared ones) and read their positions back; none for an empty table."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, to, end_id)
    return positions(spark, to)
