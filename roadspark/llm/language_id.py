"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import extended, map_batches, released, texts, with_fields

#: n-grams of a profile, of a language as of a document.
PROFILE = 400
#: Longest n-gram.
LONGEST = 3
#: Labelled rows from which profiles are learned; more are thinned out by a hash of their id.
TRAIN_ROWS = 20_000

UNDETERMINED = "und"

_ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
#: Bits of a code point; three of them fit a long.
_BITS = 21


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the letters of a whole text; runs of anything else are one blank.

    A letter is its code point.  The blank is 1, which no letter is, so no two n-grams share a code.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _ALPHA[points]
    code = np.where(letter, points, 1).astype(np.int64)
    kept = np.ones(len(code), bool)
    kept[1:] = letter[1:] | letter[:-1]
    code = code[kept]
    code = np.pad(code, (int((code[:1] > 1).all()), int((code[-1:] > 1).all())), constant_values=1)
    out = [code[code > 1]]
    joined = code
    for k in range(1, LONGEST):
        joined = joined[:-1] << _BITS | code[k:]
        out.append(joined)
    return np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and how often each occurs."""
    codes = np.sort(codes)
    edge = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(edge, append=len(codes))


@dataclass
class Profiles:
    """Rank of each n-gram in each language's profile; ``PROFILE`` where it has none."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str) -> tuple[str, float]:
        """The language whose profile is nearest by out-of-place distance, and how far it stands out (0 to 1).

        The score is the share by which the nearest distance falls below the second; a tie goes to the
        first name.  Without a letter, or without any profile, the answer is ``und`` with 0.
        """
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        codes, n = counted(grams(text))
        top = codes[np.argsort(-n, kind="stable")[:PROFILE]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], PROFILE)
        place = np.arange(len(top))[:, None]
        apart = np.where(ranks < PROFILE, np.abs(ranks - place), PROFILE).sum(0)
        order = np.argsort(apart, kind="stable")
        best = apart[order[0]]
        second = apart[order[1]] if len(order) > 1 else PROFILE * len(top)
        return self.langs[order[0]], float(1 - best / second) if second else 0.0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of the labelled rows: the ``PROFILE`` most frequent n-grams of each language (ties by code).

    At most about ``rows`` rows are read for it, chosen by a hash of ``key`` (the text by default), so the
    choice doesn't depend on partitions; rows whose text or label is null are left out.  Only counts come to
    the driver, ``PROFILE`` for each language.  An empty table gives no profile.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    there = labelled.count()
    part = min(1.0, rows / max(there, 1))
    key = F.col(text) if key is None else key
    labelled = labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < round(part * (1 << 20)))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(grams(t))
            for name, codes in by.items():
                gram, n = counted(np.concatenate(codes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = map_batches(labelled.select(F.col(text), F.col(lang)), count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    langs = sorted({r.lang for r in found})
    codes = np.array(sorted({r.gram for r in found}), np.int64)
    ranks = np.full((len(codes), len(langs)), PROFILE, np.int32)
    for r in found:
        ranks[np.searchsorted(codes, r.gram), langs.index(r.lang)] = r.rank - 1
    return Profiles(langs, codes, ranks)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (see ``Profiles.predict``) for each whole text.

    Null and empty texts, and texts without a letter, are ``und`` with 0.  Repeated rows stay; columns named
    like the new ones are replaced; an empty table gives an empty one.  No other column enters a prediction.
    """
    schema = with_fields(docs, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in texts(batch, text)]
            yield extended(batch, {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})
            del batch, found
        released()

    return map_batches(docs, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
