import random
import zlib
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.orc as orc
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from roadspark.llm import byte_bpe, token_files

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    letters = "aab  \n'\tsé中🎉́ 0123lreTHEİΣς\x1c\xa0-., ﬁ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [None, "", "a" * 3000, "ab" * 1500, " " * 700, "x <|endoftext|> y", *out]


def test_byte_bpe_equals_library_and_round_trips(spark):
    all_texts = texts()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        want = np.array(enc.encode_ordinary(all_texts[r.doc_id] or ""), "<u4").tobytes()
        assert bytes(r.token_ids) == want
        assert r.n_tokens == len(want) // 4
        assert bytes(r.decoded) == (all_texts[r.doc_id] or "").encode()


def test_byte_bpe_decodes_in_the_worker_that_encodes(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("decoded", F.lit("clash"))
    apart = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    at_once = byte_bpe.encode(docs, PATH, P.PATTERN, decoded=True)
    assert at_once.schema == apart.schema
    assert at_once.orderBy("doc_id").collect() == apart.orderBy("doc_id").collect()
    docs = docs.select("doc_id", F.lit("en").alias("lang"), F.lit("web").alias("source"), "text")
    assert corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def _mb_left_by_a_task() -> float:
    """How much more a process holds after a task over 8 MB of different words than with the vocabulary alone."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) / 1024

    def tables():
        rng = random.Random(3)
        for _ in range(8):
            rows = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(90)) for _ in range(1000)]
            yield pa.RecordBatch.from_pydict({"text": rows})

    byte_bpe.map_batches = lambda docs, run, schema: run
    run = byte_bpe.encode(SimpleNamespace(schema=T.StructType([T.StructField("text", T.StringType())])), PATH, P.PATTERN)
    for _ in run(iter([pa.RecordBatch.from_pydict({"text": ["unheardof"]})])):
        pass
    before, n = held(), 0
    for out in run(tables()):
        n += out.num_rows
    del out
    assert n == 8000
    return held() - before


def test_byte_bpe_leaves_a_worker_with_the_vocabulary_only():
    with ProcessPoolExecutor(1, mp_context=get_context("spawn")) as one:
        assert one.submit(_mb_left_by_a_task).result() < 30


def test_byte_bpe_of_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_token_files_hold_ids_in_order(spark, tmp_path):
    all_texts = texts()
    docs = spark.createDataFrame([(7 * i % 1009, t) for i, t in enumerate(all_texts)], "doc_id long, text string").withColumn("ids", F.lit(1))
    at = str(tmp_path / "tokens")
    rows = {r.doc_id: r for r in token_files.token_files(docs, WORDS, 2, at).collect()}
    tok, start = Tokenizer.from_file(WORDS), 0
    by = {7 * i % 1009: t for i, t in enumerate(all_texts)}
    for doc_id in sorted(by):
        ids = np.array([*tok.encode(by[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(spark, at).where("doc_id = 7").count() == 1


def test_special_strings_give_the_ids_of_the_library(spark):
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "x", " ", "é", "中", "'s", "12", "<|", "|>", "\n", "of\u0301"]
    said = ["x <|endoftext|> y", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    tok = Tokenizer.from_file(WORDS)
    for r in token_files.tokenize(docs, WORDS).collect():
        assert r.ids == tok.encode(said[r.doc_id], add_special_tokens=False).ids, said[r.doc_id]


def test_token_files_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (1, None)], "doc_id long, text string")
    rows = token_files.token_files(docs, WORDS, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 3, 3]
    assert [r.start for r in rows] == [0, 3, 4, 6]
    assert token_files.tokenize(docs.where("false"), WORDS, 2).count() == 0
    assert token_files.token_files(docs.where("false"), WORDS, 2).count() == 0


def test_starts_of_equal_ids_are_those_of_the_files(spark, tmp_path):
    said = ["one two three", "a", "here are some more words, as it seems."]
    docs = spark.createDataFrame([(k % 4, said[k % 3]) for k in range(60)], "doc_id long, text string")
    at = str(tmp_path / "tokens")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, WORDS, 2, at).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    # the files themselves, in the order of their ranges, row by row
    start, want = 0, []
    for path in sorted(tmp_path.glob("tokens/part-*"), key=lambda p: int(p.name.split("-")[1])):
        for r in orc.read_table(path).to_pylist():
            packed = np.array(r["ids"], "<u4").tobytes()
            want.append((start, r["doc_id"], len(r["ids"]), zlib.crc32(packed)))
            start += len(r["ids"])
    assert got == want and [w[1] for w in want] == sorted(w[1] for w in want)
    assert len(list(tmp_path.glob("tokens/part-*"))) > 1


def test_lookup_skips_row_groups(spark, tmp_path):
    docs = spark.range(3000).select((F.col("id") * 2).alias("doc_id"), F.lit("some words").alias("text"))
    at = str(tmp_path / "tokens")
    token_files.write(docs.coalesce(1), WORDS, at, 2, stride=1000)

    def rows_read(doc_id):
        found = token_files.read(spark, at).where(f"doc_id = {doc_id}")
        n = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        return n, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    n, read = rows_read(200)
    assert n == 1 and read <= 1000
    # an odd id lies between those of a row group: only the Bloom filter tells
    assert rows_read(201) == (0, 0)


def test_scalar_and_vector_replay_agree():
    merges = byte_bpe.Merges(byte_bpe.load_ranks(PATH))
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"aaabtheion \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    assert [x.tolist() for x in byte_bpe.replay(pieces, merges)] == [byte_bpe._replay_one(p, merges).tolist() for p in pieces]
