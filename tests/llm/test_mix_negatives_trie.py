"""The source mix, hard negatives and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadspark.llm import hard_negatives, prefix_trie, source_mix

DOCS = "doc_id long, source string, text string, size string, taken string"


def sources(seed, n, names):
    rng = random.Random(seed)
    space = ["\t", " ", "\n", "\x0b\x0c\r", " \n "]
    return [(i, rng.choice(names), "".join(f"w{rng.randrange(99)}\xa0é" + rng.choice(space) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]


def plain_targets(sizes, weights, share, most):
    """Targets by handing out the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_reaches_targets(spark):
    rows = sources(3, 400, ["b", "a", "ä", "Z", None, "b", "b", "b"])
    rows += [(7, None, None), (None, "a", "one two"), (None, "a", None), (9, "a", "x y z"), (9, "a", "x y z"), (10, "only-empty", " \n"), (11, "b", "long " * 20_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    got = source_mix.taken(docs, block_words=16, shards=8).collect()
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[1], size[id(r)]) for r in rows)
    whole = defaultdict(int)
    for r in rows:
        whole[r[1]] += size[id(r)]
    target, used = plain_targets(whole, (5, 2, 1), 1.5, 2.0), defaultdict(int)
    for r in got:
        assert r["source_size"] == whole[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        used[r["source"]] += r["taken"]
    assert all(abs(used[s] - target[s]) <= 3 * 16 for s in whole)
    # the same in other numbers of tasks
    again = source_mix.taken(docs.repartition(3), block_words=16, shards=8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_slots_name_words(spark):
    rows = sources(5, 60, ["a", "b"])
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed, quotas = source_mix.plan(docs, (5, 2, 1), 1.5, 2.0, 16)
    mixed = source_mix.mix(placed, quotas, 16, 4).join(docs.select("doc_id", "text"), "doc_id")
    got = mixed.withColumn("words", source_mix.words_of(F.col("text"), F.col("first"), F.col("n_words"))).collect()
    blocks, shards = defaultdict(list), defaultdict(set)
    for r in got:
        assert len(r["words"]) == r["n_words"] and r["words"] == re.findall(r"[^\x20\x09-\x0D]+", r["text"])[r["first"] :][: r["n_words"]]
        blocks[r["shard"], r["slot"]].append(r["n_words"])
        shards[r["shard"]].add(r["slot"])
    assert all(s == set(range(len(s))) for s in shards.values())
    full = Counter(sum(b) for b in blocks.values())
    assert set(full) <= {16} | {n % 16 for (n,) in placed.groupBy("source_no").agg(F.sum("size")).select("sum(size)").collect()}
    assert quotas.agg(F.sum("slots")).first()[0] == len(blocks)
    # every word of a source comes once before any comes again
    times = defaultdict(Counter)
    for r in got:
        for w in range(r["n_words"]):
            times[r["source_no"]][r["doc_id"], r["first"] + w] += 1
    for s, n_words, slots, n_blocks in quotas.select("source_no", "n_words", "slots", "blocks").collect():
        if slots >= n_blocks:
            assert len(times[s]) == n_words


def test_shard_counts_are_multinomial(spark):
    quotas = spark.createDataFrame([(0, 60_000), (1, 20_000), (2, 0)], "source_no long, slots long")
    rows = source_mix.shard_counts(quotas, 50, 1).collect()
    for s, n in ((0, 60_000), (1, 20_000)):
        counts = [r["n"] for r in rows if r["source_no"] == s]
        assert sum(counts) == n
        chi = sum((c - n / 50) ** 2 / (n / 50) for c in counts)
        assert 25 < chi < 85  # 49 degrees of freedom


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 7, 30, 97, 1000, 1023):
        df = source_mix.permuted(spark.range(n), "at", F.col("id"), F.lit(n).cast("long"), [5, F.lit("k")])
        at = [r["at"] for r in df.orderBy("id").collect()]
        assert sorted(at) == list(range(n))
        assert n < 30 or at != list(range(n))


def test_mix_of_empty_table(spark):
    assert source_mix.taken(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    only = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in source_mix.taken(only).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def plain_negatives(rows, positives=5, negatives=5):
    """All scores of each anchor, sorted."""
    sound = {(i, label, tuple(math.floor(256 * c) for c in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for i, label, v in sound:
        if i % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: E731, B023
        best = sorted((-score(w), j) for j, other, w in sound if other == label and j != i)
        for p, j in list(dict.fromkeys(best))[:positives]:
            fit = sorted({(-score(w), k) for k, other, w in sound if other != label and 80 * -p <= 100 * score(w) <= 100 * -p})
            out |= {(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fit[:negatives])}
    return out


@pytest.mark.parametrize("kind", ["clustered", "lengths", "ties", "wide"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 64 * 8 * 8)
    rng = random.Random(kind)
    rows = []
    for i in range(700):
        v = [rng.gauss(0, 0.1) + (0.4 if (i % 4) == d else 0) for d in range(8)]
        if kind == "lengths":
            v = [c * 10 ** rng.uniform(-2, 2) for c in v]
        if kind == "ties":
            v = [float(rng.randrange(-1, 2)) for _ in v]
        if kind == "wide":
            v = [c * 1e6 for c in v]
        rows.append((i, rng.choice([0, 1, 2, 2, 2]), v))
    rows += [(1000, None, [1.0] * 8), (1100, 1, None), (1200, 2, [float("nan")] * 8), (1300, 0, [None] * 8), (None, 1, [1.0] * 8)]
    rows += [(1400, 0, [0.0] * 8), (1500, 1, []), (1600, 1, [0.5]), rows[0], rows[0], rows[105]]
    schema = "vec_id long, label int, embedding array<double>, rank string, length string"
    vectors = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    got = [tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_negatives(rows)


def test_coordinate_ranges_prune_and_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    bucket = hard_negatives.Bucket(np.arange(2000), np.zeros(2000, "i8"), vectors)
    seen = 0
    for q in vectors[:100]:
        length = np.sqrt(q @ q)
        least = 0.95 * length * length
        at = bucket.candidates(q / length, length, least)
        at = np.arange(2000) if at is None else at
        assert set(np.flatnonzero(vectors @ q >= least)) <= set(at)
        seen += len(at)
    assert seen < 0.3 * 100 * 2000
    assert hard_negatives.bucket_edges(np.array([100.0] * 500 + [50.0] * 3000)) == [0, 500, 2548, 3500]


def test_negatives_of_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0]), (100, 2, [])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c] = [t[2:] for t in sorted(convs[c])]
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    built = {c: tuple(convs.get(c - int(math.fmod(c, 5)), [])[: head[c]] + t[head[c] :]) for c, t in convs.items()}
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = Counter(t[:-1] for t in members if t), Counter(), Counter()
    for t, m in members.items():
        for d in range(len(t) + 1):
            saved[t[:d]] += (len(m) - 1) * len(t[-1][1].encode()) if t else 0
            leaves[t[:d]] += not children[t]
    sha = lambda t: hashlib.sha256(",".join(map(str, sorted(c for c in members[t] if built[c] == t))).encode()).hexdigest()
    return Counter((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), children[t], leaves[t], saved[t], sha(t)) for t, m in members.items())


def test_trie_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 3)
    rng = random.Random(8)
    texts = ["", "é", "a", "b", "hello there", None, "x" * 5000]
    rows = []
    for c in [*range(-7, 60), *range(1000, 1040)]:
        seeded = random.Random(c % 7 if c < 1000 else 1)  # copies, and near copies that part late
        n = seeded.randrange(0, 12)
        rows += [(c, t if rng.random() < 0.95 else None, seeded.choice(["user", "assistant", None]), seeded.choice(texts)) for t in range(n)]
    rows += [(3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, None, "a"), (None, 1, "user", "lost"), (55, 2, "1:u", "x"), (56, 2, "1:", "ux")]
    rows += [(77, t, "user", f"turn {t}") for t in range(600)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string, k0 string")
    got = Counter(tuple(r) for r in prefix_trie.trie(df.repartition(7)).collect())
    assert got == plain_trie(rows)


def test_trie_of_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "user", "hi")]  # takes 3 turns of conversation 0, which is absent, and leaves its own first three
    assert Counter(tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, schema)).collect()) == plain_trie(rows)
