import collections
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadspark.llm import decontamination, line_templates, near_duplicates, vector_links
from roadspark.llm.shingles import multisets, overlap, units

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
DOCS = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def bag(text):
    w = WORD.findall((text or "").lower().encode())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    a, b = bag(a), bag(b)
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else "zz" + w for w in text.split())


def corpus():
    rng = random.Random(11)
    out = [None, "", "?!", "one two", "One, two!"]
    for _ in range(8):
        base = prose(rng, rng.randrange(60, 200))
        out += [base, base, base.upper()] + [edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.05, 0.3)]
    out.append("same words here again and " * 300)
    out.append("same words here again and " * 290)
    out += [prose(rng, 40) for _ in range(20)]
    return out


def brute(texts, linked):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if linked(texts[i], texts[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 2])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = near_duplicates.classes(docs).collect()
    assert {r.k_id: r.class_id for r in rows} == brute(texts, lambda a, b: similarity(a, b) >= 0.8)
    kept = [r.k_id for r in rows if r.kept]
    assert sorted(kept) == sorted({r.class_id for r in rows})


def test_classes_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], DOCS)
    rows = near_duplicates.classes(docs).collect()
    assert len(rows) == 4
    assert [r.class_id for r in rows if r.k_id == 5] == [5, 5]
    assert near_duplicates.classes(docs.where("false")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    base = prose(rng, 300)
    pair = [base, edited(rng, base, 0.03)]
    repeats = ["x y z u v " * 30 + base, "x y z u v " * 60 + base]
    agree, truth = [], []
    for a, b in (pair, repeats):
        s, n, at = multisets(pa.array([a, b]))
        # many signatures from shifted hashes
        hits = []
        for k in range(40):
            sig = near_duplicates.signatures(s ^ np.uint64(k * 7919), n, at)
            hits.append((sig[0] == sig[1]).mean())
        agree.append(np.mean(hits))
        truth.append(similarity(a, b))
    assert np.allclose(agree, truth, atol=0.05)


def test_units_overlap_is_weighted_jaccard():
    rng = random.Random(4)
    for _ in range(20):
        a = prose(rng, 30)
        b = edited(rng, a, 0.1) + " " + a[:40]
        u, v = units(pa.array([a, b]))
        assert abs(overlap(u, v) - similarity(a, b)) < 1e-12


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 16))
    near = [b + rng.standard_normal(16) * s for b in base[:20] for s in (0.01, 0.1, 0.2, 0.3)]
    vectors = [*base, *near, base[0], base[0] * 3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 8)]
    got = {r.vec_id: r for r in vector_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in rows[: len(vectors)]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(got[i].n_links for i in range(len(vectors)))
    assert found >= 0.9 * s.sum()
    assert all(got[i].n_links <= s[i].sum() for i in range(len(vectors)))
    assert found == s.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907))
    assert got[len(vectors) - 1].component_id == 0 and not got[len(vectors) - 1].kept
    assert vector_links.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vector_links.fit(x, 3000)
    du, dv = index.distances(x[:5])
    for a, b in zip(du, dv, strict=True):
        cells = index.traverse(a, b)
        sums = [a[i] + b[j] for i, j in cells]
        assert sums == sorted(sums)
        grid = (a[:, None] + b[None] <= a.min() + b.min() + index.reach).sum()
        assert len(cells) == grid


def multiplied(index, x):
    """Share of all pairs that the searches multiply, and of the pairs at the least cosine or more that they find from either side."""
    du, dv = index.distances(x)
    i, j = du.argmin(1), dv.argmin(1)
    seen = np.zeros((len(x), len(x)), bool)
    for k in range(len(x)):
        for first, run in index.runs(du[k], dv[k]):
            seen[k] |= (i == first) & np.isin(j, run)
    near = np.triu(x @ x.T >= vector_links.COSINE, 1)
    return seen.mean(), (near & (seen | seen.T)).sum() / near.sum()


def test_grid_prunes_more_as_rows_grow():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    x = np.repeat(centres, 100, 0) + 0.9 * rng.standard_normal((4000, 64))
    x[2000:] = x[:2000] + 0.2 * rng.standard_normal((2000, 64))
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1)[:, None]
    few, many = (multiplied(vector_links.fit(x[:n], n), x[:n]) for n in (500, 4000))
    assert many[0] < few[0] / 1.5 and many[0] < 0.15
    assert min(few[1], many[1]) >= 0.99


def test_only_visited_cells_are_compared():
    rng = np.random.default_rng(4)
    y = rng.standard_normal((60, 6))
    y /= np.linalg.norm(y, axis=1)[:, None]
    x = y[:20].copy()
    cells = np.arange(60) % 7
    visited, search = np.array([c for s in (0, 1) for c in (cells[:20] + s) % 7]), np.array([*range(20), *range(20)])
    a, b = vector_links.candidates(visited, search, cells, x, y)
    met = {(int(s), t) for v, s in zip(visited, search, strict=True) for t in range(60) if cells[t] == v}
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(s, t) for s, t in met if x[s] @ y[t] >= vector_links.COSINE}


def test_decontamination_finds_edited_copies_only(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (15, 25, 40, 60)]
    docs, want = [], set()
    for k, item in enumerate(items):
        for share in (0.0, 0.1):
            want.add((len(docs), k))
            docs.append(f"{prose(rng, 80)} {edited(rng, item, share)} {prose(rng, 50)}")
    docs += [prose(rng, 200) for _ in range(20)] + [None, "", items[0].split()[0]]
    d = spark.createDataFrame(list(enumerate(docs)), DOCS)
    i = spark.createDataFrame([*enumerate(items), (90, None), (91, "one")], "item_id long, text string")
    got = {(r.k_id, r.item_id) for r in decontamination.contaminated(d, i).collect()}
    assert got == want
    assert decontamination.contaminated(d.where("false"), i).count() == 0
    assert decontamination.contaminated(d, i.where("false")).count() == 0


def runs_of_three(text):
    w = WORD.findall(text.lower().encode())
    return set(zip(w, w[1:], w[2:], strict=False))


def plain_score(item, text):
    """Best local alignment of all of both texts, as a share of the item's full match."""
    a, b = WORD.findall(item.lower().encode()), WORD.findall(text.lower().encode())
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, row[j] - 1))
        h, best = row, max(best, *row)
    return best / (2 * len(a))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    common = ["of", "the", "and", "to"]
    items = [prose(rng, n) for n in (12, 20, 33, 48)] + [" ".join(rng.choice(common) for _ in range(14)), "of the and"]
    docs = []
    for item in items:
        for share in (0.0, 0.1, 0.2, 0.3, 0.5):
            docs.append(f"{prose(rng, 40)} {edited(rng, item, share)} {prose(rng, 30)}")
    docs += [" ".join(rng.choice(common) if rng.random() < 0.5 else prose(rng, 1) for _ in range(300)) for _ in range(10)]
    names = ["a", "b", "b", None, "e", "f"]
    d = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(docs)], "doc_id string, text string")
    got = {(r.k_id, r.item_id): r.score for r in decontamination.contaminated(d, spark.createDataFrame(list(zip(names, items, strict=True)), "item_id string, text string")).collect()}
    want = {}
    for k, text in enumerate(docs):
        for name, item in zip(names, items, strict=True):
            score = plain_score(item, text)
            if score >= decontamination.LEAST_SCORE and runs_of_three(item) & runs_of_three(text):
                want[f"d{k}", name] = max(score, want.get((f"d{k}", name), 0))
    assert len(want) > 15 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_alignment_equals_plain_table():
    rng = random.Random(8)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 15))], np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_template_lines_go_and_copies_stay(spark):
    rng = random.Random(6)
    rows = []
    for k in range(12):
        body = [prose(rng, 12) for _ in range(4)]
        rows.append((k, "\n".join([*body, f"Posted by user{k} on 2020-01-{k:02d} in the forum", "All rights reserved."])))
    copy = "\n".join(prose(rng, 12) for _ in range(4))
    rows += [(100 + k, copy) for k in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n")]
    got = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("k_id", "gone", "lines", "n_lines")})).collect()}
    for k in range(12):
        assert got[k].n_dropped == 2
        assert got[k].text == "\n".join(rows[k][1].split("\n")[:4])
    assert all(got[100 + k].text == copy for k in range(30))
    assert got[200].text is None and got[201].text == "" and got[202].text == "\n\n"
    assert line_templates.drop_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_document_of_a_hundred_thousand_dropped_lines(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join([*(prose(rng, 12) for _ in range(3)), "Read more on our site today"])) for k in range(8)]
    rows.append((99, "\n".join(["Read more on our site today"] * 100_000 + ["the end of a story"])))
    began = time.time()
    got = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[99].n_dropped == 100_000 and got[99].text == "the end of a story"
    assert time.time() - began < 90


@pytest.mark.parametrize("by_family", [False, True])
def test_fields_side_by_side_and_in_lines_of_any_length_go(spark, by_family):
    rng = random.Random(30)
    name = lambda: "".join(rng.choice("aeinrstlou") for _ in range(7)).title()
    long = [prose(rng, 1) for _ in range(50)]
    rows = []
    for k in range(14):
        body = [prose(rng, 12) for _ in range(5)]
        wide = " ".join(w if j % 4 else name() for j, w in enumerate(long, 2))
        rows.append((k, "\n".join([*body, f"Posted by {name()} {name()} in the travel forum today", f"Logged in as {name()}", f"The start {wide}"])))
    # lines that begin alike but share too few tokens stay
    rows += [(50 + k, "\n".join([*(prose(rng, 12) for _ in range(4)), f"Posted by {prose(rng, 7)}", f"Here and {name()} too much {prose(rng, 5)}"])) for k in range(12)]
    got = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(rows, DOCS), by_family=by_family).collect()}
    for k, text in rows:
        kept = text.split("\n")[:5] if k < 50 else text.split("\n")
        assert got[k].text == "\n".join(kept), k


def rows_generated(plan):
    """Rows that the explodes of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_generated(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return rows_generated(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(rows_generated(plan.children().apply(i)) for i in range(plan.children().size()))


def test_tokens_of_leaves_need_no_row_each_and_templates_equal_plain_version(spark):
    rng, sizes = random.Random(41), [8] * 30 + [300]
    lines = []
    for leaf, size in enumerate(sizes):
        base = [prose(rng, 1) for _ in range(18)]
        for k in range(size):
            m = " ".join(["at", f"leaf{leaf}", *(w if rng.random() < 0.7 else rng.choice("abc") + prose(rng, 1) for w in base)])
            lines += [(leaf * 1000 + k, leaf, k % 7, m), (leaf * 1000 + k, leaf, rng.randrange(7), m)]
    kinds, want = collections.defaultdict(set), {}
    for _, leaf, kind, m in lines:
        for place, token in enumerate(m.split(" ")[2:]):
            kinds[leaf, place, token].add(kind)
    for whole, leaf, _, m in lines:
        fixed = tuple((p, t) for p, t in enumerate(m.split(" ")[2:]) if len(kinds[leaf, p, t]) >= 5)
        if len(fixed) + 2 >= 10:
            want[whole] = (leaf, fixed)
    told = line_templates.templates(spark.createDataFrame(lines, "whole long, leaf long, kind long, m string"))
    got = {r.whole: r.template for r in told.collect()}
    assert got.keys() == want.keys() and 0 < len(got)
    both = {(want[k], got[k]) for k in want}
    assert len(both) == len({w for w, _ in both}) == len({g for _, g in both})
    # before, each token of each different line was a row, twice
    assert rows_generated(told._jdf.queryExecution().executedPlan()) < 18 * sum(sizes)


def test_long_line_of_few_unrelated_documents_goes(spark):
    rng = random.Random(16)
    passage, short = prose(rng, 60), prose(rng, 6)
    rows = [(k, "\n".join([prose(rng, 12), passage, short, *(prose(rng, 12) for _ in range(3))])) for k in range(3)]
    rows += [(9, "\n".join(prose(rng, 60) for _ in range(3)))]
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    assert got == {k: "\n".join(x for x in text.split("\n") if x != passage) for k, text in rows}


def test_edited_copies_neither_save_nor_make_a_template(spark):
    rng = random.Random(17)
    footer, other = "all rights reserved by the makers of this site", "imprint and contact"
    rows = [(k, "\n".join([*(prose(rng, 14) for _ in range(4)), footer, other])) for k in range(12)]
    body = [prose(rng, 30) for _ in range(5)]
    for k in range(60):
        lines = [edited(rng, x, 0.04) for x in body]
        rows.append((100 + k, "\n".join([*lines, footer])))
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    assert got == {k: "\n".join(x for x in text.split("\n") if x not in (footer, other)) for k, text in rows}


def test_verified_pairs_of_a_block_are_kept(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 8))
    x = np.concatenate([base + 0.12 * rng.standard_normal(base.shape) for _ in range(8)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    one = vector_links.MultiIndex(np.zeros((1, 4)), unit[:20, 4:], 4.0)
    monkeypatch.setattr(vector_links, "fit", lambda *a, **k: one)
    got = {r.vec_id: r.n_links for r in vector_links.links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    near = unit @ unit.T >= vector_links.COSINE
    assert got == {k: int(near[k].sum()) - 1 for k in range(len(x))}


def test_pairs_of_a_crowded_block_come_in_parts_and_a_search_goes_to_few_blocks(monkeypatch):
    """A thousand near copies in one cell, in chains that only later parts join."""
    random = np.random.default_rng(5)
    middle = np.linspace(0, 1.2, 600)
    x = np.stack([np.cos(middle), np.sin(middle), *random.normal(0, 1e-3, (2, 600))], 1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(vector_links, "PRODUCTS", 5000)
    order = random.permutation(600)
    side = {"node": np.arange(600)[order], "n": 1, "unit": [r.tobytes() for r in x[order]]}
    searches = pd.DataFrame(side | {"run": [np.zeros(1, "<u2").tobytes()] * 600, "own_i": 0, "own_j": 0})
    block = pd.DataFrame({f"b_{k}": v for k, v in side.items()} | {"b_j": 0, "b_bound": 0.0})
    parts = list(vector_links.meetings(np.zeros(600, int), np.arange(600), np.zeros(600, int), x, x))
    assert len(parts) > 10 and max(len(a) for a, _ in parts) < 10_000
    got = vector_links._verify({})((4,), searches, block).set_index("node")
    near = x @ x.T >= vector_links.COSINE
    assert got["links"].to_dict() == {k: int(near[k].sum()) - 1 for k in range(600)}
    assert got["joined"].nunique() == 1
    # 51,282 vectors with 57 codes of a half: 900 rows and 15,400 searches of a first code were 16 parts
    assert vector_links.BLOCK >= 4096
