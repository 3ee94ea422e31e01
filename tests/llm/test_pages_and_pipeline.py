import importlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadspark.llm import main_text, queries, url_filter

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First<br>line &eacute;</p><p>Second
 line</p><div class="comments"><p>Nice!</p></div></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_one_page(spark):
    rows = [(1, "http://a.b/c", PAGE), (2, None, None), (3, "http://a.b/d", ""), (4, "http://a.b/e", PAGE), (4, "http://a.b/e", PAGE), (5, "x", "<p>cut <b"), (6, "y", "a<b &lt; c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    want = "Title & more\n\nFirst line é\n\nSecond line"
    assert got[1] == got[4] == want
    assert (got[2], got[3], got[5]) == ("", "", "cut")
    assert main_text.extract(pages).count() == len(rows)
    assert main_text.extract(pages.where("false")).count() == 0


def test_shared_lines_of_pages_without_article_go(spark):
    page = "<body><div>Our site</div><div>Best offers</div><p>{}</p><div>Imprint</div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(f"Story number {k}")) for k in range(5)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {k: f"Story number {k}" for k in range(5)}


def test_text_does_not_depend_on_ranges(spark):
    page = "<body><div>Our site</div><div>Best offers</div><p>{}</p><div>Imprint</div></body>"
    rows = [(k, f"http://h.example/{k % 7}/{k}", page.format(f"Story number {k}")) for k in range(20)] + [(90, "http://other.example/", page.format("Alone")), (91, "http://z.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    seen = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = main_text.extract(pages)
            assert out.columns == ["page_id", "url", "text", "n_chars"]
            seen.append({r.page_id: (r.text, r.n_chars) for r in out.collect()})
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    alone = "Our site\n\nBest offers\n\nAlone\n\nImprint"
    want = {k: f"Story number {k}" for k in range(20)} | {90: alone, 91: ""}
    assert all(s == {k: (t, len(t)) for k, t in want.items()} for s in seen)


PARTED = """<body><article><h2 class="article-header">Head</h2><p class='advert'>Buy now<p>Real <a class='share' href="/x">Tweet</a>text.</p><p hidden>hid</p>
<ul><li class="promo">Offer<li>Point</ul><p data-id="menu">Kept <span style="display: none">no</span>too<img class="ad" src="x"> well</p><p>Open <a class="ad">link</p><p>After</p>
<table><tr><td class="ad-slot">x<td>Cell</table></article></body>"""


def test_parts_on_any_element_go():
    assert main_text.Page.of(PARTED).main_text() == "Head\n\nReal text.\n\nPoint\n\nKept too well\n\nOpen\n\nAfter\n\nCell"


def plain_texts(rows):
    """The rule on one machine: runs of one page on a host, each differenced with the one before and behind."""
    at = lambda u: ((u or "").split("://")[-1].split("/")[0] if "://" in (u or "") else "", "/" + (u or "").split("://")[-1].partition("/")[2])
    runs = []
    for k, u, h in sorted(rows, key=lambda r: (*at(r[1]), r[0])):
        if not runs or runs[-1][:2] != (at(u)[0], h or ""):
            runs.append((at(u)[0], h or "", main_text.Page.of(h or ""), []))
        runs[-1][3].append(k)
    for a, b in zip(runs, runs[1:], strict=False):
        if a[0] == b[0]:
            main_text.difference(a[2], b[2])
    return {k: page.main_text() for _, _, page, keys in runs for k in keys}


def test_copies_are_no_neighbours_in_any_ranges(spark):
    page = "<body><div>Our site</div><div>Best offers</div><p>{}</p><div>Imprint</div></body>"
    story = page.format("Story about a house</p><p>Second par")
    rows = [(k, "http://one.example/a", story) for k in range(2)]
    rows += [(10 + k, f"http://h.example/{k // 9:02d}", page.format(f"Story number {k // 9} of many")) for k in range(60)]
    rows += [(100 + k, f"http://c.example/{k}", page.format("A long story that stays the same " * 20 + "</p><p>" + ("Old" if k else "New"))) for k in range(2)]
    rows += [(200 + k, "http://hot.example/x", story) for k in range(40)] + [(300, "http://hot.example/z", page.format("Other"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_texts(rows)
    assert want[0] == want[1] == "Our site\n\nBest offers\n\nStory about a house\n\nSecond par\n\nImprint"
    assert want[10] == "Story number 0 of many" and want[200] == "Story about a house\n\nSecond par" and "Imprint" in want[100]
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 7, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(r.page_id, r.text) for r in main_text.extract(pages).collect()]
            assert sorted(got) == sorted(want.items())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_common_subsequence_is_longest(monkeypatch):
    rng = random.Random(3)
    for table in (main_text.TABLE_BYTES, 1):
        monkeypatch.setattr(main_text, "TABLE_BYTES", table)
        for _ in range(300):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in "ab")
            d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
            pairs = sorted(main_text.common(a, b))
            assert len(pairs) == d[-1][-1]
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, item = prose(80), prose(30)
    rows = [(k, prose(60), "en", "s", 1) for k in range(20)] + [(30, base, "en", "s", 1), (31, base + " more", "en", "s", 1), (31, base + " more", "en", "s", 1)]
    rows += [(40, f"{prose(30)} {item} {prose(30)}", "en", "s", 1), (50, "12345 !!", "en", "s", 1), (51, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).withColumns({c: F.lit("mine") for c in ("extra", "score", "n_lines", "k_id")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            assert out.where("extra <> 'mine' OR score <> 'mine' OR n_lines <> 'mine' OR k_id <> 'mine'").isEmpty()
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert 50 not in seen[0] and 51 not in seen[0] and len(seen[0]) == len(rows) - 2
    assert seen[1] == seen[0]
    assert seen[2] == [*range(20), 30, 40]
    assert seen[3] == seen[4] == [*range(20), 30]


def test_pipeline_stages_of_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "some words of a text that stands alone", "en", "s", 38), (2, None, None, None, None), (3, "", "en", "s", 0)]
    full = spark.createDataFrame(rows, columns).withColumns({c: F.lit("mine") for c in ("k_id", "k_text", "item_id", "token_ids", "decoded", "n_tokens")})
    full.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        none = stage(spark, full.where("false"), str(tmp_path))
        assert none.count() == 0 and (none.columns == full.columns or name == "byte-level BPE")
    kept = stages["benchmark decontamination"](spark, full, str(tmp_path))
    assert kept.columns == full.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    got = {r.doc_id: r.n_tokens for r in stages["byte-level BPE"](spark, full, str(tmp_path)).collect()}
    assert got[1] > 0 and got[2] == got[3] == 0
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_url_statistics_come_from_all_labelled_rows(spark, monkeypatch):
    rows = [(k, f"http://a.block/{k}") for k in range(300)] + [(300 + k, f"http://b{k}.allow/x/y") for k in range(300)] + [(900, "http://q.other/")]
    pages = spark.createDataFrame(rows + [(1000 + k, "http://hot.allow/x") for k in range(300)], "page_id long, url string")
    kept, shares = {}, {}
    old = url_filter.stored

    def spy(df, what):
        kept[what] = old(df, what)
        return kept[what]

    monkeypatch.setattr(url_filter, "stored", spy)
    rules = [("block", "block/"), ("allow", "allow/")]
    got = url_filter.judge(pages, rules, rows=90)
    assert got.count() == len(rows) + 300
    shares = {r.suffix: r.f_suffix for r in kept["suffix"].collect()}
    assert shares == {"block": 301 / 302, "allow": 1 / 602}
    # the copies of one URL are thinned out like the others
    assert 0 < kept["urls"].where("host = 'hot.allow'").count() < 100 and kept["urls"].count() < 200


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='site no-sidebar'><article><p>Text</p></article></div>", "Text"),
        ("<div class='content ad-free'><p>Text</p></div>", "Text"),
        ("<div id='comments-off'><p>Text</p></div>", "Text"),
        ("<div class='sidebar-layout'><div class='sidebar-left'><p>Links</p></div><article><p>Text</p></article></div>", "Text"),
        ("<article><div class='post-header'><h1>Title</h1></div><p>Text</p></article>", "Title\n\nText"),
        ("<article><section id='social-policy'><p>Text</p></section><p class='share-price'>Price</p></article>", "Text\n\nPrice"),
        ("<article><p>Text</p></article><article class='comment'><p>I agree</p></article>", "Text"),
        ("<article><p>Text</p><div class='post-comments'><article class='comment-body'><p>I agree</p></article></div></article>", "Text"),
        ("<article><p>Text</p><div class='share-buttons'>Share</div><div class='ad'>Buy</div><div id='related-posts'>More</div><div class='entry-comments'>Said</div></article>", "Text"),
    ],
)
def test_names_of_parts(html, want):
    assert main_text.Page.of(f"<html><body>{html}</body></html>").main_text() == want
