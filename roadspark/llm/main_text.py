"""Main text of web pages by differencing each page with its nearest URLs on the same host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm.common import map_batches, with_fields
from roadspark.llm.url_filter import host, path

# Elements by what they mean for the text.
RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|object|title"
ASIDE = frozenset("nav footer aside form menu head button select dialog header".split())
MAIN = frozenset(("article", "main"))
BOXES = ASIDE | MAIN | frozenset("html body div section ul ol dl table figure details fieldset address center".split())
BLOCKS = BOXES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody caption pre blockquote figcaption summary hr legend option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

# Words of a class or id that name a part around the article.
PARTS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "share sharing social related recommended comment comments commentlist respond replies disqus widget login search toolbar pagination skip"
).split()

# Those that mean the same on any other element; the elements at whose start an open one of these ends; and elements without an end.
SMALL_PARTS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert popup "
    "newsletter subscribe signup share sharing social comment comments disqus widget login skip breadcrumb breadcrumbs pagination"
).split()
# Words that name reader comments on an article element; words beside which a part is absent or a state of the page; what has a heading of its own.
COMMENTS = "comment comments commentlist reply replies".split()
ABSENT = frozenset("no not non without off free less none hide hidden disabled has with open closed".split())
TEXTS = frozenset("article post entry story content page title".split())
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    rf"""<!--(?:.*?-->|.*\Z)
    |<(?P<raw>{RAW})(?=[\s/>])(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+>(?:.*?</(?P=raw)\s*+[^>]*+(?:>|\Z)|.*\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")

#: Names of the columns that the ranges are made by; columns of ``pages`` with these names are left out.
HOST, PATH = "__host", "__path"
#: Most bytes that the table of one alignment takes; longer pages are halved first.
TABLE_BYTES = 32 << 20
#: Two pages that share so much of their characters are copies of each other, not neighbours that share a template.
COPY = 0.9


def _named(value: str, words: list[str], leading: bool) -> bool:
    """Whether one of the names in a class or id stands for one of ``words``.

    A name of several words is what its last word says (post-comments), or its first if it is ``leading`` (sidebar-left, not an anchor as in a section's id); not if a word
    says that the part is absent (no-sidebar, ad-free), and not the header of a text (post-header).
    """
    for name in value.split():
        parts = WORD.findall(name)
        if name in words or len(parts) == 1 and parts[0] in words:
            return True
        if len(parts) < 2 or not ABSENT.isdisjoint(parts):
            continue
        if parts[-1] in words and not (parts[-1] == "header" and not TEXTS.isdisjoint(parts)) or leading and parts[0] in words:
            return True
    return False


def _around(name: str, attrs: str) -> bool:
    """Whether the attributes of an element name a part around the article, or hide it; an article is one only if it holds a reader's comment."""
    words = COMMENTS if name in MAIN else PARTS if name in BOXES else SMALL_PARTS
    box, heading = name in BOXES, len(name) == 2 and name[0] == "h" and name[1].isdigit()
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class" or key == "id" and box:
            if not heading and _named(value, words, name != "p" and not (key == "id" and name == "section")):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


@dataclass
class Page:
    """The visible lines (one for each block) of a page; where each stands; and which are shared with a neighbour."""

    lines: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    around: list[bool] = field(default_factory=list)
    shared: set[int] = field(default_factory=set)
    has_main: bool = False

    @classmethod
    def of(cls, source: str) -> Page:
        """Read a page.  The stack holds the open boxes, and of other elements those that stand around the article.

        An element inside a line (a link, a span) that stands around is left out of its line; it ends with the block that it is in.
        """
        page, stack, text, at = cls(), [], [], 0
        inline: list[list] = []  # name, and how many blocks were begun in it

        def flush() -> None:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                page.lines.append(line)
                page.inside.append(any(box[2] for box in stack))
                page.around.append(any(box[1] for box in stack))

        for m in TOKEN.finditer(source):
            if not inline:
                text.append(source[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name == "br":
                text.append(" ")
            attrs = m["attrs"]
            if name in BLOCKS:
                flush()
                for x in inline:
                    x[1] += -1 if m["end"] else 1
                while inline and inline[-1][1] < 0:
                    inline.pop()
                if not m["end"] and stack and name in ENDED_BY.get(stack[-1][0], ()):
                    stack.pop()
            elif m["end"]:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k:]
                        break
                continue
            elif attrs and name not in VOID and not attrs.endswith("/") and _around(name, attrs):
                inline.append([name, 0])
                continue
            if name not in BOXES and (m["end"] or not attrs or name in VOID or not _around(name, attrs)):
                if not m["end"] or not any(box[0] == name for box in stack):
                    continue
            if m["end"]:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    del stack[depth:]
                continue
            inner = any(box[2] for box in stack)
            aside = name not in BOXES or name in ASIDE and not (name == "header" and inner) or name not in ("html", "body") and _around(name, attrs)
            main = name in MAIN and not aside
            if main and not page.has_main:
                # a box that holds the article isn't around it, whatever it is called
                for box in stack:
                    box[1] &= box[0] in ASIDE or box[0] not in BOXES
            page.has_main |= main
            stack.append([name, aside, main])
        if not inline:
            text.append(source[at:])
        flush()
        return page

    def main_text(self) -> str:
        """What differencing leaves, checked against the markup.

        A line shared with a neighbour is deleted unless it stands in the page's article (pages that carry
        the same article, or repeat a passage, keep it); a line of the page alone is kept unless the markup says that it
        stands around the article.
        """
        kept = []
        for k, line in enumerate(self.lines):
            if self.around[k] or self.has_main and not self.inside[k] or k in self.shared and not self.inside[k]:
                continue
            kept.append(line)
        return "\n\n".join(kept)


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel alignment table: after each element of ``a``, bit j is 0 where b[j] lengthens the subsequence."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the longest common subsequence with each prefix of ``b``, from a row of the table."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(k, k) for k in range(head)]
    pairs += [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)]
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    if not p or not q or set(p).isdisjoint(q):
        return pairs
    if len(p) > 1 and len(p) * len(q) > TABLE_BYTES * 8:
        mid = len(p) // 2
        left = _lengths(_rows(p[:mid], q)[-1], len(q))
        right = _lengths(_rows(p[mid:][::-1], q[::-1])[-1], len(q))[::-1]
        cut = int(np.argmax(left + right))
        inner = common(p[:mid], q[:cut]) + [(i + mid, j + cut) for i, j in common(p[mid:], q[cut:])]
    else:
        rows, inner = _rows(p, q), []
        i, j = len(p) - 1, len(q) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1
            elif i and not rows[i - 1] >> j & 1:
                i -= 1
            else:
                inner.append((i, j))
                i, j = i - 1, j - 1
    return pairs + [(i + head, j + head) for i, j in inner]


def difference(one: Page, other: Page) -> None:
    """Mark the lines that an alignment of both pages shares, unless the pages are copies of each other."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in page.lines] for page in (one, other))
    pairs = common(a, b)
    size = sum(len(one.lines[i]) for i, _ in pairs)
    if size < COPY * max(sum(map(len, one.lines)), sum(map(len, other.lines))):
        one.shared.update(i for i, _ in pairs)
        other.shared.update(j for _, j in pairs)


def _runs(batches: Iterator[pa.RecordBatch], html: str, kept: list[str]) -> Iterator[tuple[tuple[str, str], list[pa.RecordBatch]]]:
    """Runs of rows with the same host and html: both, and the ``kept`` columns of the rows."""
    now: tuple[str, str] | None = None
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        light, start = batch.select(kept), 0
        for k, (name, source) in enumerate(zip(batch.column(HOST).to_pylist(), batch.column(html).to_pylist(), strict=True)):
            key = (name, source or "")
            if now is not None and key != now:
                if k > start:
                    rows.append(light.slice(start, k - start))
                yield now, rows
                rows, start = [], k
            now = key
        if batch.num_rows > start:
            rows.append(light.slice(start))
    if now is not None:
        yield now, rows


def _joined(parts: list[tuple[list[pa.RecordBatch], list]], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """The rows of several runs as one batch, each with the values of its run as further columns."""
    slices = [s for rows, _ in parts for s in rows]
    columns = list(pa.Table.from_batches(slices).combine_chunks().to_batches()[0].columns)
    times = [sum(s.num_rows for s in rows) for rows, _ in parts]
    new = [pa.array([v for (_, values), n in zip(parts, times, strict=True) for v in [values[k]] * n], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*columns, *new], names=[*slices[0].schema.names, *names])


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Replace ``html`` by ``text`` (main text, blocks joined by two line feeds) and ``n_chars`` (code points).

    Pages are ranged by host, then URL path, so that a page's nearest URLs on its host stand beside it; a host
    of any size spreads over many tasks.  Rows of the same html beside each other are one run; each run is aligned with the
    one before and the one behind it on its host and shared lines are marked, unless the two are copies but for edits; see
    ``Page.main_text``.  The first and the last run of a range are decided apart, with those of the ranges beside theirs,
    so the text doesn't depend on where ranges end, and rows that repeat a page have one text.
    A null html counts as empty and gives an empty text; a null URL has the empty host; repeated pages stay
    and keep their article; an empty table gives an empty one; other columns pass, but for those named like the new ones.
    """
    order = [HOST, PATH, key]
    at = {HOST: F.coalesce(host(F.col(url)), F.lit("")), PATH: F.coalesce(path(F.col(url)), F.lit(""))}
    ranged = pages.drop(HOST, PATH).withColumns(at).repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64(html))
    schema = with_fields(pages.drop(html, HOST, PATH), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))
    kept = [f.name for f in schema.fields if f.name not in ("text", "n_chars")]

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and texts of all runs but the first and the last."""
        before: tuple[str, Page, list[pa.RecordBatch], int] | None = None
        ready, size = [], 0
        for number, ((name, source), rows) in enumerate(_runs(batches, html, kept)):
            page = Page.of(source)
            if before:
                if before[0] == name:
                    difference(before[1], page)
                if before[3]:
                    text = before[1].main_text()
                    ready.append((before[2], [text, len(text)]))
                    size += len(text) * sum(r.num_rows for r in before[2])
            before = (name, page, rows, number)
            if size > 1 << 20:
                yield _joined(ready, ["text", "n_chars"], [pa.string(), pa.int64()])
                ready, size = [], 0
        if ready:
            yield _joined(ready, ["text", "n_chars"], [pa.string(), pa.int64()])

    def end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the first and the last run, with the run's number."""
        number, last = 2 * TaskContext.get().partitionId(), None
        for k, (_, rows) in enumerate(_runs(batches, html, kept)):
            if k:
                last = rows
            else:
                yield _joined([(rows, [number])], ["_run"], [pa.int64()])
        if last:
            yield _joined([(last, [number + 1])], ["_run"], [pa.int64()])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last run themselves, with what the runs beside them in the range share."""
        number, two, last = 2 * TaskContext.get().partitionId(), [], []
        for run, _ in _runs(batches, html, []):
            two, last = [*two, run] if len(two) < 2 else two, [*last[-1:], run]
        out = []
        for k, (mine, others) in enumerate(((two[:1], two[1:]), (last[1:], last[:1]))):
            for name, source in mine:
                page = Page.of(source)
                for other in others:
                    if other[0] == name:
                        difference(page, Page.of(other[1]))
                out.append((number + k, name, int.from_bytes(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), source, sorted(page.shared)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["_run", "_host", "_content", "_html", "_shared"])

    light = [schema[c] for c in kept]
    texts = _end_texts(map_batches(ranged, heads, "_run long, _host string, _content long, _html string, _shared array<int>"))
    ends = map_batches(ranged, end_rows, T.StructType([*light, T.StructField("_run", T.LongType())])).join(texts, "_run")
    ends = ends.withColumn("n_chars", F.length("text").cast("long")).select(*schema.names)
    return map_batches(ranged, inner, T.StructType([*light, schema["text"], schema["n_chars"]])).select(*schema.names).unionByName(ends)


def _end_texts(heads: DataFrame) -> DataFrame:
    """``(_run, text)`` of the first and last runs of the ranges, differenced with those of the ranges beside them too.

    Runs of the same page that meet where ranges meet are one.  Two rows at most for each range are here, and one task sees
    no more than their numbers, hosts and hashes.
    """
    before, ordered = F.lag(F.struct("_run", "_host", "_content")), Window.orderBy("_run")
    seen = heads.select("_run", "_host", "_content").withColumn("before", before.over(ordered))
    beside = F.coalesce(F.shiftright("before._run", 1) != F.shiftright("_run", 1), F.lit(False)) & (F.col("before._host") == F.col("_host"))
    seen = seen.withColumn("beside", beside).withColumn("new", ~(F.col("beside") & (F.col("before._content") == F.col("_content"))))
    seen = seen.withColumn("_whole", F.sum(F.col("new").cast("long")).over(ordered)).select("_run", "_whole", (F.col("beside") & F.col("new")).alias("meets"))
    wholes = heads.join(seen, "_run").groupBy("_whole").agg(F.min("_html").alias("html"), F.collect_list("_shared").alias("shared"), F.max("meets").alias("meets"))

    @F.udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def marks(a: str, b: str) -> list[list[int]]:
        one, other = Page.of(a), Page.of(b)
        difference(one, other)
        return [sorted(one.shared), sorted(other.shared)]

    @F.udf(T.StringType())
    def text_of(source: str, shared: list[list[int]]) -> str:
        page = Page.of(source)
        page.shared = {k for part in shared for k in part}
        return page.main_text()

    right = wholes.where("meets").select((F.col("_whole") - 1).alias("_whole"), F.col("html").alias("next"))
    met = wholes.join(right, "_whole").select("_whole", marks("html", "next").alias("m"))
    more = met.select("_whole", F.col("m")[0].alias("s")).unionByName(met.select(F.col("_whole") + 1, F.col("m")[1]).toDF("_whole", "s"))
    more = more.groupBy("_whole").agg(F.collect_list("s").alias("more"))
    told = wholes.join(more, "_whole", "left").select("_whole", text_of("html", F.concat("shared", F.coalesce("more", F.array().cast("array<array<int>>")))).alias("text"))
    return seen.select("_run", "_whole").join(told, "_whole").select("_run", "text")
