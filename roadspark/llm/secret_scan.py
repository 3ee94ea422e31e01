"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Everything here is column expressions on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import stored

# The kinds in their order, their patterns, the group whose length counts, and the least length.
# A match of ``AKIA[A-Z0-9]+`` or ``[0-9a-f]+`` is a whole run, so the least length can stand in the pattern; one of the
# first pattern that is too short still hides others that overlap it, so its length counts afterwards.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = [("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32)]

# Symbols of each encoding, the narrowest first.
ENCODINGS = [
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", ".+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]

#: A candidate is a run of this many encoding symbols or more.
LEAST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST
#: Length strata, each with a false-discovery control of its own: lower bounds.
STRATA = (20, 28, 40, 64)
#: Share of false discoveries that a stratum may hold, and the level of each randomness test.
FDR, LEVEL = 0.01, 0.001
#: Of running text: chance that two letters, or three, are equal, and changes of character class a symbol.
PAIR, TRIPLE, CHANGES = 0.066, 0.0055, 0.08

#: Matches whose places are summed up one after another.
BLOCK = 128

SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def below(z: Column) -> Column:
    """Normal distribution function, by its logistic approximation."""
    z = F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def matches(text: Column, pattern: str, kind: str, kind_no: int) -> Column:
    """All leftmost, non-overlapping matches with their places in code points.

    What stands between the matches comes from ``split`` and the matches from ``regexp_extract_all``; the
    places are running sums of both lengths.  An array that grows in ``aggregate`` is copied at each step, so the sums are
    made in blocks of ``BLOCK`` matches, and between blocks: texts of a million matches take no longer for each.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["gap"]).cast("int")
        end = (start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int")
        span = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).cast(SPAN).alias("spans"))

    def placed(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(block["steps"], start, step, lambda acc: acc["spans"])

    def all_of(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, F.lit(BLOCK)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: (n + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ats"))
        ats = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + length(b)).cast("int").alias("at"), F.concat(acc["ats"], F.array(acc["at"])).alias("ats")), lambda acc: acc["ats"])
        return F.flatten(F.transform(F.zip_with(ats, blocks, lambda at, b: F.struct(at.alias("at"), b.alias("steps"))), placed))

    # a one-element array binds the steps once
    return F.transform(F.array(steps), all_of)[0]


def long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, ordered by start, then kind."""
    out = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        found = F.filter(matches(text, pattern, kind, no), long_enough(pattern, group, least))
        out.append(F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*out))


def battery(value: Column) -> Column:
    """The tests of one candidate, as a struct.

    Against uniform symbols of the inferred encoding: ``p_chi`` (chi-squared), ``p_runs`` (runs of upper and
    lower half of the alphabet) and ``p_serial`` (correlation with the next symbol): a candidate has to pass all three.
    A discovery is made against running text: ``p_text`` is Fisher's combination of the same two statistics' lower
    and upper tails there.  The chi-squared statistic is linear in how often two symbols are equal, which running text does
    far more often than uniform symbols; runs are those of the character classes, which text hardly changes.
    """
    body = F.rtrim(F.translate(value, "-_=", "+/ "))
    size, symbols = F.lit(0), F.lit("")
    for _, pattern, alphabet in reversed(ENCODINGS):
        fits = body.rlike(f"^(?:{pattern})$")
        size = F.when(fits, F.lit(len(alphabet))).otherwise(size)
        symbols = F.when(fits, F.lit(alphabet)).otherwise(symbols)
    plain = F.when(size <= 36, F.when(symbols.startswith("0"), F.lower(body)).otherwise(body)).otherwise(body)
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    made = F.struct(
        F.length(body).cast("double").alias("n"),
        size.cast("double").alias("k"),
        F.transform(chars, lambda c: (F.instr(symbols, c) - 1).cast("double")).alias("x"),
        chars.alias("chars"),
        body.alias("body"),
    )

    def tests(s: Column) -> Column:
        n, k, x = s["n"], s["k"], s["x"]
        zero = F.lit(0.0)
        squares = F.aggregate(F.array_distinct(s["chars"]), zero, lambda a, c: a + F.pow(F.size(F.filter(s["chars"], lambda d: d == c)).cast("double"), 2.0))
        chi = k * squares / n - n
        p_chi = 1 - below((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        up = F.aggregate(x, zero, lambda a, v: a + (v * 2 >= k).cast("double"))
        runs = 1 + F.aggregate(pairs, zero, lambda a, p: a + ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double"))
        expected = 1 + 2 * up * (n - up) / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        p_runs = 2 * below(-F.abs((runs - expected) / spread))
        mean = F.aggregate(x, zero, lambda a, v: a + v) / n
        around = F.aggregate(x, zero, lambda a, v: a + (v - mean) * (v - mean))
        along = F.aggregate(pairs, zero, lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        p_serial = 2 * below(-F.abs(along / F.greatest(around, F.lit(1e-9)) * F.sqrt(n)))
        equal = (squares - n) / (n * (n - 1))
        vary = F.sqrt((2 * PAIR * (1 - PAIR) + 4 * (n - 2) * (TRIPLE - PAIR * PAIR)) / (n * (n - 1)))
        classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(s["body"], "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "0"), " ", "")
        changes = F.length(classes).cast("double") - 1
        p_changes = 1 - below((changes - CHANGES * n - 0.5) / F.sqrt(CHANGES * n))
        q = F.greatest(below((equal - PAIR) / vary) * p_changes, F.lit(1e-30))
        return F.struct(p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), (q * (1 - F.log(q))).alias("p_text"), n.alias("n"))

    # a one-element array binds the struct once for all tests
    return F.transform(F.array(made), tests)[0]


def candidates(text: Column) -> Column:
    """Runs of encoding symbols that pass the randomness tests, with their stratum and the bucket of ``p_text``.

    Bucket b holds p from 10^(-(b+1)/10) to 10^(-b/10).  Runs that fail a test, or have under ``LEAST``
    symbols without padding, are kept with bucket -1: they count among a stratum's hypotheses.
    """
    found = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE, "random", len(BASE))).otherwise(F.array().cast(SPAN))
    tested = F.transform(found, lambda s: F.struct(s.alias("span"), battery(s["value"]).alias("t")))

    def judged(c: Column) -> Column:
        t = c["t"]
        random = (t["n"] >= LEAST) & (t["p_chi"] >= LEVEL) & (t["p_runs"] >= LEVEL) & (t["p_serial"] >= LEVEL)
        bucket = F.when(random, F.floor(-10 * F.log10(t["p_text"]))).otherwise(-1).cast("int")
        stratum = F.lit(0)
        for k, least in enumerate(STRATA[1:], 1):
            stratum = F.when(t["n"] >= least, k).otherwise(stratum)
        return F.struct(c["span"].alias("span"), F.coalesce(bucket, F.lit(-1)).alias("bucket"), stratum.alias("stratum"))

    return F.transform(tested, judged)


def thresholds(tested: DataFrame) -> dict[int, int]:
    """Per stratum the least bucket that is a discovery by Benjamini and Hochberg's rule at ``FDR``.

    Counts by bucket, at most a few hundred for each of the strata, come to the driver.
    """
    counts = tested.select(F.explode("candidates").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bucket").alias("bucket")).count().collect()
    out = {}
    for k in range(len(STRATA)):
        by = sorted(((r.bucket, r["count"]) for r in counts if r.stratum == k), reverse=True)
        all_of, seen = sum(n for _, n in by), 0
        for bucket, n in by:
            seen += n
            if bucket >= 0 and 10 ** (-bucket / 10) <= FDR * seen / all_of:
                out[k] = bucket
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``base`` and ``spans``: arrays of (start, kind_no, kind, end, value).

    ``base`` holds the spans of the fixed patterns.  ``spans`` adds, as kind ``random``, the runs of
    encoding symbols that look like uniform symbols and unlike running text, unless they overlap a base
    span.  Both are ordered by start, then kind.  A null text counts as empty; repeated rows stay; an empty
    table gives an empty one.  Columns named ``base`` or ``spans`` are replaced.  The texts are read once;
    what was found is stored in the shared folder, since the false-discovery control needs all of it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in (text, "base", "spans", "candidates")]
    tested = stored(docs.select(*kept, base_spans(whole).alias("base"), candidates(whole).alias("candidates")), "secrets")
    least = thresholds(tested)
    added = F.array().cast(SPAN)
    if least:

        def discovered(c: Column) -> Column:
            found = F.lit(False)
            for k, bucket in least.items():
                found = found | ((c["stratum"] == k) & (c["bucket"] >= bucket))
            return found & ~F.exists("base", lambda b: (b["start"] < c["span"]["end"]) & (c["span"]["start"] < b["end"]))

        added = F.transform(F.filter("candidates", discovered), lambda c: c["span"])
    return tested.withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
