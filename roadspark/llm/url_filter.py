"""URL filter: host and path rules, and boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import stored

#: Labelled URLs from which the trees are trained; more are thinned out by a hash of row key and URL.
TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 3
#: Parts of the labelled URLs; the statistics of a training row come from the parts it isn't in.
FOLDS = 5

FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_escapes", "f_https", "f_suffix", "f_extension"]

#: Names that the features and the trees use; columns of ``pages`` of these names step aside for them.
SCRATCH = [*FEATURES, "suffix", "extension", "fold", "features", "rawPrediction", "probability", "prediction", "label"]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one, and for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.  A rule is (verdict, ``host/path``)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")

        def part(acc: Column, c: Column) -> Column:
            share = F.size(F.filter(chars, lambda d: d == c)) / n
            return acc - share * F.log2(share)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), part)

    # a one-element array binds the characters once
    return F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), of)[0]


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that need no statistics, and the two suffixes, from ``url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "f_length": length,
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "f_labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
            "f_digits": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(length, F.lit(0.0)), F.lit(0.0)),
            "f_entropy": entropy(url),
            "f_params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "f_hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
            "f_escapes": F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")).cast("double"),
            "f_https": url.startswith("https").cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
            "extension": F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)),
        }
    )


def blocked_share(counts: DataFrame, by: str, name: str, of: list[int] | None = None) -> DataFrame:
    """Smoothed share of blocked URLs for each value of ``by``, of which there may be many, in ``counts`` by fold.

    Given ``of``, one row for each value and each of these folds, with the share in all other folds.
    """
    share = lambda blocked, n: ((blocked + 1) / (n + 2)).alias(name)
    mine = counts.groupBy(by, "fold").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    every = mine.groupBy(by).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    if of is None:
        return every.select(by, share(F.col("all_blocked"), F.col("all_n")))
    rows = every.withColumn("fold", F.explode(F.array(*map(F.lit, of)))).join(mine, [by, "fold"], "left")
    less = lambda c: F.col(f"all_{c}") - F.coalesce(c, F.lit(0))
    return rows.select(by, "fold", share(less("blocked"), less("n")))


class Method:
    """Boosted trees on the lexical features of labelled URLs, and the shares of blocked URLs by suffix and extension.

    ``urls`` has url, host, path, label (1 for block) and a hash ``pick``, by which ``rows`` of them at most (about) train the
    trees; the shares are of all of them.  A training row's own shares come from the other folds, so the trees don't
    see its label there.
    """

    def __init__(self, urls: DataFrame, rows: int):
        folded = urls.withColumn("fold", F.pmod("pick", F.lit(FOLDS)).cast("int"))
        counts = stored(lexical(folded).groupBy("suffix", "extension", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), "shares")
        part = min(1.0, rows / max(counts.agg(F.sum("n")).first()[0] or 0, 1))
        sample = folded.where(F.pmod(F.shiftright("pick", 8), F.lit(1 << 20)) < round(part * (1 << 20)))
        labelled = stored(lexical(sample), "urls")
        self.shares = {by: stored(blocked_share(counts, by, f"f_{by}"), by) for by in ("suffix", "extension")}
        labels = sorted(r.label for r in labelled.select("label").distinct().collect())
        self.only, self.model = ("block" if labels == [1.0] else "allow") if len(labels) < 2 else None, None
        self.assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        if not self.only:
            for by in ("suffix", "extension"):
                labelled = labelled.join(blocked_share(counts, by, f"f_{by}", list(range(FOLDS))), [by, "fold"], "left")
            trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1)
            self.model = trees.fit(self.assemble.transform(labelled.fillna(0.5, ["f_suffix", "f_extension"])))

    def judge(self, urls: DataFrame) -> DataFrame:
        """Add ``by_trees``, the verdict, to ``urls`` (url, host, path)."""
        if self.only:
            return urls.withColumn("by_trees", F.lit(self.only))
        rows = lexical(urls)
        for by, shares in self.shares.items():
            rows = rows.join(shares, by, "left")
        out = self.model.transform(self.assemble.transform(rows.fillna(0.5, ["f_suffix", "f_extension"])))
        return out.withColumn("by_trees", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and the rule's ``verdict``."""
    new = {"host": host(F.col("url")), "path": path(F.col("url"))}
    urls = pages.withColumns({k: F.coalesce(v, F.lit("")) for k, v in new.items()})
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    return urls.withColumns({"rule": rule, "verdict": verdict})


def labelled_by(urls: DataFrame, key: str) -> DataFrame:
    """The URLs that rules decide, with ``label`` and ``pick``, a hash of ``key`` (where there is one) and URL."""
    pick = F.xxhash64(*(c for c in (key, "url") if c in urls.columns)).alias("pick")
    return urls.where(F.col("verdict").isNotNull()).select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"), pick)


def held_out(pages: DataFrame, rules: list[tuple[str, str]], rows: int = TRAIN_ROWS, key: str = "page_id") -> DataFrame:
    """``(label, by_trees)`` of the labelled URLs of one fold, judged by trees and shares that the other folds made."""
    labelled = labelled_by(ruled(pages.select("url", *(c for c in (key,) if c in pages.columns)), rules), key)
    apart = F.pmod("pick", F.lit(FOLDS)) == 0
    return Method(labelled.where(~apart), rows).judge(labelled.where(apart)).select("label", "by_trees")


def judge(pages: DataFrame, rules: list[tuple[str, str]], rows: int = TRAIN_ROWS, key: str = "page_id") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``by_method`` to every row of ``pages``.

    Where a rule fits, the longest decides.  The URLs that rules decide are the labelled ones: about
    ``rows`` of them, chosen by a hash of ``key`` (where there is one) and URL, train gradient-boosted trees on ``FEATURES``, which
    decide the rest (see ``Method``).  If the labelled ones are of one verdict only, the rest get it; if there are none,
    ``allow``.  A null URL and one without ``://`` have empty host and path and are judged like the others.
    Repeated rows stay; columns named like the new ones are replaced, all others pass; an empty table gives an empty one.
    """
    aside = {c: f"__{c}" for c in pages.columns if c in SCRATCH}
    urls = ruled(pages.withColumnsRenamed(aside), rules)
    out = Method(labelled_by(urls, key), rows).judge(urls)
    out = out.withColumns({"by_method": F.col("verdict").isNull(), "verdict": F.coalesce("verdict", "by_trees")})
    new = ["host", "path", "rule", "verdict", "by_method"]
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in pages.columns if c not in new), *new)
