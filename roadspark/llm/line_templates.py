"""Line dedup by a log-template tree.  Everything here is column expressions, joins and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import stored
from roadspark.llm.components import components

#: A template recurs if this many different texts have it ...
MIN_TEXTS = 5
#: ... and what surrounds it differs: so many kinds, and so many for each text.
MIN_KINDS, KINDS_SHARE = 5, 0.5
#: The same for whole lines of so many tokens, where ``drop_lines`` is asked to count families: (tokens, kinds), longest first.
LONG = ((40, 3), (20, 4))
#: Sketch of a text's family: words of a shingle, hashes of a key, and bits of the places in the ring of hashes where keys start.
SHINGLE, KEY_HASHES, START_BITS = 3, 8, 5
#: Depth of the tree below the token count: leading tokens that lines of a leaf share.
LEADING = 2
#: A template keeps so many of its tokens at least, and such a share of them; the others are variable fields.
LEAST_FIXED, FIXED_SHARE = 3, 0.5
#: A block of a leaf has about so many lines and tokens at most.
BLOCK_LINES, BLOCK_TOKENS = 64, 1 << 16


def masked(text: Column) -> Column:
    """Lower case, with every token that holds a digit as ``<*>``."""
    low = F.lower(text)
    return F.when(low.rlike("[0-9]"), F.regexp_replace(low, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(low)


def whole(line: Column) -> Column:
    """Key of a masked line by itself; null for a blank one."""
    return F.when(line != "", F.xxhash64(line))


def leaf(line: Column) -> Column:
    """Key of a masked line's leaf in the tree: its token count and leading tokens.  Null where no template could have a field."""
    tokens = F.split(line, " ")
    return F.when(F.size(tokens) > LEAST_FIXED, F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEADING)))


def number(kind: Column) -> Column:
    """A text as 60 bits of its hash."""
    return F.conv(F.substring(F.md5(kind), 1, 15), 16, 10).cast("long")


def masked_lines(text: str) -> Column:
    return F.transform(F.split(masked(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda s: F.trim(s))


def once(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is worked out once a row, also where ``fn`` uses it for each element of an array."""
    return F.transform(F.array(value), fn)[0]


def parsed(docs: DataFrame, text: str) -> DataFrame:
    """Of each row: its key (``k_id``, ``k_text``), its masked ``lines``, and the ``kinds`` of the lines.

    The kind of a line is what surrounds it: the two least hashes of the document's other lines.  It is the same in
    copies of a document, whatever few of their lines were edited, and differs where a line stands in documents of its own.
    """
    hashes = F.transform("lines", lambda s: F.when(s != "", F.md5(s)))
    least = F.slice(F.sort_array(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))), 1, 3)
    kinds = once(F.col("least"), lambda top: F.transform("hashes", lambda h: F.array_join(F.slice(F.filter(top, lambda x: x != h), 1, 2), " ")))
    rows = docs.select(*keys(docs, text), masked_lines(text).alias("lines")).withColumn("hashes", hashes).withColumn("least", least)
    return rows.select("k_id", "k_text", "lines", F.transform(kinds, number).alias("kinds"))


def parsed_by_family(docs: DataFrame, text: str) -> DataFrame:
    """Of each row: its key, its masked ``lines``, and as their ``kinds`` the family of its text."""
    rows = docs.select(*keys(docs, text), masked_lines(text).alias("lines")).join(families(docs, text), "k_text", "left")
    return rows.select("k_id", "k_text", "lines", F.transform("lines", lambda s: F.coalesce("family", "k_text")).alias("kinds"))


def families(docs: DataFrame, text: str) -> DataFrame:
    """(``k_text``, ``family``) of the texts that are copies of others but for edits.

    The hashes of a text's shingles form a ring, which is entered at fixed places; each key is the few hashes that
    follow.  Texts that share a key share most of their shingles, nearly always, and are of one family, as are those that a
    chain of such texts joins: a large group of edited copies is one family, however its members were edited.
    """
    words = F.split(F.trim(masked(F.coalesce(F.col(text), F.lit("")))), r"\s+")
    rows = docs.select(keys(docs, text)[1], words.alias("words"))
    runs = F.arrays_zip(*(F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(SHINGLE)))
    whole = F.when(F.size("words") > SHINGLE, F.slice(runs, 1, F.size("words") - SHINGLE + 1)).otherwise(F.slice(runs, 1, 1))
    rows = rows.select("k_text", F.sort_array(F.array_distinct(F.transform(whole, lambda w: F.xxhash64(w)))).alias("ring"))
    again = F.concat("ring", F.slice("ring", 1, KEY_HASHES - 1))
    starts = lambda h, i: (i == 0) | (F.shiftright(F.get("ring", i - 1), 64 - START_BITS) != F.shiftright(h, 64 - START_BITS))
    entered = once(again, lambda ring: F.transform("ring", lambda h, i: F.when(starts(h, i), F.xxhash64(F.slice(ring, i + 1, KEY_HASHES)))))
    shared = stored(rows.select("k_text", F.explode(F.filter(entered, lambda k: k.isNotNull())).alias("key")).distinct(), "families")
    least = shared.groupBy("key").agg(F.min("k_text").alias("least"), F.max("k_text").alias("most")).where("least < most")
    found = components(shared.join(least, "key").select(F.col("k_text").alias("u"), F.col("least").alias("v")))
    return found.distinct().select(F.col("node").alias("k_text"), F.col("component").alias("family"))


def needed(line: Column) -> Column:
    """The kinds that a whole line needs to recur: fewer for long lines, which unrelated texts don't share by chance."""
    n, out = F.size(F.split(line, " ")), F.lit(MIN_KINDS)
    for tokens, kinds in reversed(LONG):
        out = F.when(n >= tokens, kinds).otherwise(out)
    return out


def keys(docs: DataFrame, text: str, id_col: str = "doc_id") -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text")]


def counted(rows: DataFrame, *by: str, need: Column | None = None) -> DataFrame:
    """How many ``texts`` have each key, of how many ``kinds``, and the ``need`` of kinds.

    Each step groups by all that it tells apart, then sums, so that a key in a third of all rows is
    spread over many tasks until only sums are left.
    """
    rows = rows.withColumn("need", F.lit(MIN_KINDS) if need is None else need)
    texts = rows.groupBy(*by, "k_text").agg(F.min("kind").alias("kind"), F.min("need").alias("need"))
    kinds = texts.groupBy(*by, "kind").agg(F.count("*").alias("texts"), F.min("need").alias("need"))
    return kinds.groupBy(*by).agg(F.sum("texts").alias("texts"), F.count("*").alias("kinds"), F.min("need").alias("need"))


def recurring(by_family: bool) -> Column:
    """Whether a key that was ``counted`` recurs across documents which aren't copies of each other."""
    if by_family:
        return F.col("kinds") >= F.col("need")
    return (F.col("texts") >= MIN_TEXTS) & (F.col("kinds") >= MIN_KINDS) & (F.col("kinds") >= KINDS_SHARE * F.col("texts"))


def templates(lines: DataFrame) -> DataFrame:
    """(``whole``, ``template``) of the different masked lines (``whole``, ``leaf``, ``kind``, ``m``) that have enough fixed tokens.

    At the leaf a token is fixed if lines of ``MIN_KINDS`` kinds have it at its place; all others there are variable fields, however
    many stand side by side.  Lines that repeat another of their kind count once.  A leaf's lines are one block or, where it is crowded,
    several; the fixed tokens of a block alone are told from its lines, and blocks of one leaf sum up what each has counted.
    """
    tokens = F.split("m", " ")
    placed = F.transform(F.slice(tokens, LEADING + 1, F.size(tokens)), lambda token, i: F.xxhash64("leaf", i + LEADING, token))
    apart = lines.groupBy("leaf", "whole", "kind").agg(F.any_value("m").alias("m")).select("leaf", "whole", "kind", placed.alias("keys"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_LINES, F.sum(F.size("keys")) / BLOCK_TOKENS)).alias("blocks")
    crowded = apart.groupBy("leaf").agg(blocks).where("blocks > 1")
    dealt = apart.join(crowded, "leaf", "left").select("leaf", F.expr("pmod(whole, blocks)").alias("block"), "whole", "kind", "keys").repartition("leaf", "block")
    told = dealt.withColumnRenamed("leaf", "at").join(recurring_tokens(dealt), [F.col("at") == F.col("leaf"), F.col("block").eqNullSafe(F.col("of_block"))])
    told = told.select("leaf", "whole", F.size("keys").alias("n"), F.array_intersect("keys", "recur").alias("fixed")).distinct()
    n, n_fixed = F.col("n") + LEADING, F.size("fixed") + LEADING
    told = told.where((n_fixed >= LEAST_FIXED) & (n_fixed >= FIXED_SHARE * n))
    return told.select("whole", F.xxhash64("leaf", F.sort_array("fixed")).alias("template"))


def recurring_tokens(dealt: DataFrame) -> DataFrame:
    """(``leaf``, ``of_block``, ``recur``): the keys in each block of ``dealt`` that lines of ``MIN_KINDS`` kinds have, at its leaf.

    A block has its keys in order, each once for each kind, so one that recurs equals the one ``MIN_KINDS`` - 1 places on.  Where a leaf
    has several blocks (``block`` isn't null), each gives its different keys with ``MIN_KINDS`` kinds at most, which are enough to tell.
    """
    pairs = F.transform("keys", lambda k: F.struct(k.alias("key"), "kind"))
    ordered = dealt.groupBy("leaf", "block").agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("r"))
    apart = once(F.col("r"), lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1) != x)))
    again = lambda r: F.filter(r, lambda x, i: F.get(r, i + (MIN_KINDS - 1))["key"] == x["key"])
    first = lambda r: F.filter(r, lambda x, i: (i < MIN_KINDS) | (F.get(r, i - MIN_KINDS)["key"] != x["key"]))
    recur, few = once(apart, lambda r: F.array_distinct(F.transform(again(r), lambda x: x["key"]))), once(apart, first)
    alone = F.col("block").isNull()
    counted = stored(ordered.select("leaf", F.col("block").alias("of_block"), F.when(alone, recur).alias("recur"), F.when(~alone, few).alias("few")), "tokens")
    parts = counted.where("few IS NOT NULL").select("leaf", "of_block", F.inline("few"))
    fixed = parts.select("key", "kind").distinct().groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= MIN_KINDS)
    met = parts.select("leaf", "of_block", "key").distinct().join(fixed, "key", "left_semi")
    met = met.groupBy("leaf", "of_block").agg(F.collect_list("key").alias("recur"))
    return counted.where("recur IS NOT NULL").select("leaf", "of_block", "recur").unionByName(met)


def drop_lines(docs: DataFrame, text: str = "text", by_family: bool = False) -> DataFrame:
    """Drop from each text the lines with a template that recurs; add ``n_lines`` and ``n_dropped``.

    A whole line is a template.  For those that don't recur, the tree has a leaf for each token count and leading tokens.  At
    a leaf, tokens that recur at their place are fixed and the others are fields; a line's template is its leaf with its fixed tokens,
    at least three and half of all.  A template recurs if ``MIN_TEXTS`` different texts have it, of ``MIN_KINDS`` kinds and of one kind for
    every two texts at least.  So lines that recur because whole documents were copied stay for near-dedup,
    which keeps one of each group.  That is the rule of the registered query's SQL.  With ``by_family`` a template
    recurs if ``MIN_KINDS`` families of texts have it (see ``families``), and for whole lines of many tokens fewer (``LONG``);
    copies in any number then neither make a template nor save one.  Blank lines stay.  A null text counts as empty; repeated rows stay and
    lose the same lines; an empty table gives an empty one; columns named like the new ones are replaced.
    """
    trees = stored(parsed_by_family(docs, text) if by_family else parsed(docs, text), "lines")
    zipped = F.arrays_zip("lines", "kinds")
    lines = trees.select("k_id", "k_text", F.posexplode(zipped).alias("line", "x")).select("k_id", "k_text", "line", F.col("x.lines").alias("m"), F.col("x.kinds").alias("kind"))
    lines = lines.withColumns({"whole": whole(F.col("m")), "leaf": leaf(F.col("m"))})
    keyed = lines.select("k_text", "kind", F.when(F.lit(by_family), needed(F.col("m"))).otherwise(MIN_KINDS).alias("line_need"), F.posexplode(F.array("whole", "leaf")).alias("depth", "key"))
    need = F.when(F.col("depth") == 0, F.col("line_need")).otherwise(MIN_KINDS)
    found = stored(counted(keyed.where("key IS NOT NULL"), "depth", "key", need=need).where((F.col("kinds") >= MIN_KINDS) | recurring(by_family)), "recurring")
    again = found.where(F.col("depth") == 0).where(recurring(by_family)).select(F.col("key").alias("whole"))
    shared = found.where(F.col("depth") == 1).where(F.col("kinds") >= MIN_KINDS).select(F.col("key").alias("leaf"))
    rest = lines.join(shared, "leaf", "left_semi").join(again, "whole", "left_anti")
    rest = stored(rest.select("k_id", "k_text", "line", "whole", "leaf", "kind", "m"), "leaves")
    made = stored(rest.drop("m", "leaf").join(templates(rest), "whole"), "templates")
    hit = made.join(counted(made, "template").where(recurring(by_family)), "template", "left_semi").select("k_id", "k_text", "line")
    hit = hit.unionByName(lines.join(again, "whole", "left_semi").select("k_id", "k_text", "line"))
    gone = hit.groupBy("k_id", "k_text").agg(F.collect_set("line").alias("__gone")).withColumnsRenamed({"k_id": "__k_id", "k_text": "__k_text"})
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    named = [c.alias(n) for c, n in zip(keys(docs, text), ("__k_id", "__k_text"), strict=True)]
    rows = docs.select(*kept_columns, *named).join(gone, ["__k_id", "__k_text"], "left")
    rows = rows.withColumn("__split", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    # places left over are found by hash, so a text takes time in proportion to its lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__gone"))
    kept, none = F.transform(stay, lambda i: F.get("__split", i)), F.col("__gone").isNull()
    return rows.select(
        *(F.when(none, F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in kept_columns),
        F.size("__split").cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )
