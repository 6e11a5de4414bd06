"""Operator 6: near-duplicate lines by a segment-partition edit join.

Lines of equal text form a class. Two classes are linked if their texts are within ``max_edits`` edits and the shorter one
has at least ``min_chars`` characters; shorter lines only match exactly.

1. Every line of length l is cut into ``max_edits + 1`` even segments. Each is an index entry under (l, segment, text). Two
   lines within ``max_edits`` edits share a segment at a nearby place.
2. Every line probes, for each length from its own down to ``max_edits`` less, only the substrings that can match a
   segment without a closer match on either side of it (length-aware, multi-match-aware places).
3. A first join only asks which probes meet an entry of another class; an entry brings its smallest and largest class, so
   equal lines and common segments cost one row per probe. Few lines are left, and only their texts are gathered.
4. The left lines meet per entry. A pair must also agree in its letter counts: an edit changes at most two of them by
   one, so a distance over ``2 * max_edits`` rules the pair out before a row is made.
5. Pairs are verified bit-parallel in a band (``within_edits``): bit ``d`` of the vector for ``e`` edits says that, at a place of
   one line, the other is at the place ``d - max_edits`` further and ``e`` edits explain what lies before. A step shifts and joins
   ``max_edits + 1`` vectors of ``2 * max_edits + 1`` bits, however long the lines are.

Lines that occur more than ``HOT_ROWS`` times are few; what is known of them is broadcast to their rows after a count, so no task
gets all rows of a line. Only DataFrame functions run. A line is known by a 64-bit hash of its text.

Defined cases: null texts have no line, empty texts one empty line; ids may be null or repeated, rows with equal id and
text are one document here; extra columns are ignored. Empty lines are a class like any other but ``dedup_lines`` never
removes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, free_names, small_side, text_key
from .components import components

MAX_EDITS = 2
MIN_CHARS = 20
SIGNATURE = "abcdefghijklmnopqrstuvwxyz ,.-éü"
HOT_ROWS = 1000  # a line with more rows than this is not shuffled by its key
KEY = ["doc_id", "text_key"]


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no, line, line_key, chars``."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("*", F.length("line").alias("chars"), F.xxhash64("line").alias("line_key"))


def _letter_counts(line: Column) -> Column:
    """How often each signature character occurs."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in SIGNATURE])


def _near(max_edits: int) -> Column:
    """An edit changes at most two letter counts by one each; parities are compared first, as one number."""
    parities = F.bit_count(F.col("r_odd").bitwiseXOR(F.col("s_odd"))) <= 2 * max_edits
    apart = F.aggregate(F.zip_with("r_counts", "s_counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
    return parities & (apart <= 2 * max_edits)


def within_edits(x: Column, y: Column, max_edits: int = MAX_EDITS) -> Column:
    """Whether two texts are within ``max_edits`` edits, by bit vectors over the band of diagonals. Null if one is null.

    The texts are split once: a one-element array binds their characters to a lambda's variable, where an expression
    would be evaluated again for every character.
    """
    width, middle = 2 * max_edits + 1, max_edits
    ones = F.lit((1 << width) - 1).cast("bigint")
    bit = lambda d: F.lit(1 << d).cast("bigint")
    none = F.lit(0).cast("bigint")

    def match(xs: Column, c: Column, j: Column) -> Column:
        """Bit ``d``: the character of ``x`` on diagonal ``d`` is the ``j``-th of ``y``."""
        same = [F.when(F.get(xs, j + F.lit(d - middle)) == c, bit(d)).otherwise(none) for d in range(width)]
        return reduce(Column.bitwiseOR, same)

    def step(acc: Column, m: Column) -> Column:
        found = [acc["e0"].bitwiseAND(m)]
        for e in range(1, max_edits + 1):
            old, fewer = acc[f"e{e}"], acc[f"e{e - 1}"]
            put_in, left_out = F.shiftright(fewer, 1), F.shiftleft(found[-1], 1)
            found.append(old.bitwiseAND(m).bitwiseOR(fewer).bitwiseOR(put_in).bitwiseOR(left_out).bitwiseAND(ones))
        return F.struct(*[v.alias(f"e{e}") for e, v in enumerate(found)])

    start = F.struct(*[F.lit(((1 << e + 1) - 1) << middle).cast("bigint").alias(f"e{e}") for e in range(max_edits + 1)])
    end = F.length(x) - F.length(y) + middle
    split = F.array(F.struct(F.split(x, "").alias("xs"), F.split(y, "").alias("ys")))
    steps = F.get(F.transform(split, lambda s: F.transform(s["ys"], lambda c, j: match(s["xs"], c, j))), F.lit(0))
    # The empty text splits into one empty character, which is no character of a line.
    steps = F.when(F.length(y) > 0, steps).otherwise(F.array().cast("array<bigint>"))
    last = F.aggregate(steps, start, step, lambda acc: acc[f"e{max_edits}"])
    return (F.abs(end - middle) <= max_edits) & F.call_function("shiftright", last, end).bitwiseAND(F.lit(1).cast("bigint")).cast("boolean")


def probe_shifts(max_edits: int, i: int, less: int) -> range:
    """Shifts from a segment's start where a line ``less`` characters longer than the indexed one may hold segment ``i``."""
    right = max_edits - i
    return range(max(-i, less - right), min(i, less + right) + 1)


def entries(found: DataFrame, max_edits: int, probe: bool) -> DataFrame:
    """``line_key, entry``: the index entries of every line, or with ``probe`` the ones that it looks up."""
    n = max_edits + 1
    places = [
        F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
        for less in (range(n) if probe else [0])
        for i in range(n)
        for shift in (probe_shifts(max_edits, i, less) if probe else [0])
    ]
    rows = found.select("line_key", "chars", "line", F.explode(F.array(*places)).alias("p"))
    rows = rows.select("line_key", "chars", "line", "p.i", "p.shift", (F.col("chars") - F.col("p.less")).alias("l"))
    i, l, longer = F.col("i"), F.col("l"), F.col("l") % n
    short = F.floor(l / n).cast("int")
    # Segments are even; the last ``longer`` ones have one character more.
    start = i * short + F.greatest(F.lit(0), i + longer - n) + 1 + F.col("shift")
    size = short + (i >= n - longer).cast("int")
    rows = rows.select("line_key", "chars", "line", "i", "l", start.alias("start"), size.alias("size"))
    rows = rows.filter("start >= 1 AND start + size - 1 <= chars")
    return rows.select("line_key", F.xxhash64("i", "l", F.substring("line", F.col("start"), F.col("size"))).alias("entry"))


def candidates(found: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` (line keys, a < b) that pass every filter, and ``line_key, line`` of the lines in question."""
    long_enough = found.filter(F.col("chars") >= min_chars)
    index = entries(long_enough, max_edits, False)
    probes = entries(found.filter(F.col("chars") >= min_chars), max_edits, True)
    ends = index.groupBy("entry").agg(F.min("line_key").alias("lo"), F.max("line_key").alias("hi"))
    met = probes.join(ends, "entry").filter("lo <> line_key OR hi <> line_key")
    asks = cut_lineage(met.select(F.col("line_key").alias("s"), "entry").distinct())
    asked = cut_lineage(asks.select("entry").distinct())
    owns = cut_lineage(index.join(small_side(asked), "entry", "left_semi").select(F.col("line_key").alias("r"), "entry").distinct())
    wanted = cut_lineage(asks.select(F.col("s").alias("line_key")).union(owns.select("r")).distinct())
    texts = long_enough.select("line_key", "line").join(small_side(wanted), "line_key")
    texts = cut_lineage(texts.groupBy("line_key").agg(F.first("line").alias("line")))
    odd = F.aggregate("counts", F.lit(0).cast("bigint"), lambda bits, n: bits * 2 + n % 2)
    marks = cut_lineage(texts.select("line_key", _letter_counts(F.col("line")).alias("counts")).withColumn("odd", odd))
    left = owns.join(marks.toDF("r", "r_counts", "r_odd"), "r")
    right = asks.join(marks.toDF("s", "s_counts", "s_odd"), "s")
    pairs = left.join(right, (left["entry"] == right["entry"]) & (F.col("r") != F.col("s")) & _near(max_edits))
    return pairs.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct(), texts


def links(found: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``a, b``: keys of different lines within ``max_edits`` edits, each pair once."""
    pairs, texts = candidates(found, max_edits, min_chars)
    left = texts.select(F.col("line_key").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("line_key").alias("b"), F.col("line").alias("y"))
    both = cut_lineage(pairs).join(left, "a").join(right, "b")
    return both.filter(within_edits(F.col("x"), F.col("y"), max_edits)).select("a", "b")


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per line: ``doc_id, text_key, line_no, chars, line_key, copies, links, class_at, group_at, first``.

    ``copies`` counts equal lines and ``links`` the other texts within reach. ``class_at`` is the first equal line and
    ``group_at`` the first line of the connected group, by (id, text hash, line number) with null ids last; ``first``
    marks the lines that are the first of their group.
    """
    found = lines(docs)
    near = cut_lineage(links(found, max_edits, min_chars))
    degree = near.select(F.explode(F.array("a", "b")).alias("line_key")).groupBy("line_key").agg(F.count(F.lit(1)).alias("links"))
    groups = components(near, "a", "b")
    linked = cut_lineage(degree.join(groups, degree["line_key"] == groups["node"]).select("line_key", "links", "component"))
    narrow = cut_lineage(found.select(*KEY, "line_no", "chars", "line_key"))
    at = F.struct(F.col("doc_id").isNull().alias("z"), *KEY, "line_no")
    classes = narrow.groupBy("line_key").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("class_at"))
    members = linked.join(classes, "line_key").groupBy("component").agg(F.min("class_at").alias("group_at"))
    grouped = linked.join(members, "component").select("line_key", "links", "group_at")
    classes = classes.join(grouped, "line_key", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    classes = cut_lineage(classes.withColumn("group_at", F.coalesce("group_at", "class_at")))
    hot = cut_lineage(classes.filter(F.col("copies") > HOT_ROWS))
    hot_key = cut_lineage(hot.select(F.col("line_key").alias("hot_key")))
    often = narrow.join(small_side(hot), "line_key")
    seldom = narrow.join(small_side(hot_key), F.col("line_key") == F.col("hot_key"), "left_anti")
    rows = often.unionByName(seldom.join(classes.filter(F.col("copies") <= HOT_ROWS), "line_key"))
    same = F.col("doc_id").eqNullSafe(F.col("group_at.doc_id"))
    same = same & (F.col("text_key") == F.col("group_at.text_key")) & (F.col("line_no") == F.col("group_at.line_no"))
    return rows.select(*KEY, "line_no", "chars", "line_key", "copies", "links", "class_at", "group_at", same.alias("first"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that repeat an earlier line of the corpus, exactly or within the edits; all columns stay.

    Documents of which no character is left, though they had some, go: all they held is kept elsewhere.
    """
    found = line_classes(docs, max_edits, min_chars)
    gone, own_id, own_text, key, new = free_names(docs, "__gone", "__id", "__text", "__key", "__new")
    drop = found.filter((~F.col("first")) & (F.col("chars") > 0)).groupBy(*KEY).agg(F.collect_set("line_no").alias(gone))
    drop = drop.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text), gone)
    keyed = docs.withColumn(key, text_key(F.col("text")))
    joined = keyed.join(drop, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_text)), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(new, text).filter(F.col(gone).isNull() | (F.length(F.replace(new, F.lit("\n"), F.lit(""))) > 0))
    out = out.select(*[F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
