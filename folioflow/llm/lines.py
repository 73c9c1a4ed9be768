"""Near-duplicate lines by a segment-partition edit join; DataFrame functions only.

A line takes part as it stands, without white space at its ends; blank lines never do.  Lines that are
equal are one node.  Two lines of at least `least_chars` characters are linked if at most `edits` (2)
edits turn one into the other: the shorter one is cut into `edits` + 1 segments of almost equal length,
of which one must occur unchanged in the longer one, close to its own place.  An index holds the
segments of every line by (length, segment number, text); every line probes it for each length from its
own down to `edits` less, only at the starts that the difference of lengths leaves possible.  A line's name
in the index holds how often some common letters occur in it, modulo 8; where these counts differ by more
than `edits` edits can make, lines do not meet, however many share a segment.  Pairs that meet are verified with a banded bit-parallel edit distance: a word of 2 * edits + 1 bits moves down the
diagonal, one addition and a few bit operations for each character.

Of each class (component of links) the first line by (id, line number) stays, the others go.  A caller may
keep documents whole that would lose more than `most_removed` of their characters; the query and the
pipeline remove every repeated line (`EVERY_LINE`), so of a group of copies the first alone keeps its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise
from .common import release_finished
from .components import components

EDITS = 2
LEAST_CHARS = 24
MOST_REMOVED, EVERY_LINE = 0.5, 1.0
COUNTED = "entaoirsdlucmhpg"
BITS = 3 * len(COUNTED)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shift(x: Column, by: int) -> Column:
    return F.shiftleft(x, by) if by >= 0 else F.shiftright(x, -by)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most `edits`, else some larger number.

    Bit `x` of a word stands for row j - edits + x of column j.  `up` and `down` hold where the distance
    grows or falls from the row above.  Beyond the band distances are taken as growing, which is never
    less than the truth and touches no path inside it.
    """
    width, full = 2 * edits + 1, F.lit((1 << 2 * edits + 1) - 1).cast("long")
    one, top = F.lit(1).cast("long"), F.lit(1 << 2 * edits).cast("long")
    start = F.struct(F.lit(((1 << edits) - 1) << (edits + 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(0).alias("cost"), F.lit(0).alias("j"))

    def run(rows: Column) -> Column:
        """The accumulator is copied at every step, so the characters of `a` stay outside it."""

        def step(acc: Column, c: Column) -> Column:
            equal = sum((F.when(F.get(rows, acc["j"] - edits + x) == c, F.lit(1 << x)).otherwise(F.lit(0)) for x in range(width)), F.lit(0)).cast("long")

            def moved(v: Column) -> Column:
                up, down, eq = v["up"], v["down"], v["eq"]
                zero = ((eq.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(full)
                return let(F.struct(zero.alias("zero"), up.alias("up"), down.alias("down")), grown)

            def grown(v: Column) -> Column:
                right = v["down"].bitwiseOR(F.bitwise_not(v["zero"].bitwiseOR(v["up"]))).bitwiseAND(full)
                return let(F.struct(_shift(right, 1).bitwiseOR(one).bitwiseAND(full).alias("right"), _shift(v["zero"].bitwiseAND(v["up"]), 1).alias("left"), v["zero"].alias("zero")), stepped)

            def stepped(v: Column) -> Column:
                return F.struct(
                    v["left"].bitwiseOR(F.bitwise_not(v["zero"].bitwiseOR(v["right"]))).bitwiseAND(full).alias("up"),
                    v["zero"].bitwiseAND(v["right"]).alias("down"),
                    (acc["cost"] + 1 - _shift(v["zero"], -edits).bitwiseAND(one).cast("int")).alias("cost"), (acc["j"] + 1).alias("j"))

            return let(F.struct(_shift(acc["up"], -1).bitwiseOR(top).alias("up"), _shift(acc["down"], -1).alias("down"), equal.alias("eq")), moved)

        def last(acc: Column) -> Column:
            """From the diagonal cell of the last column to the row of the last character."""
            more = F.size(rows) - acc["j"]
            cost = acc["cost"]
            for x in range(width):
                grows = (_shift(acc["up"], -x).bitwiseAND(one) - _shift(acc["down"], -x).bitwiseAND(one)).cast("int")
                if x > edits:
                    cost = cost + F.when(more >= x - edits, grows).otherwise(0)
                else:
                    cost = cost - F.when(more < x - edits, grows).otherwise(0)
            return cost

        return F.aggregate(characters(b), start, step, last)

    far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(far, F.lit(edits + 1)).otherwise(let(characters(a), run))


def characters(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def shared_start(a: Column, b: Column, most: int = 1 << 13) -> Column:
    """Length of the common beginning of two strings: whole steps of twice `most` as long as they are
    equal, then halving steps."""
    def longer(size: int) -> Callable[[Column], Column]:
        return lambda n: n + F.when((F.char_length(a) >= n + size) & (F.substring(a, n + 1, F.lit(size)) == F.substring(b, n + 1, F.lit(size))), size).otherwise(0)

    step = 2 * most
    whole = F.floor(F.char_length(a) / step).cast("int")  # most lines have no such step
    # a step that differs ends the run: later ones would have to start where it began
    at = F.when(whole == 0, F.lit(0)).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), F.lit(0),
        lambda n, i: n + F.when((n == i * step) & (F.substring(a, n + 1, F.lit(step)) == F.substring(b, n + 1, F.lit(step))), step).otherwise(0)))
    while most:
        at = let(at, longer(most))
        most //= 2
    return at


def parts_near(a: Column, b: Column, first: Column, last: Column, edits: int, parts: int) -> Column:
    """How many of `parts` parts of a[first..last] (from 1) stand in b within `edits` of their place."""
    n = last - first + 1

    def near(i: int) -> Column:
        low, high = first + F.floor(n * i / parts).cast("int"), first + F.floor(n * (i + 1) / parts).cast("int")
        start = F.greatest(low - edits, F.lit(1))
        return F.when(F.contains(F.substring(b, start, high + edits - start), F.substring(a, low, high - low)), 1).otherwise(0)

    return sum((near(i) for i in range(1, parts)), near(0))


def verified(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most `edits` edits apart.

    An edit spoils at most one part of a string, so all parts but `edits` stand near their place in the
    other.  The common beginning and end are left out.  What then remains differs at both ends, which
    takes two edits if it is longer than one character; its inside has two less to spoil.  Only strings
    that pass both are compared bit by bit.
    """
    parts = 4 * edits
    n = F.char_length(a)

    def rest(s: Column) -> Column:
        return let(shared_start(s["x"], s["y"]), lambda n: F.struct(F.substring(s["x"], n + 1, F.char_length(s["x"]) - n).alias("x"), F.substring(s["y"], n + 1, F.char_length(s["y"]) - n).alias("y")))

    def turned(s: Column) -> Column:
        return F.struct(F.reverse(s["x"]).alias("x"), F.reverse(s["y"]).alias("y"))

    def compare(s: Column) -> Column:
        size = F.char_length(s["x"])
        inside = parts_near(s["x"], s["y"], F.lit(2), size - 1, edits, parts) >= parts - max(edits - 2, 0)
        return F.when((size < 2 * parts) | inside, banded_distance(s["x"], s["y"], edits)).otherwise(edits + 1)

    both = let(let(F.struct(a.alias("x"), b.alias("y")), rest), lambda s: let(turned(s), rest))
    enough = parts_near(a, b, F.lit(1), n, edits, parts) >= parts - edits
    return F.when((F.abs(n - F.char_length(b)) <= edits) & enough, let(both, compare) <= edits).otherwise(False)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, key) of every line that is not blank; key is two 64-bit hashes."""
    # a null text has one row without a line, which ends at the filter
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.split(text_col, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\f"))).where("line <> ''")
    return rows.withColumn("key", F.struct(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")))


def name_of(line: Column, hashed: Column) -> Column:
    """The upper bits of a hash before 3 bits for each counted letter."""
    out = F.shiftleft(hashed, BITS)
    for i, letter in enumerate(COUNTED):
        times = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((times % 8).cast("long"), 3 * i))
    return F.coalesce(out, F.lit(0).cast("long"))  # never null: no plan adds a filter for it, so all share one exchange


def counts_apart(a: Column, b: Column) -> Column:
    """By how much the letter counts in two names differ at least; an edit makes 2 at most."""
    out = F.lit(0).cast("long")
    for i in range(len(COUNTED)):
        x, y = (F.shiftright(v, 3 * i).bitwiseAND(F.lit(7).cast("long")) for v in (a, b))
        d = (x - y).bitwiseAND(F.lit(7).cast("long"))
        out = out + F.least(d, 8 - d)
    return out


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(first position, length) of each segment of a line; the last ones take the remainder."""
    base, extra = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    out, parts = [], edits + 1
    for i in range(parts):
        longer = F.greatest(F.lit(0), extra - (parts - 1 - i))  # 1 from segment parts - extra on
        before = F.greatest(F.lit(0), extra - (parts - i))
        out.append((base * i + before + 1, base + (longer - before)))
    return out


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): names `k` of pairs of distinct lines (`k`, `line`) that share a segment, each pair once.

    Lengths are columns of their own, and entries are listed by an outer explode, as they are never none:
    for the inner one Spark would compute them a second time, to filter rows without any.
    """
    sizes = [f"_n{shorter}" for shorter in range(edits + 1)]
    lines = (lines.select("k", "line", F.char_length("line").alias("_n"))
             .select("k", "line", *(F.col("_n") - shorter for shorter in range(edits + 1))).toDF("k", "line", *sizes))

    def entry(length: Column, i: int, text: Column) -> Column:
        return F.xxhash64(length, F.lit(i), text)

    def listed(entries: list[Column], name: str) -> DataFrame:
        return (lines.select(F.col("k").alias(name), F.array_distinct(F.array(*entries)).alias("entries"))
                .select(name, F.explode_outer("entries").alias("entry")))

    n = F.col(sizes[0])
    index = listed([entry(n, i, F.substring(F.col("line"), at, size)) for i, (at, size) in enumerate(_segments(n, edits))], "k")
    probes = []
    for shorter, length in enumerate(map(F.col, sizes)):
        for i, (at, size) in enumerate(_segments(length, edits)):
            low = max(-i, shorter - (edits - i))
            high = min(i, shorter + (edits - i))
            probes += [entry(length, i, F.substring(F.col("line"), at + by, size)) for by in range(low, high + 1)]
    probe = listed(probes, "b")
    return (index.join(probe, "entry").where((F.col("k") != F.col("b")) & (counts_apart(F.col("k"), F.col("b")) <= 2 * edits))
            .select(F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b")).distinct())


def line_links(lines: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b): keys of lines (`key`, `line`) at most `edits` edits apart.

    The texts are shuffled once, by the name of a line in index and probes; a line that occurs very often
    is combined before.  Lines with one name are kept apart by their texts, and compared with each other.
    """
    once = (lines.where(F.char_length("line") >= max(least_chars, 2 * edits + 2))
            .groupBy(name_of(F.col("line"), F.col("key.k1")).alias("k")).agg(F.collect_set(F.struct("key", "line")).alias("all")))
    distinct = once.select("k", F.explode("all").alias("one")).select("k", "one.key", "one.line")
    pairs = candidates(distinct.select("k", "line"), edits)
    a, b = (distinct.select(F.col("k").alias(x), F.col("key").alias(f"key_{x}"), F.col("line").alias(f"line_{x}")) for x in "ab")
    # candidates are pairs of names, so the lines of one name meet here; few names have more than one
    inside = (once.where(F.size("all") > 1).select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.key < y.key")
              .select(F.col("x.key").alias("key_a"), F.col("x.line").alias("line_a"), F.col("y.key").alias("key_b"), F.col("y.line").alias("line_b")))
    met = pairs.join(a, "a").join(b, "b").select("key_a", "line_a", "key_b", "line_b").unionByName(inside)
    return met.where(verified(F.col("line_a"), F.col("line_b"), edits)).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, line_no) of each line that is not the first of its class."""
    lines = lines_of(docs, id_col, text_col)
    found = components(line_links(lines, edits, least_chars), "a", "b")
    counts = lines.select("key").groupBy("key").agg(F.count("*").alias("n"))
    repeated = materialise(counts.join(found, F.col("key") == F.col("node"), "left")
                           .where("n > 1 OR root IS NOT NULL").select("key", F.coalesce("root", "key").alias("class")))
    members = materialise(lines.select("id", "line_no", "key").join(repeated, "key").select("id", "line_no", "class"))
    first = members.groupBy("class").agg(F.min(F.struct("id", "line_no")).alias("first"))
    # a class may hold a third of all lines: its first line is one row beside them, their side is split
    return members.join(first, "class").where(~F.struct("id", "line_no").eqNullSafe(F.col("first"))).select(F.col("id").alias(id_col), "line_no")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS,
                    most_removed: float = MOST_REMOVED) -> DataFrame:
    """The columns of `docs` with its text without repeated lines, and n_lines, n_repeated, n_removed.

    Null texts stay null, empty and blank ones as they are.  Rows with equal ids count as one document:
    a line of theirs stays or goes in all of them.  Rows with a null id keep every line.  An empty table
    gives none.  Columns of `docs` named like the three counts are replaced.
    """
    gone = materialise(removed_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col, edits, least_chars)
                       .groupBy(id_col).agg(F.collect_set("line_no").alias("__gone")))
    release_finished(docs.sparkSession)  # the texts by line, before they are shuffled by document
    names = [c for c in docs.columns if c not in ("n_lines", "n_repeated", "n_removed", "__gone")]
    lines = F.split(text_col, "\n")
    joined = docs.select(*(F.col(f"`{c}`") for c in names)).join(gone, id_col, "left")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    chars = F.aggregate(F.col("__gone"), F.lit(0).cast("long"), lambda acc, i: acc + F.coalesce(F.char_length(F.get(F.col("__lines"), i)), F.lit(0)))
    return (joined.withColumn("__lines", lines)
            .withColumn("__drop", F.coalesce(chars <= most_removed * F.char_length(text_col), F.lit(False)))
            .select(*(F.when(F.col("__drop"), F.array_join(F.transform(kept_at, lambda i: F.get(F.col("__lines"), i)), "\n")).otherwise(F.col(text_col)).alias(text_col)
                      if c == text_col else F.col(f"`{c}`") for c in names),
                    F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_repeated"),
                    F.when(F.col("__drop"), F.size("__gone")).otherwise(0).cast("long").alias("n_removed")))
