"""Repeated runs of lines by a suffix array over line identifiers; later copies go, the first one stays.

A document is the sequence of its lines. Suffixes that open with a repeated line are bucketed by it, and prefix doubling
refines the buckets: a bucket of length L is ordered and split by the ranks of the suffixes L lines on, until every
suffix is alone or all that share a bucket have ended. A rank is the bucket's first place in the suffix array, so ranks
of one length are final for suffixes that are alone already. The ranks a suffix had are kept (``path``): two suffixes
share 2^k lines where their paths agree at k, which gives the longest common prefix of neighbours in the array by
descending powers of two.

Intervals of the array whose common prefixes are ``min_lines`` long or longer are repeated runs: their suffixes but the
first in the order of documents open later copies, and the union of what these cover is every later copy of every
maximal repeated run. With ``min_words`` intervals of fewer lines count as well if these hold so many words, such as a
long line between other neighbours or a repeated document of one line.

Scale: lines travel as two 64-bit hashes with their place, never as text, and only those of repeated lines travel twice.
A round reads the suffixes that still share a bucket; there are as many rounds as the longest repeated run has binary
digits. Buckets are counted before they are shuffled and written before they are joined, so that adaptive execution can
split a frequent line; numbering within a large bucket is cut into pieces. What a round has read is released.

Defined results: documents are ordered by id (NULL first), then by a hash of id and text; rows that agree in id and
text are one document, and share its outcome; NULL text is one empty line; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..scratch import materialize, materialize_at, release, scratch_path
from .words import let, spare, words

MIN_LINES = 2
MIN_WORDS = 50
# Rows of one bucket that one task numbers; larger buckets are cut.
BUCKET_ROWS = 5_000
# Words that one pattern looks for; its matcher needs stack for each.
MOST_MATCHED = 500

# monotonically_increasing_id: the partition's number above the row's place in it.
PLACE_BITS = 33

ENDED, ALONE = -1, -2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, at, a, b): every line's two hashes."""
    hashed = F.transform(lines_of(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    each = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("doc"), F.posexplode(hashed).alias("at", "line"))
    return each.select("row", "doc", "at", "line.a", "line.b")


def _holds_words(line: Column, n: int) -> Column:
    """Whether a line has ``n`` words or more: of lines that are long enough, by one pass that ends with the ``n``-th word."""
    if n < 1 or n > MOST_MATCHED:
        return F.size(words(line)) >= n
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return (F.octet_length(line) >= 2 * n - 1) & line.rlike(rf"^{gap}*+(?:{word}++{gap}++){{{n - 1}}}{word}")


def _counted_lines(docs: DataFrame, key: str, text: str, min_lines: int, min_words: int | None) -> DataFrame:
    """:func:`_lines` with ``n_lines`` of the document and ``heads``: the words of the first 1, 2, .. ``min_lines`` - 1 lines
    from here (with 2 lines, ``min_words`` for a line that holds as many, and 0 for others).
    """

    def counts(lines: Column) -> Column:
        if min_lines == 2:
            return F.transform(lines, lambda x: F.when(_holds_words(x, min_words), F.lit(min_words)).otherwise(0))
        return F.transform(lines, lambda x: F.size(words(x)))

    def heads(found: Column, i: Column) -> Column:
        total = lambda n: F.aggregate(F.slice(found, i + 1, F.lit(n)), F.lit(0), lambda s, x: s + x)
        return F.array(F.get(found, i), *[total(n) for n in range(2, min_lines)])

    def hashed(lines: Column, head: Callable[[Column], Column]) -> Column:
        return F.transform(
            lines, lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), head(i).alias("heads"))
        )

    def of(lines: Column) -> Column:
        if min_words is None or min_lines == 1:
            return hashed(lines, lambda i: F.array().cast("array<int>"))
        return let(counts(lines), lambda found: hashed(lines, lambda i: heads(found, i)))

    whole = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("doc"), let(lines_of(F.col(text)), of).alias("lines"))
    each = whole.select("row", "doc", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line"))
    return each.select("row", "doc", "at", "n_lines", "line.a", "line.b", "line.heads")


def _written(df: DataFrame, label: str, paths: list[str]) -> DataFrame:
    paths.append(scratch_path(df.sparkSession, label))
    return materialize_at(df, paths[-1])


def _release(df: DataFrame, paths: list[str]) -> None:
    for path in paths:
        release(df.sparkSession, path)
    paths.clear()


def _opening(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """Suffixes that open with a repeated line, with the first place of its bucket as their path.

    ``counted`` are the same lines with their columns more, so that words are counted in one of the two passes only.
    """
    place, paths = F.struct("doc", "row", "at"), []
    ends = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = _written(ends.where("first < last").select("a", "b", "n", F.lit(0).alias("all")), "lines", paths)
    upto = running_total(repeated, ["all"], ["a", "b"], F.col("n"), "upto", 0)  # one bucket of all: always in pieces
    starts = _written(upto.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (F.col("upto") - F.col("n")).alias("start")), "starts", paths)
    met = counted.join(starts, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    found = materialize(met.select("row", "doc", "at", "n_lines", "heads", F.array("start").alias("path")).distinct(), "suffixes")
    _release(lines, paths)
    return found


def _doubled(active: DataFrame, known: DataFrame, step: int) -> DataFrame:
    """``active`` with their rank among runs of twice ``step`` lines added to the path, and whether that is the last one."""
    paths: list[str] = []
    rank = F.element_at("path", -1)
    ahead = known.where(F.col("at") >= step).select(
        F.col("row").alias("_row"), (F.col("at") - step).alias("_at"), rank.alias("_rank")
    )
    following = F.when(F.col("at") + step >= F.col("n_lines"), F.lit(ENDED)).otherwise(F.coalesce("_rank", F.lit(ALONE)))
    met = active.join(ahead, (F.col("row") == F.col("_row")) & (F.col("at") == F.col("_at")), "left").select(
        *active.columns, rank.alias("rank"), following.cast("bigint").alias("next")
    )
    alone = F.col("next") == ALONE  # a line found nowhere else: a bucket of its own
    own_row, own_at = F.when(alone, F.col("row")).otherwise(0), F.when(alone, F.col("at")).otherwise(ALONE)
    met = _written(met.withColumn("own_row", own_row).withColumn("own_at", own_at), "doubling", paths)
    bucket = ["rank", "next", "own_row", "own_at"]
    sizes = met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(sizes, ["rank"], bucket[1:], F.col("n"), "upto", BUCKET_ROWS)
    starts = upto.select(
        *[F.col(c).alias(f"_{c}") for c in bucket], (F.col("rank") + F.col("upto") - F.col("n")).alias("start"), "n"
    )
    starts = _written(starts, "starts", paths)
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in bucket])
    last = (F.col("n") == 1) | (F.col("next") == ENDED)
    rest = [c for c in active.columns if c != "path"]
    longer = met.join(starts, same).select(*rest, F.concat("path", F.array("start")).alias("path"), last.alias("last"))
    out = materialize(longer, "suffixes")
    _release(active, paths)
    return out


def suffix_array(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """The suffixes that open with a repeated line, with their ``path`` and place ``i`` in the array."""
    active = _opening(_lines(docs, key, text), _counted_lines(docs, key, text, min_lines, min_words))
    columns, finished, step = active.columns, [], 1
    while not active.isEmpty():
        known = reduce(DataFrame.unionAll, [*finished, active])
        longer = _doubled(active, known, step)
        finished.append(longer.where("last").select(*columns))
        active = longer.where("NOT last").select(*columns)
        step *= 2
    whole = reduce(DataFrame.unionAll, finished) if finished else active
    order = [F.element_at("path", -1), F.col("row"), F.col("at")]
    return _numbered(whole.repartitionByRange(*order).sortWithinPartitions(*order))


def _numbered(ordered: DataFrame) -> DataFrame:
    """``ordered`` written with its rows' places ``i``: what stands in earlier partitions, one sum each, and in its own."""
    placed = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()), "array")
    part = F.shiftright("_place", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return met.withColumn("i", F.col("_offset") + place).drop("_place", "_part", "_p", "_offset")


def with_common_prefixes(array: DataFrame) -> DataFrame:
    """``array`` with ``lcp``, the lines shared with the suffix before, and ``longest``, those shared with any other."""
    paths: list[str] = []
    before = array.select((F.col("i") + 1).alias("_i"), F.col("row").alias("p_row"), F.col("at").alias("p_at"), F.col("path").alias("p_path"))

    def agreeing(x: str, y: str) -> Column:
        both = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.coalesce(F.size(F.filter(both, lambda same: same)), F.lit(0))

    def lines_more(agree: Column, x: str, y: str, rest: Column) -> Column:
        power = F.call_function("shiftleft", F.lit(1), F.greatest(agree - 1, F.lit(0)))
        return F.when(F.col(x) == F.col(y), rest).when(agree > 0, power).otherwise(0)

    met = array.join(before, F.col("i") == F.col("_i")).where(F.get("path", F.lit(0)) == F.get("p_path", F.lit(0)))
    agree = agreeing("path", "p_path")
    more = lines_more(agree, "path", "p_path", F.col("n_lines") - F.col("at"))
    is_open = (agree > 1) & (F.col("path") != F.col("p_path"))
    pairs = met.select("i", "row", "at", "n_lines", "p_row", "p_at", more.alias("lcp"), is_open.alias("open"))
    pairs = _written(pairs, "pairs", paths)
    closed = [pairs.where("NOT open").select("i", "lcp")]
    pairs = pairs.where("open")
    while not pairs.isEmpty():
        here = array.select(F.col("row").alias("_r"), F.col("at").alias("_a"), F.col("path").alias("_path"))
        there = array.select(F.col("row").alias("_q"), F.col("at").alias("_b"), F.col("path").alias("_p_path"))
        met = pairs.join(here, (F.col("row") == F.col("_r")) & (F.col("at") + F.col("lcp") == F.col("_a")), "left")
        met = met.join(there, (F.col("p_row") == F.col("_q")) & (F.col("p_at") + F.col("lcp") == F.col("_b")), "left")
        agree = agreeing("_path", "_p_path")
        more = lines_more(agree, "_path", "_p_path", F.col("n_lines") - F.col("at") - F.col("lcp"))
        is_open = (agree > 1) & (F.col("_path") != F.col("_p_path"))
        met = met.select("i", "row", "at", "n_lines", "p_row", "p_at", (F.col("lcp") + more).alias("lcp"), is_open.alias("open"))
        met = _written(met, "pairs", paths)
        closed.append(met.where("NOT open").select("i", "lcp"))
        pairs = met.where("open")
    lcps = reduce(DataFrame.unionAll, closed)
    met = array.drop("n_lines").join(lcps.withColumnRenamed("i", "_i"), F.col("i") == F.col("_i"), "left").drop("_i")
    after = lcps.select((F.col("i") - 1).alias("_i"), F.col("lcp").alias("_after"))
    met = met.join(after, F.col("i") == F.col("_i"), "left")
    lcp = F.coalesce("lcp", F.lit(0))
    out = materialize(
        met.select(
            "row", "doc", "at", "heads", "i", F.get("path", F.lit(0)).alias("bucket"), lcp.alias("lcp"),
            F.greatest(lcp, F.coalesce("_after", F.lit(0))).alias("longest"),
        ),
        "array",
    )
    _release(array, paths)
    return out


def later_copies(array: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(row, at, length): where a run that counts starts that stands earlier too, from the array with its common prefixes."""
    place, found = F.struct("doc", "row", "at"), None
    for length in range(min_lines if min_words is None else 1, min_lines + 1):
        if length == 1:
            cut = array.withColumn("interval", F.lit(0).cast("bigint"))
        else:
            opens = (F.col("lcp") < length).cast("bigint")
            cut = running_total(array.where(F.col("longest") >= length), ["bucket"], ["i"], opens, "interval", BUCKET_ROWS)
        if length < min_lines:
            cut = cut.where(F.get("heads", F.lit(length - 1)) >= min_words)
        ends = cut.groupBy("bucket", "interval").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final")
        ends = ends.select(F.col("bucket").alias("_bucket"), F.col("interval").alias("_interval"), "first")
        ends = materialize(ends, "intervals")
        met = cut.join(ends, (F.col("bucket") == F.col("_bucket")) & (F.col("interval") == F.col("_interval")))
        later = met.where(place > F.col("first")).select("row", "at", F.lit(length).alias("length"))
        found = later if found is None else found.unionAll(later)
    return found


def remove(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_removed``, ``n_runs`` (maximal runs of removed lines) and ``longest_run``
    (lines of the longest run that starts in the document and stands elsewhere too, be it earlier or later).

    Repeated runs count from ``min_lines`` lines on, and from ``min_words`` words on if that is given.
    """
    n_kept, n_lines, n_removed, n_runs, n_longest, lines, gone, c_row, c_at, c_longest = spare(
        docs, "kept_text", "n_lines", "n_removed", "n_runs", "longest_run", "_lines", "_gone", "_row", "_covered", "_longest"
    )
    array = with_common_prefixes(suffix_array(docs, key, text, min_lines, min_words))
    found = later_copies(array, min_lines, min_words).select("row", F.struct("at", "length").alias("run"), F.lit(0).alias("longest"))
    every = array.groupBy("row").agg(F.max("longest").alias("longest"))
    found = found.unionAll(every.select("row", F.lit(None).cast("struct<at:int,length:int>").alias("run"), "longest"))
    runs = F.transform(F.collect_list("run"), lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))
    cover = F.array_distinct(F.flatten(runs))
    covered = found.groupBy(F.col("row").alias(c_row)).agg(cover.alias(c_at), F.max("longest").alias(c_longest))
    none = F.array().cast("array<int>")
    met = docs.join(materialize(covered, "covered"), F.xxhash64(key, text) == F.col(c_row), "left").select(
        *docs.columns, lines_of(F.col(text)).alias(lines), F.coalesce(F.col(c_at), none).alias(gone), c_longest
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.size(gone) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    )
    return met.select(
        *docs.columns,
        kept.alias(n_kept),
        F.size(lines).cast("bigint").alias(n_lines),
        F.size(gone).cast("bigint").alias(n_removed),
        F.size(F.array_except(F.col(gone), F.transform(F.col(gone), lambda i: i + 1))).cast("bigint").alias(n_runs),
        F.coalesce(F.col(c_longest), F.lit(0)).cast("bigint").alias(n_longest),
    )
