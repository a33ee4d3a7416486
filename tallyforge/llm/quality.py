"""Quality rules with verdicts on hosts.

Every document is judged by counts of its own text. The failures are summed by host, and each host's failure rate is
shrunk towards all hosts' by a beta prior fitted to them. A host is bad, and takes its documents along, if its rate lies
``ODDS`` times or more above that of all documents in odds, with the posterior's spread allowed for: the shrunk rate
less ``SPREADS`` standard deviations must reach that bound. The bound follows the corpus: where one document in nine
fails it is a rate of a third, where half of them do it is 0.8. A host of a few failed documents is thus no bad host.

Scale: counting is one pass inside the row, without a shuffle; its narrow result is written once. The sums by host
combine before the shuffle, and the verdicts, a row per host, are written before they are joined, so that Spark knows
their size and either broadcasts them or splits a hot host's documents.

Defined results: NULL text is empty text and fails; a NULL host is a host of its own; documents that repeat are
judged each; an empty table gives an empty table; columns of the input stay, added ones take a trailing underscore
if the name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .words import let, spare, windows, words

SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A bad host's odds of failure against those of all documents, and the standard deviations that its rate must clear them by.
ODDS = 4.0
SPREADS = 2.0


def repeated_words(found: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in ``found`` (a let or a column).

    Windows are sorted by hash with their place, so equal ones are neighbours: n log n also for very long texts. The
    sort is skipped where all windows differ.
    """

    def places(ordered: Column) -> Column:
        def place(window: Column, j: Column) -> Column:
            same = (window["h"] == F.get(ordered, j - 1)["h"]) | (window["h"] == F.get(ordered, j + 1)["h"])
            return F.when(same, window["i"])

        return F.sort_array(F.filter(F.transform(ordered, place), lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        named = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        some = let(F.sort_array(named), lambda ordered: let(places(ordered), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(F.lit(0).cast("bigint"))

    return F.coalesce(let(windows(found, 3, lambda *w: F.xxhash64(*w)), count), F.lit(0).cast("bigint"))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))

    def of(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("bigint").alias("n_words"),
            F.length(F.translate(whole, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(found).alias("n_repeat_words"),
        )

    return let(words(whole), of)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed(counts: Column) -> Column:
    """Too few words, or too many in repeated windows, of a struct of counts named once."""
    few = lambda c: (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return let(counts, few)


def bad_rate(mean: float, odds: float = ODDS) -> float:
    """The rate whose odds are ``odds`` times those of ``mean``: below 1 for any mean below 1."""
    return odds * mean / (1 - mean + odds * mean)


def host_verdicts(judged: DataFrame, host: str, failed: str, odds: float = ODDS, spreads: float = SPREADS) -> DataFrame:
    """(host, n, n_failed, shrunk, bad): the beta prior is fitted to all hosts' rates by their mean and variance.

    One row of sums reaches the driver. Where hosts do not differ more than chance makes them, the prior is as
    heavy as an average host; where nothing varies, it weighs two documents and no host is bad.
    """
    hosts = materialize(
        judged.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("bigint")).alias("n_failed")
        ),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n")
    sums = hosts.agg(
        F.sum("n_failed").alias("failed"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n") * rate * rate).alias("squares"),
    ).first()
    n_failed, n = sums["failed"] or 0, sums["n"] or 0
    alpha, beta = beta_prior(n_failed, n, sums["hosts"], sums["squares"] or 0.0)
    weight = F.col("n") + F.lit(alpha + beta)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / weight
    spread = F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
    bound = bad_rate(n_failed / n, odds) if n else 1.0
    bad = (shrunk - spreads * spread >= bound) & F.lit(0 < n_failed < n)
    return materialize(hosts.withColumn("shrunk", shrunk).withColumn("bad", bad), "host-verdicts")


def beta_prior(failed: int, n: int, hosts: int, squares: float) -> tuple[float, float]:
    """alpha and beta with the mean of all documents and a weight from the variance between hosts."""
    if not n or not 0 < failed < n:
        mean = failed / n if n else 0.0
        return 2.0 * mean, 2.0 * (1.0 - mean)
    mean, average = failed / n, n / hosts
    between = max(squares / n - mean * mean, 0.0)
    chance = mean * (1 - mean) / average
    spread = between - chance
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else average
    weight = min(max(weight, 2.0), average if average > 2 else 2.0)
    return mean * weight, (1 - mean) * weight


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = True, odds: float = ODDS, spreads: float = SPREADS
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, the host's documents (``host_docs``), shrunk rate and ``kept``.

    With ``keep_text=False`` the text is dropped once it is counted, so that little is written.
    """
    counts, *names = spare(docs, "_counts", *COUNTS)
    n_failed, n_docs, n_rate, n_kept = spare(docs, "base_failed", "host_docs", "host_rate", "kept")
    rest = [c for c in docs.columns if keep_text or c != text]
    counted = docs.withColumn(counts, text_counts(F.col(text))).select(
        *rest, *[F.col(counts)[c].alias(name) for c, name in zip(COUNTS, names)]
    )
    n_words, n_repeat = F.col(names[0]), F.col(names[4])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    judged = materialize(counted.withColumn(n_failed, failed), "judged")
    v_host, v_docs, v_rate, v_bad = spare(judged, "_host", "_docs", "_rate", "_bad")
    verdicts = host_verdicts(judged, host, n_failed, odds, spreads).select(
        F.col("host").alias(v_host), F.col("n").alias(v_docs), F.col("shrunk").alias(v_rate), F.col("bad").alias(v_bad)
    )
    return judged.join(verdicts, F.col(host).eqNullSafe(F.col(v_host)), "left").select(
        *judged.columns, F.col(v_docs).alias(n_docs), F.col(v_rate).alias(n_rate), (~F.col(n_failed) & ~F.col(v_bad)).alias(n_kept)
    )


def accepted(
    docs: DataFrame, host: str = "source", text: str = "text", odds: float = ODDS, spreads: float = SPREADS
) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are counted once: the documents are written with their verdict, of which the hosts' sums read two columns.
    """
    (failed,) = spare(docs, "_failed")
    (v_host, v_bad) = spare(docs, "_host", "_bad")
    judged = materialize(docs.withColumn(failed, base_failed(text_counts(F.col(text)))), "judged")
    verdicts = host_verdicts(judged.select(host, failed), host, failed, odds, spreads)
    bad = verdicts.where("bad").select(F.col("host").alias(v_host), F.lit(True).alias(v_bad))
    met = judged.where(~F.col(failed)).join(bad, F.col(host).eqNullSafe(F.col(v_host)), "left")
    return met.where(F.col(v_bad).isNull()).select(*docs.columns)
