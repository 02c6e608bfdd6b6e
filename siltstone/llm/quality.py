"""Quality rules: counts per text, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed words and word pairs are fitted by counting, one on trusted target documents and
one on the whole raw corpus. A document's score is the sum of log(p_target / p_raw) over its n-grams divided by
their number, and every document is decided by the same fixed threshold. All of it is DataFrame functions: the
n-gram table has a fixed number of buckets, so it reaches the scan as one array from a scalar subquery.

Null text counts as no words; a text without words fails the base rules. Repeated rows count as often as
they stand and get equal rows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import set_aside

#: The blanks between words.
BLANKS = "\t\n\x0b\x0c\r "
_BLANK_RUN = r"[\x20\x09-\x0D]+"
_WORD_CHAR = r"[^\x20\x09-\x0D]"

N_BUCKETS = 1 << 16
#: Pseudo-count of every bucket in both multinomials: an n-gram seen once or twice says nothing either way.
SMOOTHING = 1.0
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.2
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Trusted documents up to which their ids are broadcast; beyond it both sides are shuffled by id.
BROADCAST_IDS = 500_000


def _with(value: Column, body) -> Column:
    """body(value), evaluating value once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _BLANK_RUN))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(_WORD_CHAR))
    return _with(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def n_repeat_words(ws: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that occur twice or more: windows are hashed, hashes sorted, equal neighbours found."""
    starts = F.sequence(F.lit(1), F.size(ws) - width + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, width)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _with(
            placed,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        # Each window adds the words that the one before has not covered.
        total = F.aggregate(
            F.array_sort(again),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i - acc["last"])).cast("long").alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    return F.when(F.size(ws) <= width, F.lit(0).cast("long")).otherwise(_with(hashes, covered))


def grams(ws: Column, n_buckets: int = N_BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(n_buckets)).cast("int")
    pairs = F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: bucket(a, b))
    return F.when(F.size(ws) < 2, F.transform(ws, lambda x: bucket(x))).otherwise(
        F.concat(F.transform(ws, lambda x: bucket(x)), pairs)
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, `ratios`: log(p_target / p_raw) of every bucket.

    docs: doc_id, text. trusted: doc_id of the target documents. Counts cover all documents. Without any
    target document there is no evidence against a text, and all ratios are 0.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    counts = (
        docs.select("doc_id", "text")
        .join(ids, "doc_id", "left")
        .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(_with(words(F.col("text")), lambda w: grams(w, n_buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    spine = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    table = spine.join(counts, "bucket", "left").groupBy().agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("t"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"),
    )
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * n_buckets))
    return table.select(
        F.when(F.col("n_target") == 0, F.transform("t", lambda x: F.lit(0.0)))
        .otherwise(F.transform("t", lambda x: share(x["target"], F.col("n_target")) - share(x["raw"], F.col("n_raw"))))
        .alias("ratios")
    )


def quality(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    n_buckets: int = N_BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """docs with the counts, `score` (mean log ratio, null without words), base_failed and kept."""
    ratios = log_ratios(docs, trusted, n_buckets, smoothing).scalar()

    def measured(w: Column, r: Column) -> Column:
        total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(r, b)) / F.size(g)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
            F.when(F.size(w) > 0, _with(grams(w, n_buckets), total)).alias("score"),
        )

    m = _with(F.struct(words(F.col("text")).alias("w"), F.col("_r").alias("r")), lambda x: _with(x["w"], lambda w: measured(w, x["r"])))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "_m", "_r"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        docs.drop(*own)
        .withColumn("_r", ratios)
        .withColumn("_m", m)
        .withColumns(
            {
                "n_words": F.col("_m.n_words"),
                "word_chars": F.col("_m.word_chars"),
                "n_symbols": n_symbols(F.col("text")),
                "n_dup_lines": n_dup_lines(F.col("text")),
                "n_repeat_words": F.col("_m.n_repeat_words"),
                "score": F.col("_m.score"),
            }
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False)))
        .drop("_m", "_r")
    )


def kept_documents(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    The verdict passes through a generator of one row. A filter stays above a generator; it would move below the
    projection that measures a text, and measure it anew for every column that the verdict names.
    """
    held, restored = set_aside(docs)
    judged = quality(held, trusted, **how).withColumn("_kept", F.explode(F.array("kept")))
    return restored(judged.where("_kept"))
