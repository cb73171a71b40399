"""Quality rules with thresholds that adapt to language and source.

Every document gets counts (words, symbols, repeated lines, words in repeated windows) from array expressions over its
whole text. Quantile sketches of the derived ratios are built per language and source, per language, and overall; they
merge, so rows are summarized before any shuffle. A ratio is out of bounds where it lies further than `SPREAD` quartile
ranges (with a least range, so that a group of equal values still has some room) outside the quartiles of its group; a group
of fewer than `GROUP_ROWS` rows looks at its language, a small language at the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import WORD_GAP, computed, row_column
from talus.runtime import attach_to_groups, cut_lineage

GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GROUP_ROWS = 100
SPREAD = 6.0
ACCURACY = 10_000
# Ratio -> (least quartile range, whether small values are out of bounds as well). Words in repeated windows have only their
# fixed base rule.
RATIOS = {"symbol_ratio": (0.012, False), "word_length": (0.5, True), "line_ratio": (0.08, False)}


def counted(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs -> (row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines). A NULL text has no words."""
    rows = docs.select(row_column(docs))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    length = lambda drop: F.length(F.translate(text, drop, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = computed(rows, words=F.filter(F.split(text, WORD_GAP), lambda w: w != ""), lines=lines)
    n = F.size("words")
    each = lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(window)])
    hashes = F.when(n > window, F.transform(F.sequence(F.lit(0), n - window), each)).otherwise(F.array().cast("array<long>"))
    rows = computed(rows, hashes=hashes, n_words=n.cast("long"), n_lines=F.size("lines").cast("long"),
                 n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("words", "lines")
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    sorted_ = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = computed(rows, places=F.when(repeated, sorted_).otherwise(none)).drop("hashes")
    same = lambda s, j: F.coalesce(F.get(F.col("places"), j)["h"] == s["h"], F.lit(False))
    twice = F.filter("places", lambda s, j: same(s, j - 1) | same(s, j + 1))
    starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda acc, i: F.struct(i.alias("last"), (acc["words"] + F.least(F.lit(window), i - acc["last"])).alias("words")),
        lambda acc: acc["words"])
    return computed(rows, n_repeat_words=covered, word_chars=length(GAPS).cast("long"),
                 n_symbols=(F.length(text) - length(SYMBOLS)).cast("long")).drop("places")


def with_ratios(rows: DataFrame) -> DataFrame:
    """Ratios from the counts; NULL (never out of bounds) without words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return rows.withColumns({"symbol_ratio": per("n_symbols", "word_chars"), "word_length": per("word_chars", "n_words"),
                             "line_ratio": per("n_dup_lines", "n_lines")})


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*): one row per group of (lang, source)."""
    sketches = [F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(f"q_{r}") for r in RATIOS]
    level = rows.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("rows"), *sketches)
    level = cut_lineage(level)  # a few rows per group, used three times
    quartiles = F.struct("rows", *[f"q_{r}" for r in RATIOS])
    overall = level.where("level = 3").first()  # one row, or none without rows
    bound = lambda r: F.array(*[F.lit(x).cast("double") for x in (overall[f"q_{r}"] if overall and overall[f"q_{r}"] else (None, None))])
    by_lang = level.where("level = 1").select("lang", quartiles.alias("of_lang"))
    groups = level.where("level = 0").select("lang", "source", quartiles.alias("own"))
    joined = attach_to_groups(groups, by_lang, ["lang"])
    bounds = []
    for r, (least, both) in RATIOS.items():
        used = F.when(F.col("own.rows") >= GROUP_ROWS, F.col(f"own.q_{r}")).when(
            F.col("of_lang.rows") >= GROUP_ROWS, F.col(f"of_lang.q_{r}")).otherwise(bound(r))
        q1, q3 = F.get(used, 0), F.get(used, 1)
        room = SPREAD * F.greatest(q3 - q1, F.lit(least))
        bounds += [(q3 + room).alias(f"high_{r}"), (q1 - room if both else F.lit(float("-inf"))).alias(f"low_{r}")]
    return joined.select("lang", "source", *bounds)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(counts: DataFrame) -> DataFrame:
    """Counted rows (their `row` holding lang and source) -> the same with base_failed and kept. The counts are stored
    once: thresholds and verdicts come from the same rows. Quartiles leave out what fails the base rules. NULL language
    or source is a group like any other."""
    rows = counts.select("*", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    rows = cut_lineage(with_ratios(rows).withColumn("base_failed", base_failed()))
    placed = attach_to_groups(rows, thresholds(rows.where(~F.col("base_failed"))), ["lang", "source"])
    inside = [F.coalesce((F.col(r) <= F.col(f"high_{r}")) & (F.col(r) >= F.col(f"low_{r}")), F.lit(True)) for r in RATIOS]
    return placed.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, inside))


def digest(docs: DataFrame) -> DataFrame:
    # The text itself is not stored with the counts.
    slim = counted(docs.select("doc_id", "lang", "source", "text")).withColumn("row", F.col("row").dropFields("text"))
    return judged(slim).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept")
