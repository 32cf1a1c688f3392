"""Line deduplication by a suffix array over line ids, in DataFrame operations only.

All documents' lines, in document order, form one sequence of line ids. Prefix doubling sorts its suffixes: a suffix's
rank by its first 2k lines is the rank of the pair (rank by its first k lines, that of the suffix k lines on), and ranks
are numbered over the sorted distinct pairs. Only suffixes that still share their rank go on, so unique lines, most of any
corpus, take no part. Suffixes of equal rank form an interval of the suffix array whose common prefix is at least as long.

A run counts as repeated from ``min_words`` words on. Every such run is the union of its least windows: from each line the
shortest stretch of ``min_words`` words forward, and the same backward. A window of m lines is named by the ranks of its
first and last 2**floor(log2 m) lines, so doubling ends at the least power of two that the longest window needs, however
long the documents are. A line goes if a window over it has occurred before; stretches of such lines are the maximal
repeated runs. The bound is a few words, so that a single line counts; shorter lines go only with their neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.llm.common import WORD, Scratch

MIN_WORDS = 3


def _line_structs(text: Column) -> Column:
    """Of each line that has words: its number, two hashes (128 bits) and its words."""
    numbered = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line, i: F.struct(
            i.alias("line_no"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("second"), line).alias("k2"), F.regexp_count(line, F.lit(WORD)).alias("words")
        ),
    )
    return F.filter(numbered, lambda x: x["words"] > 0)


def line_sequence(docs: DataFrame, id_col: str, text_col: str, kept: list[str], scratch: Scratch) -> DataFrame:
    """Lines in document order: doc_id, kept columns aside, gpos (place in the whole sequence), i (among the doc's lines).

    Sorting by doc_id deals narrow rows over ranges; ids rise with the range and within it, so gpos follows the order.
    Documents of one id follow each other by their lines' hash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), _line_structs(F.col(text_col)).alias("lines"), *kept)
    hashed = scratch.keep(own.withColumn("tie", F.xxhash64("lines")), "hashes")  # the sort reads its input twice
    ordered = hashed.orderBy("doc_id", "tie").drop("tie")
    return (
        ordered.select("doc_id", *kept, F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
        .select("doc_id", *kept, "n", "i", "line.*", F.monotonically_increasing_id().alias("gpos"))
        .withColumn("doc", F.col("gpos") - F.col("i"))
    )


def _ranked(groups: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Distinct keys that occur twice or more, numbered in sorted order. Written once, so the numbers stay."""
    return scratch.keep(groups.where("n_same > 1").orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")), "ranks")


def _first_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    return _ranked(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_same")), ["k1", "k2"], scratch)


def _doubled(suffixes: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """From ranks by ``step`` lines those by twice as many; suffixes that no other shares are dropped."""
    ahead = Window.partitionBy("doc").orderBy("i").rangeBetween(step, step)
    pairs = suffixes.withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL").withColumnRenamed("rank", "first")
    pairs = scratch.keep(pairs, "pairs")
    ranks = _ranked(pairs.groupBy("first", "next").agg(F.count(F.lit(1)).alias("n_same")), ["first", "next"], scratch)
    return scratch.keep(pairs.join(ranks, ["first", "next"]).select("doc", "i", "gpos", "rank"), "suffixes")


def _windows(marked: DataFrame, min_words: int) -> DataFrame:
    """(start, m): least windows of ``min_words`` words from each line on and up to each line, of repeated lines only."""
    doc = Window.partitionBy("doc")
    upto = doc.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rep = F.col("rank").isNotNull().cast("int")
    rows = (
        marked.withColumn("cum", F.sum("words").over(upto))
        .withColumn("rep_cum", F.sum(rep).over(upto))
        .withColumn("begin", F.col("cum") - F.col("words"))
        .withColumn("total", F.max("cum").over(doc))
        .withColumn("rep_total", F.max("rep_cum").over(doc))
    )
    after = doc.orderBy("begin").rangeBetween(min_words, Window.unboundedFollowing)
    ahead = doc.orderBy("cum").rangeBetween(Window.unboundedPreceding, -min_words)
    rep_before = F.col("rep_cum") - rep
    rows = (
        rows.withColumn("stop", F.min(F.struct("i", rep_before.alias("r"))).over(after))
        .withColumn("last_out", F.max(F.struct("i", F.col("rep_cum").alias("r"))).over(ahead))
        .withColumn("stop_i", F.coalesce(F.col("stop.i"), F.when(F.col("total") - F.col("begin") >= min_words, F.col("n"))))
        .withColumn("stop_r", F.coalesce(F.col("stop.r"), F.col("rep_total")))
        .withColumn("start_i", F.coalesce(F.col("last_out.i") + 1, F.when(F.col("cum") >= min_words, F.lit(0))))
        .withColumn("start_r", F.coalesce(F.col("last_out.r"), F.lit(0)))
    )
    forward = F.when(F.col("stop_r") - rep_before == F.col("stop_i") - F.col("i"), F.struct(F.col("i").alias("at"), (F.col("stop_i") - F.col("i")).alias("m")))
    size = F.col("i") - F.col("start_i") + 1
    backward = F.when(F.col("rep_cum") - F.col("start_r") == size, F.struct(F.col("start_i").alias("at"), size.alias("m")))
    return (
        rows.select("doc", F.explode(F.array_compact(F.array(forward, backward))).alias("w"))
        .select((F.col("doc") + F.col("w.at")).alias("start"), F.col("w.m").alias("m"))
        .distinct()
    )


def repeated_lines(lines: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """gpos of every line that lies in a run of at least ``min_words`` words that has occurred before in ``lines``."""
    marked = lines.select("doc", "n", "i", "gpos", "words", "k1", "k2").join(_first_ranks(lines, scratch), ["k1", "k2"], "left").select("doc", "n", "i", "gpos", "words", "rank")
    marked = scratch.keep(marked, "marked")
    windows = scratch.keep(_windows(marked, min_words), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    suffixes = marked.where("rank IS NOT NULL").select("doc", "i", "gpos", "rank")
    named, k = [], 0
    while (1 << k) <= longest:
        own = windows.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k)).withColumn("tail", F.col("start") + F.col("m") - (1 << k))
        head = suffixes.select(F.col("gpos").alias("start"), F.col("rank").alias("r1"))
        tail = suffixes.select(F.col("gpos").alias("tail"), F.col("rank").alias("r2"))
        named.append(own.join(head, "start").join(tail, "tail").select("m", "r1", "r2", "start"))
        if (2 << k) <= longest:
            suffixes = _doubled(suffixes, 1 << k, scratch)
        k += 1
    if not named:
        return marked.where(F.lit(False)).select("gpos")
    named = scratch.keep(reduce(DataFrame.unionByName, named), "named")
    firsts = named.groupBy("m", "r1", "r2").agg(F.min("start").alias("earliest"), F.count(F.lit(1)).alias("n_same")).where("n_same > 1").drop("n_same")
    firsts = scratch.keep(firsts, "firsts")  # read back, it has no partitioning that would keep Spark from splitting a hot window
    later = named.join(firsts, ["m", "r1", "r2"]).where("start > earliest")
    return later.select(F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("gpos")).distinct()


def line_decisions(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document that has a line with words: doc_id, n_lines, n_deleted, deleted (line numbers from 0, rising).

    Lines are split at line feeds; lines without a word are neither compared nor deleted; n_lines counts the others. The
    first copy by doc_id (then by the lines' hash, null first) stays, also within one document. Null and empty texts have
    no lines and no row; very long texts are split like any other; a null doc_id comes first; repeated rows are copies; an empty table gives an empty table; other columns are
    not read. Two lines are equal if 128 bits of hashes are.
    """
    with Scratch(docs.sparkSession, "lines") as scratch:
        lines = scratch.keep(line_sequence(docs, id_col, text_col, [], scratch), "sequence")
        gone = repeated_lines(lines, scratch, min_words).withColumn("gone", F.lit(True))
        return scratch.result(
            lines.join(gone, "gpos", "left")
            .groupBy("doc", "doc_id")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line_no")))).alias("deleted"))
            .select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), "deleted")
        )


def deduplicated(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row with its repeated lines removed; texts that lose every line become empty, null stays."""
    with Scratch(docs.sparkSession, "lines") as scratch:
        own = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id()), "texts")
        lines = scratch.keep(line_sequence(own, "doc_id", "text", ["uid"], scratch), "sequence")
        gone = lines.join(repeated_lines(lines, scratch, min_words), "gpos").groupBy("uid").agg(F.collect_set("line_no").alias("gone"))
        kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
        return scratch.result(own.join(gone, "uid", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")))
