"""Vocabularies of any size looked for in texts: one trie for all tokens, one walk from each place of each text.

A token counts where it stands anywhere in a text, both without white space and in lower case. The tokens' trie is built
once a worker from a broadcast list. A vocabulary beyond ``PART_CHARS`` characters is split by hash into parts of at most
about that size, and each part is one more scan; the texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from threadloom.functions.columns import keyword_tokens, squeeze
from threadloom.operators.needles import Needles
from threadloom.scratch import materialise

#: Characters of the tokens of one trie: some 24 to 36 bytes of a worker each where no two tokens begin alike, less where they do.
PART_CHARS = 16_000_000

_tries: dict[str, Needles] = {}


def _trie(part: tuple[str, Broadcast]) -> Needles:
    """The trie of a named broadcast list of needles, kept while this worker works on the same list."""
    name, needles = part
    if name not in _tries:
        _tries.clear()
        _tries[name] = Needles(needles.value)
    return _tries[name]


def tokens_of(df: DataFrame, text: Column, stop: Sequence[str] = ()) -> DataFrame:
    """The different keyword tokens (two characters or more, between white space and punctuation) of all texts: (token)."""
    return df.select(F.explode(keyword_tokens(F.coalesce(text, F.lit("")), stop)).alias("token")).distinct()


def _vocabulary(spark: SparkSession, tokens: DataFrame | Sequence[str]) -> DataFrame:
    """(token, needle): tokens as they are looked for; those without a character but white space are left out."""
    if not isinstance(tokens, DataFrame):
        tokens = spark.createDataFrame([(t,) for t in tokens], "token string")
    return tokens.select("token").distinct().withColumn("needle", squeeze(F.col("token"))).where("needle <> ''")


def _parts(vocabulary: DataFrame, part_chars: int) -> list[tuple[str, Broadcast]]:
    """Broadcast lists of needles. What the driver holds at once is one part."""
    needles = vocabulary.select("needle").distinct()
    chars = needles.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("c")).first()["c"]
    n = -(-chars // part_chars)
    out = []
    for k in range(n):
        own = [r["needle"] for r in needles.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == k).collect()]
        if own:
            out.append((uuid.uuid4().hex, vocabulary.sparkSession.sparkContext.broadcast(own)))
    return out


def document_frequency(df: DataFrame, text: Column, tokens: DataFrame | Sequence[str], part_chars: int = PART_CHARS) -> DataFrame:
    """token, hits (rows whose text holds it), total (rows). Null texts hold nothing; tokens that no text holds have 0.

    A task adds up its own counts, so what is shuffled is a row for each token and task at most.
    """
    vocabulary = _vocabulary(df.sparkSession, tokens)
    texts = df.select(squeeze(text).alias("t"))

    def counted(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            needles = part[1].value
            own, hits = _trie(part), np.zeros(len(needles), np.int64)
            for batch in batches:
                for _, found in own.in_texts(batch.column(0).to_pylist()):
                    np.add.at(hits, found, 1)
            held = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array([needles[k] for k in held], pa.string()), pa.array(hits[held])], ["needle", "n"])

        return texts.mapInArrow(run, "needle string, n long")

    parts = _parts(vocabulary, part_chars)
    empty = df.sparkSession.createDataFrame([], "needle string, n long")
    found = reduce(DataFrame.union, [counted(p) for p in parts], empty).groupBy("needle").agg(F.sum("n").alias("hits"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return vocabulary.join(found, "needle", "left").crossJoin(F.broadcast(total)).select("token", F.coalesce("hits", F.lit(0)).alias("hits"), "total")


def rarity(hits: Column, total: Column, least_rows: int) -> Column:
    """How much a token tells: 0 above a fifth of the rows, 0.4 above a twentieth, else 1; 1 for all in a small corpus."""
    share = hits / total
    return F.when(total < least_rows, 1.0).when(share > 0.2, 0.0).when(share > 0.05, 0.4).otherwise(1.0)


def rarity_weights(df: DataFrame, text: Column, tokens: DataFrame | Sequence[str], least_rows: int = 200) -> DataFrame:
    """token, hits, weight of each token over all rows."""
    return document_frequency(df, text, tokens).select("token", "hits", rarity(F.col("hits"), F.col("total"), least_rows).alias("weight"))


def holding(df: DataFrame, text: str, needles: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of df with each needle that the column ``text`` holds, exactly as it is written, one row each, as ``needle``.

    Null texts hold nothing, and empty needles are nowhere. Only rows that hold a needle come, as often as they hold different ones.
    """
    at_text = df.columns.index(text)
    shape = T.StructType([*df.schema.fields, T.StructField("needle", T.StringType())])

    def held(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            needles, own = part[1].value, _trie(part)
            for batch in batches:
                for at, found in own.in_texts(batch.column(at_text).to_pylist()):
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns], pa.array([needles[k] for k in found], pa.string())], [*batch.schema.names, "needle"])

        return df.mapInArrow(run, shape)

    empty = df.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.union, [held(p) for p in _parts(needles.where("needle <> ''"), part_chars)], empty)


def matches(df: DataFrame, text: Column, tokens: DataFrame | Sequence[str], *, keep: dict[str, Column], part_chars: int = PART_CHARS) -> DataFrame:
    """The columns to keep with each needle that the row's text holds, white space and case aside, one row each, as ``needle``."""
    own = df.select(squeeze(text).alias("__t"), *[c.alias(n) for n, c in keep.items()])
    return holding(own, "__t", _vocabulary(df.sparkSession, tokens), part_chars).drop("__t")


def scenario_check(
    df: DataFrame, *, text: Column, user: Column, video: Column, scenarios: dict[str, Sequence[str]] | DataFrame, order: Column | None = None, min_hits: int = 8, min_users: int = 5, least_rows: int = 200
) -> DataFrame:
    """Per scenario: hits, users, videos of the rows that hold one of its telling tokens, the tokens and quotes behind them, a verdict.

    A token tells if its weight is 0.9 or more. ``scenarios`` are (scenario, token) rows or a dict. users are the different
    filled ones, or the hits without any. ``tokens`` are its six most frequent telling ones with counts (ties by name),
    ``quotes`` the first 80 characters of the three first rows by ``order`` (by text without it). Scenarios without hits stay.
    """
    spark = df.sparkSession
    if not isinstance(scenarios, DataFrame):
        scenarios = spark.createDataFrame([(s, t) for s, ts in scenarios.items() for t in ts or [""]], "scenario string, token string")
    asked = scenarios.select("scenario", squeeze(F.col("token")).alias("needle"))
    weights = rarity_weights(df, text, scenarios.select("token"), least_rows).groupBy(squeeze(F.col("token")).alias("needle")).agg(F.max("weight").alias("weight"))
    telling = asked.join(weights.where("weight >= 0.9"), "needle").select("scenario", "needle").distinct()
    row = F.monotonically_increasing_id()
    keep = {"row": row, "user": user.cast("string"), "video": video.cast("string"), "quote": F.substring(text, 1, 80), "at": (order if order is not None else F.substring(text, 1, 80)).cast("string")}
    found = matches(df, text, telling.select(F.col("needle").alias("token")), keep=keep).join(F.broadcast(telling), "needle")
    rows = found.groupBy("scenario", "row").agg(*[F.first(c).alias(c) for c in ("user", "video", "quote", "at")], F.collect_set("needle").alias("needles"))
    rows = materialise(rows, "scenario")  # of a row at most its scenario's tokens
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    counts = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(filled("user")).alias("users"), F.count_distinct(filled("video")).alias("videos"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("scenario").orderBy("at", "quote", "row"))).where("k <= 3")
    quotes = first.groupBy("scenario").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quote"))), lambda x: x["quote"]).alias("quotes"))
    per_token = rows.select("scenario", F.explode("needles").alias("needle")).groupBy("scenario", "needle").agg(F.count(F.lit(1)).alias("n"))
    six = per_token.groupBy("scenario").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "needle"))), 1, 6).alias("t"))  # a scenario's own tokens
    named = six.select("scenario", F.transform("t", lambda x: F.struct(x["needle"].alias("token"), (-x["m"]).alias("n"))).alias("tokens"))
    all_of = scenarios.select("scenario").distinct().join(counts, "scenario", "left").join(named, "scenario", "left").join(quotes, "scenario", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    users = F.when(number("users") > 0, number("users")).otherwise(number("hits"))
    out = all_of.select("scenario", number("hits").alias("hits"), users.alias("users"), number("videos").alias("videos"), "tokens", "quotes")
    verdict = F.when((F.col("hits") >= min_hits) & (F.col("users") >= min_users), "signal").when(F.col("hits") > 0, "weak").otherwise("none")
    return out.withColumn("verdict", verdict)

