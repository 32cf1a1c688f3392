"""Where columns do not suffice: longest quotes, JSON out of model answers, models injected by the caller. Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import StringType

from threadloom.functions.columns import first_filled, quote_exists, strip
from threadloom.operators.matching import Pool
from threadloom.operators.vocabulary import holding

_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)```", re.DOTALL)


def longest_quote(text: Column, pool: Column, limit: int = 48, least: int = 4) -> Column:
    """The text if it stands in the pool (cut at the limit), else its longest part of at least 4 characters that does, else empty.

    Null texts and pools are empty. Time and memory grow with the length of both, whatever they hold.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, pools: pd.Series) -> pd.Series:
        return pd.Series([Pool(p).longest(t, limit, least) for t, p in zip(texts, pools, strict=True)], dtype=object)

    return run(text, pool)


def repaired_quotes(quotes: Column, pool: Column, limit: int = 48) -> Column:
    """An array as long as ``quotes``: each stripped if it stands in the pool, else its longest part that does; empty without one."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series, pools: pd.Series) -> pd.Series:
        out = []
        for own, p in zip(lists, pools, strict=True):
            held = Pool(p)
            bare = [(q or "").strip() for q in own] if own is not None else None
            out.append(None if bare is None else [q if q and held.holds(q) else held.longest(q, limit) for q in bare])
        return pd.Series(out, dtype=object)

    return run(quotes, pool)


def repaired_quote(quote: Column, pool: Column, limit: int = 48) -> Column:
    """A quote that stands in the pool as it is; else its longest part that does; empty without one."""
    return F.when((strip(quote) != "") & quote_exists(strip(quote), pool), strip(quote)).otherwise(longest_quote(quote, pool, limit))


def grounded_relations(df: DataFrame, pool: Column) -> DataFrame:
    """Relations (hypothesis_id, relation, evidence_quote): a supporting or weakening one without a real quote is insufficient."""
    weighty = F.col("relation").isin("supports", "weakens")
    fixed = df.withColumn("__quote", F.when(weighty, repaired_quote(F.coalesce("evidence_quote", F.lit("")), pool)).otherwise(F.col("evidence_quote")))
    lost = weighty & (F.col("__quote") == "")
    return fixed.withColumns({"relation": F.when(lost, "insufficient").otherwise(F.col("relation")), "evidence_quote": F.col("__quote")}).drop("__quote")


def grounded_quotes(quotes: Column, pool: Column, limit: int = 48) -> Column:
    """Quotes that stand in the pool, others mended; what can't be mended is left out. Problems are mended up to 64 characters."""
    return F.filter(repaired_quotes(F.coalesce(quotes, F.array().cast("array<string>")), pool, limit), lambda q: q != "")


def grounded_signals(df: DataFrame, signals: str, pool: Column) -> DataFrame:
    """Signals (type, text, evidence_quote, ...) whose quote stands in the pool stay as they are; others get the longest part of
    their text, else of their quote, that does; those without one are dropped. A null array becomes an empty one."""
    field = lambda n: F.transform(F.coalesce(F.col(signals), F.array()), lambda s: F.coalesce(s[n], F.lit("")))
    mended = df.withColumn("__text", repaired_quotes(field("text"), pool)).withColumn("__quote", repaired_quotes(field("evidence_quote"), pool)).withColumn("__cut", F.transform("__text", lambda t: F.substring(t, 1, 48)))

    def own(s: Column, i: Column) -> Column:
        quote, stripped = F.element_at("__quote", i + 1), strip(F.coalesce(s["evidence_quote"], F.lit("")))
        whole = (stripped != "") & (quote == stripped)
        return s.withField("evidence_quote", F.when(whole, s["evidence_quote"]).otherwise(first_filled(F.element_at("__cut", i + 1), quote)))

    kept = F.filter(F.transform(signals, own), lambda s: s["evidence_quote"] != "")
    return mended.withColumn(signals, F.coalesce(kept, F.array().cast(df.schema[signals].dataType))).drop("__text", "__quote", "__cut")


def _closed(text: str) -> str:
    """A cut-off object with its open string, lists and objects closed; a last entry that has no value yet is dropped."""
    stack, inside, escaped, safe = [], False, False, ""
    for i, c in enumerate(text):
        if inside:
            inside, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        elif c == ",":
            safe = text[:i] + "".join(reversed(stack))
    whole = text + ('"' if inside else "") + "".join(reversed(stack))
    try:
        json.loads(whole)
    except ValueError:
        return safe
    return whole


def _object(text: str | None) -> str | None:
    """The JSON object of a model's answer: the whole, a fenced block, the first complete object, or a cut-off one mended."""
    raw = (text or "").strip()
    for body in (raw, *(m.strip() for m in _FENCE.findall(raw))):
        at = body.find("{")
        for candidate in (body, body[at:] if at >= 0 else ""):
            try:
                found, _ = json.JSONDecoder().raw_decode(candidate) if candidate is not body else (json.loads(body), 0)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
    at = raw.find("{")
    if at >= 0:
        try:
            found = json.loads(_closed(raw[at:]))
        except ValueError:
            return None
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    return None


@F.pandas_udf(StringType())
def json_object(answers: pd.Series) -> pd.Series:
    """Normalised JSON text of the object in each answer, null without one; from_json reads it under a schema."""
    return pd.Series([_object(a) for a in answers], dtype=object)


def compact_cards(payload: Column, types: dict[str, str], scopes: dict[str, str]) -> Column:
    """Items of a compact answer: arrays of (type code, quote[, scope code[, subtype]]), codes looked up, in either slot order.

    Entries whose first slot is no type code are tried with type and quote swapped; without any code they are dropped.
    """
    rows = F.from_json(payload, "array<array<string>>")
    kinds, speakers = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (types, scopes))
    get = lambda r, i: F.coalesce(F.try_element_at(r, F.lit(i)), F.lit(""))
    named = F.transform(
        rows,
        lambda r: F.struct(
            F.coalesce(F.try_element_at(kinds, get(r, 1)), F.try_element_at(kinds, get(r, 2))).alias("type"),
            F.when(F.map_contains_key(kinds, get(r, 1)), get(r, 2)).otherwise(get(r, 1)).alias("evidence_quote"),
            F.coalesce(F.try_element_at(speakers, get(r, 3)), F.lit("unclear")).alias("speaker_scope"),
            get(r, 4).alias("subtype"),
        ),
    )
    return F.filter(named, lambda x: x["type"].isNotNull() & (x["evidence_quote"] != ""))


def with_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 20) -> DataFrame:
    """Rows through a model that the caller injects: ``make`` builds a client once a task, which answers batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                yield answer(pdf.iloc[at : at + batch])

    return df.mapInPandas(run, schema)


def guarded(answers: DataFrame, texts: DataFrame, key: str, *, worth: int = 6) -> DataFrame:
    """Answers (key, worth, quote) that count: of known rows, worth enough, with a quote that stands in the row's text."""
    joined = answers.join(texts.select(key, F.col("text").alias("__text")), key)
    return joined.where((F.col("worth") >= worth) & (strip(F.col("quote")) != "") & quote_exists(strip(F.col("quote")), F.col("__text"))).drop("__text")


def verbatim_quotes(quotes: DataFrame, texts: DataFrame, *, quote: str = "quote", text: str = "text") -> DataFrame:
    """Pairs of a quote and a text that holds it verbatim: all columns of both (names must differ).

    One walk along each text finds all quotes in it, of any length; texts aren't shuffled, only the rows that hold quotes
    are joined. Empty and null quotes and null texts give no pair; equal quotes each give their own.
    """
    needles = quotes.select(F.col(quote).alias("needle")).where("needle IS NOT NULL").distinct()
    found = holding(texts, text, needles)
    return found.join(quotes, found["needle"] == quotes[quote]).drop("needle")


def labels_of(c: Column, names: Sequence[str]) -> Column:
    """The names that the array holds, in the stated order."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(c, n))
