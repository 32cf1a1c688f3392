"""HTML as a table of nodes, so that paths through it are joins.

A tolerant tokenizer with a stack of open elements turns each page into rows (page, node, parent, last, tag, attributes,
text): nodes are numbered in the order of the page, ``last`` is the greatest number below a node, texts are nodes of their
own with the tag ``#text``. A step to children is an equality of numbers; one to descendants a range within the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from threadloom.functions.columns import first_filled

TEXT = "#text"
# Fixed values, of HTML: elements without an end, elements whose content is text, and elements that end where another begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_AT = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option", "optgroup")), "p": BLOCKS,
}
# Elements beyond which such an end is not looked for.
SCOPES = frozenset("table ul ol dl select td th body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


def attributes(source: str, resolve=html.unescape) -> dict[str, str]:
    """Names in lower case, character references resolved; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), resolve(next((v for v in values if v), "")))
    return found


def nodes(page: str | None, resolve=html.unescape) -> list[tuple[int, int, int, str, dict[str, str], str | None]]:
    """(node, parent, last, tag, attributes, text) of a page in its order; parents of outermost nodes are -1.

    An end without its beginning is passed over; what is open at the end ends there; a bare < is text.
    """
    out: list[list] = []
    stack: list[int] = []

    def end(upto: int) -> None:
        while len(stack) > upto:
            out[stack.pop()][2] = len(out) - 1

    def text(s: str) -> None:
        if s:
            parent = stack[-1] if stack else -1
            if out and out[-1][3] == TEXT and out[-1][1] == parent:
                out[-1][5] += resolve(s)
            else:
                out.append([len(out), parent, len(out), TEXT, {}, resolve(s)])

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        closing, opening, rest = m.group(1), m.group(2), m.group(3)
        if closing:
            tag = closing.lower()
            for k in range(len(stack) - 1, -1, -1):
                if out[stack[k]][3] == tag:
                    end(k)
                    break
        elif opening:
            tag = opening.lower()
            for k in range(len(stack) - 1, -1, -1):
                open_tag = out[stack[k]][3]
                if tag in ENDS_AT.get(open_tag, ()):
                    end(k)
                    break
                if open_tag in SCOPES:
                    break
            out.append([len(out), stack[-1] if stack else -1, len(out), tag, attributes(rest, resolve), None])
            if tag in VOID or rest.endswith("/") and tag not in RAW:
                continue
            stack.append(len(out) - 1)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                raw = page[at : close.start() if close else len(page)]
                if raw:
                    out.append([len(out), stack[-1], len(out), TEXT, {}, resolve(raw) if tag in ("title", "textarea") else raw])
                at = close.end() if close else len(page)
                end(len(stack) - 1)
    end(0)
    return [tuple(n) for n in out]


_NODES = [("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]


def tree(df: DataFrame, page: str, html_column: str, *, as_written: bool = False) -> DataFrame:
    """The node table of pages: ``page`` is the column that tells them apart. Null and empty pages have no nodes.

    Character references are resolved in texts and attributes, or stay as they are written.
    """
    own = df.select(F.col(page).alias("page"), F.col(html_column).alias("html"))
    kinds = {"int32": T.IntegerType(), "string": T.StringType()}
    shape = T.StructType([own.schema["page"], *[T.StructField(n, kinds.get(str(k), T.MapType(T.StringType(), T.StringType()))) for n, k in _NODES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, source in enumerate(batch.column(1).to_pylist()):
                found = nodes(source, str if as_written else html.unescape)
                for at in range(0, len(found), 20_000):
                    part = found[at : at + 20_000]
                    columns = [list(c) for c in zip(*part, strict=True)]
                    columns[4] = [list(a.items()) for a in columns[4]]
                    page_ids = batch.column(0).take(pa.array([k] * len(part), pa.int64()))
                    yield pa.RecordBatch.from_arrays([page_ids, *[pa.array(c, kind) for c, (_, kind) in zip(columns, _NODES, strict=True)]], ["page", *[n for n, _ in _NODES]])

    return own.mapInArrow(run, shape)


# --- conditions and steps -----------------------------------------------------------------------------------------


def attribute(name: str) -> Column:
    """The attribute of a node; empty without it."""
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(""))


def has_class(*names: str) -> Column:
    words = F.split(attribute("class"), r"\s+")
    found = F.lit(True)
    for n in names:
        found = found & F.array_contains(words, n)
    return found


def children(of: DataFrame, nodes_of: DataFrame, where: Column | str = "true") -> DataFrame:
    """The children of nodes (page, node, ...) that meet a condition on the child's own columns, with ``top``: the node they are children of."""
    own = nodes_of.where(where)
    tops = of.select(F.col("page").alias("__p"), F.col("node").alias("top"))
    return own.join(tops, (F.col("page") == F.col("__p")) & (F.col("parent") == F.col("top"))).drop("__p")


def descendants(of: DataFrame, nodes_of: DataFrame, where: Column | str = "true") -> DataFrame:
    """The nodes below nodes (page, node, last) that meet a condition, with ``top``: the node they are below of."""
    own = nodes_of.where(where)
    tops = of.select(F.col("page").alias("__p"), F.col("node").alias("top"), F.col("last").alias("__last"))
    return own.join(tops, (F.col("page") == F.col("__p")) & (F.col("node") > F.col("top")) & (F.col("node") <= F.col("__last"))).drop("__p", "__last")


def texts(of: DataFrame, nodes_of: DataFrame) -> DataFrame:
    """(page, top, text): all texts below each of the nodes, in their order. Nodes without texts have none."""
    below = descendants(of, nodes_of, F.col("tag") == TEXT)
    parts = F.array_sort(F.collect_list(F.struct("node", "text")))
    return below.groupBy("page", "top").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _first_text(tops: DataFrame, nodes_of: DataFrame, where: Column, name: str, *, link: str | None = None) -> DataFrame:
    """(page, top, name[, link]): text, and href, of the first node below each top that meets a condition."""
    below = descendants(tops, nodes_of, where)
    first = below.groupBy("page", "top").agg(F.min(F.struct("node", "last", attribute("href").alias("href"))).alias("f")).select("page", "top", "f.*")
    own = texts(first, nodes_of).withColumnRenamed("top", "node")
    found = first.join(own, ["page", "node"], "left").select("page", "top", tidy(F.col("text")).alias(name), *([F.col("href").alias(link)] if link else []))
    return found


def _joined(tops: DataFrame, *parts: DataFrame) -> DataFrame:
    out = tops.withColumnRenamed("node", "top")
    for p in parts:
        out = out.join(p, ["page", "top"], "left")
    return out


# Fixed value: the site that a forum's links are relative to.
FORUM_SITE = "https://tieba.baidu.com"
_FIELD = "id string, author_name string, author_nickname string, reply_num long, author struct<user_name:string,user_nickname:string,portrait:string>, content struct<post_id:string,comment_num:long,content:string,forum_id:string>"


def absolute(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", FORUM_SITE).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(F.lit(FORUM_SITE), u)).otherwise(u)


def forum_threads(df: DataFrame, page: str, html_column: str) -> DataFrame:
    """Threads of a forum's list pages: (page, note_id, title, desc, note_url, user_link, user_nickname, replies).

    Lists within comments are read too. Entries without data are left out; a title may stand in either of two places.
    """
    t = tree(df.withColumn("__html", F.replace(html_column, F.lit("<!--"), F.lit(""))), page, "__html")
    lists = t.where((F.col("tag") == "ul") & (attribute("id") == "thread_list"))
    entries = children(lists, t, (F.col("tag") == "li") & has_class("j_thread_list")).withColumn("f", F.from_json(attribute("data-field"), _FIELD)).where("f.id IS NOT NULL")
    tops = entries.select("page", "node", "last", "f")
    title = _first_text(tops, t, (F.col("tag") == "a") & has_class("j_th_tit"), "title1")
    heads = descendants(tops, t, has_class("threadlist_title")).select("page", "node", "last", "top")
    links = descendants(heads.select("page", "node", "last"), t, F.col("tag") == "a").select("page", "node", "last", F.col("top").alias("head"))
    linked = links.join(heads.select("page", F.col("node").alias("head"), F.col("top").alias("entry")), ["page", "head"])
    first = linked.groupBy("page", "entry").agg(F.min(F.struct("node", "last")).alias("f")).select("page", F.col("entry"), "f.*")
    other = first.join(texts(first, t).withColumnRenamed("top", "node"), ["page", "node"], "left").select("page", F.col("entry").alias("top"), tidy(F.col("text")).alias("title2"))
    user = _first_text(tops, t, (F.col("tag") == "a") & has_class("frs-author-name"), "said_by", link="user_href")
    about = _first_text(tops, t, (F.col("tag") == "div") & has_class("threadlist_abs"), "about")
    rows = _joined(tops, title, other, user, about)
    filled = lambda *cs: first_filled(*[F.coalesce(F.col(c), F.lit("")) for c in cs])
    return rows.select(
        "page", F.col("f.id").alias("note_id"), filled("title1", "title2").alias("title"), filled("about").alias("desc"), F.concat(F.lit(f"{FORUM_SITE}/p/"), F.col("f.id")).alias("note_url"),
        absolute(F.col("user_href")).alias("user_link"), filled("f.author_nickname", "f.author_name", "said_by").alias("user_nickname"), F.coalesce("f.reply_num", F.lit(0)).alias("replies"),
    )


def forum_comments(df: DataFrame, page: str, html_column: str) -> DataFrame:
    """First-level comments of a thread's pages: (page, comment_id, sub_comment_count, content, user_link, user_nickname, forum_id)."""
    t = tree(df, page, html_column)
    posts = t.where((F.col("tag") == "div") & has_class("l_post", "j_l_post")).withColumn("f", F.from_json(attribute("data-field"), _FIELD)).where("f.content IS NOT NULL")
    tops = posts.select("page", "node", "last", "f", attribute("data-pid").alias("pid"))
    user = _first_text(tops, t, (F.col("tag") == "a") & has_class("p_author_name"), "said_by", link="user_href")
    body = _first_text(tops, t, (F.col("tag") == "div") & has_class("d_post_content"), "body")
    rows = _joined(tops, user, body)
    filled = lambda *cs: first_filled(*[F.coalesce(F.col(c), F.lit("")) for c in cs])
    given = tidy(F.regexp_replace(F.coalesce("f.content.content", F.lit("")), "<[^>]*>", ""))
    return rows.select(
        "page", filled("f.content.post_id", "pid").alias("comment_id"), F.coalesce("f.content.comment_num", F.lit(0)).alias("sub_comment_count"), F.when(given != "", given).otherwise(filled("body")).alias("content"),
        absolute(F.col("user_href")).alias("user_link"), filled("said_by", "f.author.user_nickname", "f.author.user_name").alias("user_nickname"), filled("f.content.forum_id").alias("forum_id"),
    )
