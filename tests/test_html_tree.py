"""Node tables of pages, against the standard library's parser."""

import json
import os
from html import escape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from threadloom.sources import html_tree

SF = "/root/testdata/sf0.001"


class Seen(HTMLParser):
    """What the standard library's parser says of titles, links, list items and all texts; no tree."""

    def __init__(self, source):
        super().__init__()
        self.links, self.titles, self.items, self.texts, self._title, self._link = [], [], [], [], False, None
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self._title = tag == "title"
        if tag == "a":
            self._link = [dict(attrs).get("href"), ""]
            self.links.append(self._link)
        if tag == "li":
            self.items.append("")

    def handle_endtag(self, tag):
        self._title = False
        if tag == "a":
            self._link = None
        if tag in ("li", "ul"):
            self.items.append(None)

    def handle_data(self, data):
        self.texts.append(data)
        if self._title:
            self.titles.append(data)
        if self._link:
            self._link[1] += data
        if self.items and self.items[-1] is not None:
            self.items[-1] += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_titles_links_lists_and_texts_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    t = html_tree.tree(pages, "page_id", "html").cache()
    want = {r["page_id"]: Seen(r["html"] or "") for r in pages.collect()}

    def of(df):
        got = {}
        for r in df.orderBy("page", "node").collect():
            got.setdefault(r["page"], []).append(r["text"])
        return got

    def named(tag):
        own = t.where(F.col("tag") == tag)
        return own.select("page", "node", "attributes").join(html_tree.texts(own, t).withColumnRenamed("top", "node"), ["page", "node"], "left")

    assert of(named("title")) == {k: ["".join(v.titles)] for k, v in want.items() if v.titles}
    links = {}
    for r in named("a").orderBy("page", "node").collect():
        links.setdefault(r["page"], []).append([r["attributes"]["href"], r["text"] or ""])
    assert links == {k: v.links for k, v in want.items() if v.links}
    assert {k: [x or "" for x in v] for k, v in of(named("li")).items()} == {k: own for k, v in want.items() if (own := [x for x in v.items if x is not None])}
    assert {k: "".join(x or "" for x in v) for k, v in of(t.where("tag = '#text'")).items()} == {k: "".join(v.texts) for k, v in want.items()}


def test_broken_markup():
    n = html_tree.nodes('<ul><li>a<ul><li>b<li>c</ul></i>d<li x=1 X=2 y>e</ul><p>f<div>g</b> < h &amp; <br/>i<!-- <p> --><script>"</p>"</script><td')
    parent = {k: p for k, p, *_ in n}
    tag = {k: t for k, _, _, t, _, _ in n}
    path = lambda k: [] if k < 0 else [*path(parent[k]), tag[k]]
    assert [("/".join(path(p)), s) for _, p, _, t, _, s in n if t == "#text"] == [
        ("ul/li", "a"), ("ul/li/ul/li", "b"), ("ul/li/ul/li", "c"), ("ul/li", "d"), ("ul/li", "e"), ("p", "f"), ("div", "g < h & "), ("div", "i"), ("div/script", '"</p>"'), ("div", "<td"),
    ]
    assert [a for *_, t, a, _ in n if t == "li"][-1] == {"x": "1", "y": ""}
    assert all(k <= last < len(n) and all(k < j <= last for j in parent if parent[j] == k) for k, _, last, *_ in n)
    assert html_tree.nodes(None) == [] and html_tree.nodes("plain") == [(0, -1, 0, "#text", {}, "plain")]


def test_steps_and_forum_pages(spark):
    entry = lambda field, inner: f'<li class="x j_thread_list" data-field="{escape(json.dumps(field))}">{inner}</li>'
    listed = entry({"id": 7, "reply_num": 3, "author_name": "an"}, '<div class="threadlist_title"><a href="/p/7"> The  title </a></div><div class="threadlist_abs">about</div>')
    listed += entry({"id": 8}, '<a class="j_th_tit">T<b>8</b></a><a class="frs-author-name" href="/home/main?u=1">who</a>') + entry({}, "none")
    post = f'<div class="l_post j_l_post" data-pid="9" data-field="{escape(json.dumps({"content": {"comment_num": 2, "forum_id": 5}, "author": {"user_name": "n"}}))}"><div class="d_post_content">said <br>it</div></div>'
    df = spark.createDataFrame([(1, f'<!-- <ul id="thread_list">{listed}</ul> -->'), (2, post), (3, None)], "id int, h string")
    threads = html_tree.forum_threads(df, "id", "h").orderBy("note_id").collect()
    assert [(r["note_id"], r["title"], r["desc"], r["user_nickname"], r["replies"]) for r in threads] == [("7", "The title", "about", "an", 3), ("8", "T8", "", "who", 0)]
    assert threads[1]["user_link"] == "https://tieba.baidu.com/home/main?u=1" and threads[0]["note_url"].endswith("/p/7")
    said = html_tree.forum_comments(df, "id", "h").collect()
    assert [(r["page"], r["comment_id"], r["sub_comment_count"], r["content"], r["user_nickname"], r["forum_id"]) for r in said] == [(2, "9", 2, "said it", "n", "5")]
    t = html_tree.tree(df.withColumn("h", F.replace("h", F.lit("<!--"), F.lit(""))), "id", "h")
    assert html_tree.children(t.where("tag = 'li'"), t, F.col("tag") == "a").count() == 2 and html_tree.descendants(t.where("tag = 'ul'"), t, "tag = 'a'").count() == 3


def test_page_links_equal_their_sql_where_references_are_cut_or_of_other_kinds(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from threadloom.plans import queries as plans

    titles = ["a &amp;&amp and&amp", "x &quot;0b96", "&amp;lt; &#39;", "\u00a0 a\n\t b\u3000 ", "", "&ampamp;"]
    links = ['<a href="/a?x=1&amp;y=2">a</a><a class="c" href="/b">b</a>', '<a href="">c</a><a>d</a>', '<a href="/é&lt;">e</a><a href="/d">f</a>']
    pages = [(k, f"<html><head><title>{t}</title></head><body>{links[k % 3]}</body></html>") for k, t in enumerate(titles)] + [(90, "<p>no title</p>"), (91, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = plans.queries()["page_links"](spark, str(tmp_path)).select("page_id", "title", "links", "href_digest").collect()
    want = con.execute(f"SELECT page_id, title, links, href_digest FROM ({plans.oracle_sql()['page_links']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
