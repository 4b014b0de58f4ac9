from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions.html import decode_references
from pagemill.functions.references import with_characters, with_common_references
from pagemill.operators import content, links, metadata, navigation, sampling
from pagemill.operators import tokens as TK
from pagemill.operators.document import page_documents

LONG = "word " * 30
SF = "/root/testdata/sf0.001"


def first(df, *columns):
    return df.orderBy("page_id").select(*columns).collect()


def test_tokens_cover_the_document(make_pages):
    docs = [
        "a < b > c <p title='x>y'>t</p>",
        "<script>if (a<b) '</p>'</script ><STYLE>p{}</STYLE>",
        "<!-- <nav> --><!doctype html><br/><a href=q/>",
        'text <a title="open>rest',
        "<![CDATA[raw & <b>]]>end",
    ]
    toks = TK.page_tokens(make_pages(*docs)).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tok", "kind"))).alias("t"))
    rows = first(toks, "t")
    assert ["".join(t.tok for t in r.t) for r in rows] == docs
    assert [t.kind for t in rows[0].t] == ["text", "open", "text", "close"]
    assert [t.kind for t in rows[1].t] == ["raw", "raw"]
    assert [t.kind for t in rows[2].t] == ["comment", "comment", "void", "open"]


def test_texts_agree_with_the_standard_parser(spark):
    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.raw, self.out = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")
            self.out.append("")

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style")
            self.out.append("")

        def handle_comment(self, data):
            self.out.append("")

        def handle_data(self, data):
            if not self.raw:
                self.out[-1] += data

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.t for r in page_documents(pages).select("page_id", F.transform("texts", lambda t: t["text"]).alias("t")).collect()}
    for row in pages.collect():
        parser = Texts()
        parser.feed(row.html)
        parser.close()
        assert found[row.page_id] == [t.strip() for t in parser.out if t.strip()]


def test_character_references(spark):
    cases = {
        "&eacute;&#8217;&#150;&#xD800; AT&T &foo; &lt;": "é’–� AT&amp;T &amp;foo &lt;",
        "<a href='?a=1&copy=2&eacute;'>": "<a href='?a=1&copy=2é'>",
        "x<p>&hellip": "x<p>…", "": "", "&#38;&#x3c;&#00065;&#99999999999999999999;&#0;&#xFFFE;&#13;&#x81;": "&amp;&lt;A\ufffd\ufffd\ufffd\r\x81",
        "&NotEqualTilde;&fjlig;<i t='&hellip;&nope;'>&": "≂\u0338fj<i t='…&nope;'>&",
    }
    table = spark.createDataFrame([(k,) for k in cases], "doc string")
    assert {r.doc: r.found for r in table.withColumn("found", with_characters(F.col("doc"))).collect()} == cases


def test_references_agree_with_the_standard_library(spark):
    """All names, and numbers of all kinds, in one document each; it stays in the JVM."""
    refs = ["&" + n for n in html5 if n.endswith(";")] + [f"&#{i};" for i in [*range(0, 300), 8217, 0xFDD1, 0x1FFFF, 0x1F511, 0x10FFFF, 0x110000]]
    table = spark.createDataFrame([("[sep]".join(refs), 1)], "html string, i int")
    found = with_common_references(table)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.select(decode_references(F.col("html")).alias("t")).first().t.split("[sep]")
    # what is no character is shown as such, not left out
    assert got == [unescape(r) or "\ufffd" for r in refs]


def test_metadata(make_pages):
    docs = [
        "<h1>only <b>h1</b></h1>",
        "<title></title><h1>x</h1>",
        "<title>a<b>c</b></title>",
        '<title> T &amp; t </title><meta name="description"><meta name="article:author" content="A &quot;q&quot;"><meta name=author content=B>'
        '<meta property="date" content="no"><meta name="date" content="2024"><h2>two</h2><h3> </h3><h1>one</h1>',
    ]
    found = first(metadata.page_metadata(page_documents(make_pages(*docs))), "title", "description", "author", "date", "headings")
    assert [r.title for r in found] == ["onlyh1", None, None, "T & t"]
    assert tuple(found[3])[1:] == ("", 'A "q"', "2024", ["two", "", "one"])
    assert found[0].description is None and found[2].headings is None


def test_main_content_by_container(make_pages):
    docs = [
        "<main>m</main><article>a<nav>n</nav><div class='x ad'>ad<div>in</div></div><script>s</script><aside>side</aside> b </article>",
        "<article> </article><main>m</main>",
        "<div class='main-content'>late</div><div id=content>early <p>p</div>after",
        "<article>one</article><article>two</article>",
        "<div role=main>role</div>",
        "<article>open <p>x",
        "<p class=content>a<p>b</p>c</p>",
    ]
    found = first(content.main_content(page_documents(make_pages(*docs))), "main_content")
    assert [r[0] for r in found] == ["a\nside\nb", None, "early\np", "one", "role", "open\nx", "a\nb\nc"]


def test_main_content_by_density(make_pages):
    docs = [
        f"<div><div>{LONG}<i></i><i></i></div></div><section>{LONG}<nav>n</nav><p class=ad>cut</p></section><div>short</div>",
        f"<div>{LONG}</div><div>{LONG}!</div><div>{LONG}</div>",
        "<div>short</div>",
        f"<aside><div>{LONG}</div></aside>",
    ]
    docs_table = page_documents(make_pages(*docs), sizes=True)
    found = [r[0] for r in first(content.main_content(docs_table), "main_content")]
    assert found == [LONG.strip(), LONG + "!", None, None]
    text = len(LONG.strip())
    density = {(r.page_id, r.pos): (r.text_len, r.html_len) for r in content.content_density(docs_table).collect()}
    assert density[(1, 0)] == (text, len(f"<div>{LONG}</div>"))
    assert (3, 1) not in density
    # the first page: the outer div, the inner div and the section without its nav
    assert density[(0, 0)] == (text, len(f"<div><div>{LONG}<i></i><i></i></div></div>"))


def test_size_of_implied_end_tags(make_pages):
    found = content.content_density(page_documents(make_pages(f"<div><p>{LONG}<br><b>x</div>"), sizes=True)).first()
    assert found.html_len == len(f"<div><p>{LONG}<br/><b>x</b></p></div>")


def test_navigation_and_mutation(make_pages):
    docs = [
        "<nav><a>one</a><nav><a>two</a><a> </a></nav></nav><article><nav><a>in</a></nav><aside><h2>s1</h2><h4>s2</h4></aside></article><footer></footer>",
        f"<nav><a>gone</a></nav><div>{LONG}</div><footer>f <b>g</b></footer>",
    ]
    table = page_documents(make_pages(*docs))
    whole = first(navigation.page_navigation(table, mutated=False), "nav_links", "sidebar_sections", "footer")
    assert whole[0].nav_links == ["one", "two", "two", "in"]
    assert whole[0].sidebar_sections == ["s1", "s2"] and whole[0].footer is None
    assert whole[1].footer == "fg"
    left = first(navigation.page_navigation(table), "nav_links", "sidebar_sections", "footer")
    assert left[0].nav_links == ["one", "two", "two"] and left[0].sidebar_sections == ["s1", "s2"]
    assert tuple(left[1]) == (None, None, None)


def test_links(make_pages):
    docs = [
        "<a href='../x#f'>1</a><A HREF=?q&amp;r>2</A><a href='#'>3</a><a href=''>4</a><a href='javascript:v'>5</a><a name=n>6</a>"
        "<a href='//h/p'>7</a><article><nav><a href='/cut'>8</a></nav></article>",
    ]
    pages = make_pages(*docs, url="http://e.com/d/p")
    found = [r.dst_url for r in links.extract_links(pages).orderBy("pos").collect()]
    assert found == ["http://e.com/x", "http://e.com/d/p0?q&r", "http://h/p", "http://e.com/cut"]
    live = [r.dst_url for r in links.frontier_links(page_documents(pages)).orderBy("pos").collect()]
    assert live == found[:3]


def test_sample(make_pages):
    doc = (
        "<title>t</title><noscript><h1>no</h1><a href=n>n</a></noscript><svg><title>s</title></svg><div id=i class=c>x</div><div id=j>y</div>"
        "<main class='b  c'>z</main>" + "".join(f"<div class=d{i}></div>" for i in range(9)) + "<h2>" + "h" * 200 + "</h2>"
        + "".join(f"<a href=l{i}>{'' if i == 3 else 'L' * 60}</a>" for i in range(30))
    )
    table = page_documents(make_pages(doc))
    row = sampling.page_sample(table).first()
    assert row.structure_sample == ["main.b.c", "div#i", "div.d0", "div.d1", "div.d2", "div.d3"]
    assert len(row.links_sample) == 19 and row.links_sample[0].text == "L" * 50
    assert [(h.tag, len(h.text)) for h in row.headings] == [("h2", 100)]
    assert row.text_sample.startswith("t\nx\ny\nz\n") and row.title == "t"
    assert sampling.page_sample(table, compat=True).first().text_sample == "L" * 60


@pytest.mark.parametrize("doc", ["<div><p>a</div>b</p><nav>c<nav>d</nav>e</nav></div>", "<article><div>x</article>y</div><footer>z", "<nav>a</nav></nav>b"])
def test_region_depths_of_unbalanced_pages(make_pages, doc):
    """Depths of tokens agree with the extents of the elements."""
    pages = make_pages(doc)
    tags = ["div", "nav", "article", "footer"]
    deep = TK.with_texts(TK.with_regions(pages, tags)).where("text <> ''").orderBy("pos")
    sums = [(r.text, *[r[f"depth_{t}"] for t in tags]) for r in deep.collect()]
    row = page_documents(pages).first()
    tree = [(t.text, *[sum(e.tag == tag and e.pos < t.pos < e.end for e in row.elems) for tag in tags]) for t in row.texts]
    assert sums == tree


def test_filters_reach_the_scan(spark, make_pages, tmp_path):
    """One URL costs one page: conditions pass all extraction stages, and pages are still tokenised once."""
    from pyspark.sql import functions as F

    from pagemill.operators.document import page_documents
    from pagemill.operators.links import extract_links
    from pagemill.operators.records import content_records

    make_pages("<p>a</p>", "<a href='/x'>b</a>").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for found, column in ((page_documents(pages), "url"), (extract_links(pages), "src_url"), (content_records(pages), "url")):
        kept = found.where(F.col(column) == "http://www.example.com/dir/page1")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(url,http://www.example.com/dir/page1)" in plan
        assert kept.count() == 1
