from pyspark.sql import functions as F

from pagemill.operators import models
from pagemill.operators.document import page_documents
from pagemill.operators.records import content_records

GOOD = '{"page_type": "product", "is_content_page": true, "content_value": "high", "has_item_list": false, "estimated_items": 3}'


def test_parse_analysis(spark):
    raws = [GOOD, f" ```json\n{GOOD}\n``` ", f"```\n{GOOD}\n```", "not json", "[1]", '{"is_content_page": false}', None]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    found = {r.id: r for r in models.parse_analysis(rows).collect()}
    assert [found[i].page_type for i in range(7)] == ["product"] * 3 + ["unknown", "unknown", None, "unknown"]
    assert found[1].estimated_items == 3 and found[3].content_value == "low" and found[3].parsed is False


def test_selectors_are_reused_from_the_first_readable_reply_on(spark):
    replies = [("a", [0], "broken"), ("a", [1], '{"x": ".x"}'), ("a", [2], '{"y": ".y"}'), ("product", [3], "{"), ("a", [4], "broken")]
    parsed = models.parse_selectors(spark.createDataFrame(replies, "page_type string, order_key array<int>, raw string"))
    found = {r.order_key[0]: r.selectors for r in models.selectors_for_pages(parsed).collect()}
    assert found[0] == models.BASIC_SELECTORS
    assert found[1] == found[2] == found[4] == {"x": ".x"}
    assert found[3] == models.BASIC_SELECTORS | models.FALLBACK_SELECTORS["product"]


DOC = (
    "<title>t</title><div class='card big' id=k><span class=by>me <i>too</i></span><ul><li data-x='1'>a</li><li data-x=2>b</li></ul></div>"
    "<article><p class=by>inner</p><div class=ad><em>cut</em></div></article>"
)


def test_apply_selectors(spark, make_pages):
    selectors = {
        "tag": "li", "class": ".by", "id": "#k .by i", "attr": "[data-x=2]", "has": "li[data-x]", "compound": "div.card.big#k span",
        "list": ".none, article p, #none", "deep": "article .by", "cut": "em", "missing": ".none", "bad": "li:first-child", "child": "ul > li",
    }
    pages = make_pages(DOC)
    per_page = spark.createDataFrame([(0, selectors)], "page_id long, selectors map<string,string>")
    found = models.apply_selectors(pages, per_page).first().extra
    assert found == {
        "tag": "a", "class": "metoo", "id": "too", "attr": "b", "has": "a", "compound": "metoo", "list": "inner", "deep": "inner", "bad": "a", "child": "a",
    }


def test_records(spark, make_pages):
    pages = make_pages(DOC, "", "<p>x</p>")
    analysis = spark.createDataFrame([("http://www.example.com/dir/page0", "product")], "url string, page_type string")
    per_page = spark.createDataFrame([(0, {"title": ".by", "price": ".by", "date": "i"})], "page_id long, selectors map<string,string>")
    found = {r.page_id: r for r in content_records(pages, analysis, per_page).collect()}
    assert set(found) == {0, 2}  # a page without content gives no record
    assert found[0].page_type == "product" and found[2].page_type == "article"
    assert found[0].title == "t" and found[0].extra == {"price": "metoo", "date": "too"}
    assert found[0].main_content == "inner" and found[2].extra is None
    assert content_records(pages, analysis, page_types=("product",)).count() == 1


def test_classifier_hook(make_pages):
    reply = F.concat(F.lit('{"page_type": "'), F.get_json_object("input", "$.title"), F.lit('"}'))
    found = models.classify(page_documents(make_pages(DOC)), lambda s: s.select("url", reply.alias("raw")))
    assert found.first().page_type == "t"


def test_replies_that_go_on_are_not_read(spark):
    good = '{"page_type": "x"}'
    bodies = [good, f"{good} trailing }}", good + good, f"{good}, {good}", f'{good}] [ {{"a": 1}}', f"{good}}} }}", "[1]", "{}"]
    rows = spark.createDataFrame([(i, b, "article") for i, b in enumerate(bodies)], "i int, raw string, page_type string")
    for parsed in (models.parse_analysis(rows.drop("page_type")), models.parse_selectors(rows)):
        assert [r.i for r in parsed.where("parsed").orderBy("i").collect()] == [0, 7]


def test_attribute_selectors(spark, make_pages):
    html = '<div data-x="a,b">comma</div><p title="one two">words</p><a href="/x.pdf" rel="no follow">file</a><i>last</i>'
    selectors = {
        "comma": '[data-x="a,b"]', "word": "[title~=two]", "start": 'a[href^="/x"]', "end": "[href$='.pdf']", "part": "[href*=x]",
        "miss": "[href^=x]", "two": '[title="one two"], i', "child": "div:hover", "none": "[data-x*='']",
    }
    pages = make_pages(html)
    table = spark.createDataFrame([(0, selectors)], "page_id bigint, selectors map<string,string>")
    found = models.apply_selectors(pages, table).first()
    assert found.extra == {"comma": "comma", "word": "words", "start": "file", "end": "file", "part": "file", "two": "words"}
    assert found.unsupported == ["child"]
