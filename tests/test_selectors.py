"""CSS selectors against a plain recursive matcher over random trees."""

import random

import pytest

from pagemill.functions import layout as L
from pagemill.functions import selectors as S
from pagemill.operators.models import apply_selectors

TAGS = ["div", "p", "ul", "li", "a"]
CLASSES = ["x", "y", "big-one"]


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        if parent:
            parent.children.append(self)


def random_tree(rng):
    top, nodes = Node("", {}, None), []

    def grow(parent, depth):
        for _ in range(rng.randint(0, 4) if depth else rng.randint(1, 4)):
            attrs = {}
            if rng.random() < 0.5:
                attrs["class"] = " ".join(rng.sample(CLASSES, rng.randint(1, 2)))
            if rng.random() < 0.2:
                attrs["id"] = rng.choice(["k", "m"])
            if rng.random() < 0.3:
                attrs["data-v"] = rng.choice(["one two", "en-US", "", "One"])
            node = Node(rng.choice(TAGS), attrs, parent)
            nodes.append(node)
            if depth < 5:
                grow(node, depth + 1)

    grow(top, 0)
    return nodes


def random_compound(rng, depth=0):
    """(text, test of a node) made together, so that the reader of selectors is tested as well."""
    parts, tests = [], []
    if rng.random() < 0.6:
        tag = rng.choice(TAGS)
        parts.append(rng.choice([tag, tag.upper()]))
        tests.append(lambda n: n.tag == tag)
    elif rng.random() < 0.3:
        parts.append("*")
    kinds = ["class", "id", "attr", "place", "not"]
    for kind in rng.sample(kinds, rng.choice([0, 1, 1, 2]) if parts else rng.choice([1, 2])):
        if kind == "class":
            c = rng.choice(CLASSES)
            parts.append("." + c)
            tests.append(lambda n, c=c: c in n.attrs.get("class", "").split())
        elif kind == "id":
            parts.append("#k")
            tests.append(lambda n: n.attrs.get("id") == "k")
        elif kind == "attr":
            text, test = rng.choice([
                ("[data-v]", lambda v: v is not None), ('[data-v="one two"]', lambda v: v == "one two"), ("[ data-v ~= 'two' ]", lambda v: v is not None and "two" in v.split()),
                ("[data-v|=en]", lambda v: v is not None and (v == "en" or v.startswith("en-"))), ("[data-v^=on]", lambda v: v is not None and v.startswith("on")),
                ("[DATA-V=ONE i]", lambda v: v is not None and v.lower() == "one"), ("[data-v$='']", lambda v: False), ("[data-v!='']", lambda v: v != ""),
            ])
            parts.append(text)
            tests.append(lambda n, test=test: test(n.attrs.get("data-v")))
        elif kind == "place":
            of_type, from_end = rng.random() < 0.5, rng.random() < 0.5
            a, b = rng.choice([(0, 1), (0, 2), (2, 1), (2, 0), (-1, 2), (1, 2), (3, -1)])
            formula = {(2, 1): "odd", (2, 0): "even", (0, 1): "1", (0, 2): "+2"}.get((a, b), f"{'-' if a == -1 else '' if a == 1 else a}n{b:+d}")
            parts.append(f":nth-{'last-' if from_end else ''}{'of-type' if of_type else 'child'}({formula})")

            def place(n, of_type=of_type, from_end=from_end, a=a, b=b):
                row = [c for c in n.parent.children if not of_type or c.tag == n.tag]
                at = (row[::-1] if from_end else row).index(n) + 1
                return any(a * k + b == at for k in range(100))

            tests.append(place)
        elif depth == 0:
            text, test = random_compound(rng, 1)
            parts.append(f":not( {text} )")
            tests.append(lambda n, test=test: not test(n))
    if not parts:
        return "*", lambda n: True
    return "".join(parts), lambda n: all(t(n) for t in tests)


def random_selector(rng):
    alternatives = []
    for _ in range(rng.choice([1, 1, 2])):
        text, test = random_compound(rng)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            sign = rng.choice([" ", ">", "+", "~"])
            more, last = random_compound(rng)
            text += (sign if sign == " " else rng.choice([sign, f" {sign} "])) + more

            def both(n, before=test, last=last, sign=sign):
                if not last(n):
                    return False
                row = n.parent.children
                ups = []
                while n.parent and n.parent.parent:
                    ups.append(n.parent)
                    n = n.parent
                return {">": lambda: any(before(u) for u in ups[:1]), " ": lambda: any(before(u) for u in ups)}[sign]()

            def beside(n, before=test, last=last, sign=sign):
                row = n.parent.children
                earlier = row[: row.index(n)]
                return last(n) and any(before(s) for s in (earlier[-1:] if sign == "+" else earlier))

            test = both if sign in " >" else beside
        alternatives.append((text, test))
    return ", ".join(t for t, _ in alternatives), lambda n: any(t(n) for _, t in alternatives)


def elements(nodes):
    place = {id(n): i for i, n in enumerate(nodes)}
    return S.Elements([n.tag for n in nodes], [place.get(id(n.parent), -1) for n in nodes], lambda i: nodes[i].attrs)


@pytest.mark.parametrize("seed", range(6))
def test_random_selectors(seed):
    rng = random.Random(seed)
    hits = 0
    for _ in range(40):
        nodes = random_tree(rng)
        page = elements(nodes)
        for _ in range(25):
            text, test = random_selector(rng)
            selector = S.compiled(text)
            assert selector is not None, text
            found = selector.matches(page)
            assert found == [test(n) for n in nodes], text
            hits += sum(found)
    assert hits > 1000


def test_what_is_not_built():
    for text in ("", "a:hover", "a::before", "a >", "> a", "a,,b", "a[", "a:nth-child(x)", "p:has(a)", "a b)", "3a", "div:not(p"):
        assert S.compiled(text) is None, text
    for text in ("a>b+c~d", "a:is(b, c > d):where(e)", "é.ü", "a[x='])>']", "li:nth-child( 2n + 1 )", "#4a", "a:only-child , b:only-of-type", "--x"):
        assert S.compiled(text) is not None, text


def test_time_is_linear():
    """A deep chain and a wide row of 100,000 elements each, with steps at any distance."""
    n = 100_000
    deep = S.Elements(["div"] * n, list(range(-1, n - 1)), lambda i: {})
    wide = S.Elements(["p"] * n, [-1] * n, lambda i: {})
    assert sum(S.compiled("div div div > div").matches(deep)) == n - 3
    assert sum(S.compiled("p ~ p ~ p + p:nth-last-child(n+2)").matches(wide)) == n - 4


def test_page_tree():
    page = L.Page("".join([L.CODES[1], L.CODES[1], L.END_TAG, "r", L.CODES[64 + 1], L.END_TAG, L.TEXT]), "ul li li script br ul", None, "3")
    assert page.tags == ["ul", "li", "script", "br"] and page.parents == [-1, 0, 0, 0]


DOC = (
    "<title>t</title><nav><a href=/n>nav</a></nav><main><h2>one</h2><nav><a>cut</a></nav><ul><li>a</li><script>x()</script><li class='on'>b<br>bb</li><li>c</li></ul>"
    "<p>p1<p>p2</p></p><h2>two</h2></main><footer><a href=/f>foot</a></footer>"
)


def test_combinators_on_pages(spark, make_pages):
    selectors = {
        "child": "main > h2", "second": "h2:nth-of-type(2)", "after": "li.on + li", "later": "h2 ~ p", "first": "li:first-child", "last": "ul > :last-child",
        "nested": "p > p", "no script": "ul > li:nth-child(2)", "nav": "nav a", "gone": "main nav a", "not": "a:not([href='/n'])", "bad": "a:visited", "null": None, "top": "title:first-child",
    }
    pages = make_pages(DOC, "<p>other</p>")
    table = spark.createDataFrame([(0, selectors)], "page_id bigint, selectors map<string,string>")
    row = apply_selectors(pages, table).collect()
    assert len(row) == 1 and row[0].unsupported == ["bad", "null"]
    # the script inside the main element is gone, so the items are neighbours; li 1 is "a", li 2 is "b"
    assert row[0].extra == {
        "child": "one", "second": "two", "after": "c", "later": "p1p2", "first": "a", "last": "c", "nested": "p2", "no script": "bbb",
        "nav": "nav", "not": "foot", "top": "t",
    }


def test_one_pass_over_the_pages(spark, make_pages, tmp_path):
    """Records with selectors tokenise each page once, and only the raw pages take part in the join."""
    from pagemill.operators.records import content_records

    make_pages(DOC).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    table = spark.createDataFrame([(0, {"x": "ul > li"})], "page_id bigint, selectors map<string,string>")
    found = content_records(pages, selectors=table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("selected_layout") <= 2 and "Exchange hashpartitioning" not in plan
    assert found.first().extra == {"x": "a"}
