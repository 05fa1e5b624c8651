import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import urls as U
from folioforge.functions.porter import stem
from folioforge.functions.tokens import tokenize, tokens


def one(spark, fn, *xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


CASES = [
    (T.estimate_tokens, {"": 0, "a": 1, "abcdefgh": 2, "é" * 10: 5}),
    (T.normalize_markdown, {"a  \r\nb\t\n\n\n\nc": "a\nb\n\nc\n", "\n x \n": "x\n", "a\rb": "a\rb\n"}),
    (T.strip_self_links, {"## [A b](#a-b)": "## A b", "[x](#y)": "[x](#y)", "# [q](http://z)": "# [q](http://z)"}),
    (T.heading_level, {"# a": 1, "###### b": 6, "####### c": 0, "#no": 0, "#": 0, "## ": 0, "##\tx": 2, " # x": 0}),
    (T.heading_text, {"## Foo ##": "Foo", "### [T](#t)": "T", "# [e](http://x)": "[e](http://x)"}),
    (T.outline_level, {"# a": 1, "##\tx": 0, "### ###": 0}),
    (T.slugify, {"Hello, World!": "hello-world", "  a_b-c  ": "a-b-c", "ÜBER straße 9": "über-straße-9", "--": "", "C++ & Rust": "c-rust"}),
    (T.source_slug, {"Owner/Repo": "owner-repo", "a  b__c": "a-b-c", "..": "source", "éé": "source", "x.y": "x.y"}),
    (T.normalize_path, {"a/b": "a/b.md", "/a//b/../c.md": "a/c.md", "..": "", "../x": "", "\\w\\z": "w/z.md", "": "", "/..": "", "a/../..": ""}),
    (T.trim_snippet, {"a\nb": "a b", "x" * 240: "x" * 240, "x" * 241: "x" * 237 + "...", "é" * 300: "é" * 118 + "..."}),
    (T.parse_refresh, {"": 0, "manual": 0, "never": 0, "7d": 604800, "30d": 2592000, "1h": 3600, "45m": 2700, "garbage": 0, "1h30m": 5400}),
    (T.detect_kind, {"./x": "local", "/a": "local", "C:\\x": "local", "https://a.b/llms.txt": "llms_txt", "https://a.b/docs": "website", "o/r": "github", "o/r@v1/docs": "github", "foo": ""}),
    (T.markdown_title, {"x\n# Hi there \n# b": "Hi there", "none": ""}),
    (U.site_path, {"https://h/": "index", "https://h": "index", "https://h/a/": "a/index", "https://h/a/b.html": "a/b", "https://h/a.htm?x#y": "a"}),
    (U.index_path, {"https://h.x/": "h.x", "https://h/a/b.html": "a/b", "https://h/a.md": "a", "https://h/a/": "a/index"}),
    (U.scope_path, {"https://h/": "/", "https://h/docs/": "/docs/", "https://h/docs/intro": "/docs/", "https://h/foo/bar.html": "/foo/", "https://h/single": "/single", "https://h/index.html": "/"}),
    (U.content_type_of, {"a.MD": "text/markdown; charset=utf-8", "a.txt": "text/plain; charset=utf-8", "a.png": "application/octet-stream"}),
    (U.forced_markdown, {"text/markdown": "text/markdown", "text/html": "text/markdown; charset=utf-8"}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_table(spark, fn, cases):
    assert dict(zip(cases, one(spark, fn, *cases), strict=True)) == cases


def test_null_texts_do_not_fail(spark):
    for fn, _ in CASES:
        one(spark, fn, None, "x")


def test_resolution(spark):
    base = F.lit("https://h/a/b?q")
    cases = {"c": "https://h/a/c", "../c": "https://h/c", "/d": "https://h/d", "//k/e": "https://k/e", "?z": "https://h/a/b?z", "#f": "https://h/a/b?q#f", "https://m/x": "https://m/x", "./": "https://h/a/", "mailto:a@b": "mailto:a@b", "..": "https://h/", "../../../x": "https://h/x"}
    assert dict(zip(cases, one(spark, lambda x: U.resolved(base, x), *cases), strict=True)) == cases


def test_front_matter_round_trip(spark):
    df = spark.createDataFrame([("T", "https://u", "s", datetime(2024, 1, 2, 3, 4, 5), "abc")], "title string, url string, source string, at timestamp, hash string")
    raw = df.select(F.concat(T.front_matter("title", "url", "source", "at", "hash"), F.lit("# T\n")).alias("raw"))
    body, fields = T.split_front_matter("raw")
    row = raw.select(body.alias("body"), fields.alias("fields")).first()
    assert row.body == "# T\n" and row.fields == {"title": "T", "url": "https://u", "source": "s", "fetched_at": "2024-01-02T03:04:05Z", "content_hash": "abc"}
    assert one(spark, lambda x: T.split_front_matter(x)[0], "no", "---\nopen\n") == ["no", "---\nopen\n"]
    assert one(spark, lambda x: T.split_front_matter(x)[1], "no", "---\n# c\n\nk: a\nk: b\n---\n") == [{}, {"k": "b"}]


def test_human_ago(spark):
    now = datetime(2024, 2, 3)
    ages = {timedelta(seconds=30): "just now", timedelta(minutes=5): "5m ago", timedelta(hours=3): "3h ago", timedelta(days=2): "2d ago", timedelta(days=20): "2024-01-14"}
    df = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)], "i int, t timestamp")
    assert [r.y for r in df.select("i", T.human_ago("t", F.lit(now)).alias("y")).orderBy("i").collect()] == list(ages.values())


def test_derive_name_and_entry(spark):
    df = spark.createDataFrame([("/a/b/docs", "local"), ("/", "local"), ("o/r@v/1/sub", "github"), ("o/r/sub", "github"), ("https://u@h.x:80/p", "website")], "s string, k string")
    assert [r[0] for r in df.select(T.derive_name("s", "k")).collect()] == ["docs", "local", "o/r", "o/r", "h.x"]


def test_links(spark):
    body = '- [I](https://e.x/intro): x\n[A](/advanced "t") [m](mailto:a) [s](#s) [D](https://e.x/intro#q)'
    assert one(spark, lambda x: U.links_of_markdown(x, F.lit("https://e.x/llms.txt")), body) == [["https://e.x/intro", "https://e.x/advanced"]]
    assert one(spark, U.sitemap_locs, "<urlset><loc> a </loc><LOC>b</LOC>") == [["a", "b"]]
    assert one(spark, U.robots_sitemaps, "User-agent: *\nSitemap: https://a/s.xml\nsitemap:  b \n") == [["https://a/s.xml", "b"]]
    assert one(spark, lambda x: U.expanded(x, {"A": "1"}), "x${A}y", "${B}z", "${open") == ["x1y", "z", "${open"]


def test_porter():
    pairs = {"generates": "gener", "running": "run", "straße": "straß", "caresses": "caress", "ponies": "poni", "relational": "relat", "sky": "sky", "happy": "happi", "controlling": "control", "thes": "the", "as": "as", "hopping": "hop", "filing": "file", "adoption": "adopt"}
    assert {w: stem(w) for w in pairs} == pairs


def test_tokens():
    assert tokenize("Café don't x² Ångström straße a_b ộ") == ["cafe", "don", "t", "x²", "angstrom", "straße", "a", "b", "ộ"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=12))
def test_stem_never_fails(word):
    for t in tokenize(word):
        assert isinstance(stem(t), str)


def test_stems_of_many_words():
    """Kinds of letters as letter by letter, y by what is before it."""
    from folioforge.functions import porter

    rng = random.Random(4)
    for _ in range(5000):
        w = "".join(rng.choice("aeybcdst") for _ in range(rng.randint(1, 9)))
        slow = []
        for i, c in enumerate(w):
            slow.append("c" if c not in "aeiou" and not (c == "y" and i > 0 and slow[i - 1] == "c") else "v")
        assert porter._kinds(w) == "".join(slow)


def test_tokens_with_and_without_marks(spark):
    rows = ["Plain ASCII, 1 2", "Caf\u00e9 D\u00e9j\u00e0", "cafe\u0301 \u0301 x", "\u0301", "", None, "Stra\u00dfe \u1ec7 e\u0302\u0323"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.x for r in df.select(tokens("t").alias("x")).collect()] == [tokenize(r or "") for r in rows]
