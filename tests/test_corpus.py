import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import chunking, html, render

MD = "# Title\nlead text that is long enough here\n\n## A\nbody of a that is long enough\n```\n## not\n\nx\n```\n### deep\nmore\n## A\nbody two long enough indeed\n## tiny\nx\n### A\n"


def chunks(spark, md, **how):
    return chunking.chunk(spark.createDataFrame([(1, md)], "id int, markdown string"), **how).orderBy("ord").collect()


def test_split_at_h2(spark):
    got = chunks(spark, MD)
    assert [(r.heading_path, r.anchor, r.ord) for r in got] == [([], "", 0), (["A"], "a", 1), (["A"], "a-1", 2)]
    assert "## not" in got[1].body and "### deep" in got[1].body


def test_deeper_split_levels(spark):
    got = chunks(spark, MD, split_level=4, min_body=1)
    assert [(r.heading_path, r.anchor) for r in got] == [([], ""), (["A"], "a"), (["A", "deep"], "deep"), (["A"], "a-1"), (["tiny"], "tiny"), (["tiny", "A"], "a-2")]


def test_oversize_sections(spark):
    paras = [f"p{i} " + "w" * 300 for i in range(5)]
    got = chunks(spark, "## B\n" + "\n\n".join(paras), max_tokens=200)
    assert len(got) == 3 and all(r.heading_path == ["B"] and r.token_count <= 200 for r in got)
    fenced = "## C\n\n```\n" + "\n\n".join(paras) + "\n```\n\ntail " + "t" * 40
    assert [r.body.count("```") for r in chunks(spark, fenced, max_tokens=200)] == [2, 0] or chunks(spark, fenced, max_tokens=200)[0].body.count("```") % 2 == 0


def test_empty_and_null(spark):
    assert chunks(spark, "") == [] and chunks(spark, None) == [] and chunks(spark, "short") == []


def plain_chunks(md, cap):
    """The packing of paragraphs as a loop."""
    est = lambda s: max(len(s.encode()) // 4, 1) if s else 0
    body = md.strip()
    if len(body.encode()) < 24:
        return []
    if est(body) <= cap:
        return [body]
    out, cur, tok = [], "", 0
    for p in (x.strip() for x in body.split("\n\n")):
        if not p:
            continue
        if tok + est(p) > cap and cur:
            out.append(cur)
            cur, tok = "", 0
        cur = f"{cur}\n\n{p}" if cur else p
        tok += est(p)
    out.append(cur)
    return [x for x in out if len(x.encode()) >= 24] or [body]


def test_packing_random(spark):
    rng = random.Random(4)
    docs = ["\n\n".join("".join(rng.choice("abé ") for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(1, 15))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, markdown string")
    got = {}
    for r in chunking.chunk(df, max_tokens=40).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append(r.body)
    assert got == {i: c for i, d in enumerate(docs) if (c := plain_chunks(d, 40))}


def test_outline_offsets(spark):
    rows = chunking.flat_outline(spark.createDataFrame([(1, "é\n" + MD)], "id int, markdown string")).orderBy("pos").collect()
    raw = ("é\n" + MD).encode()
    assert [(r.level, r.text, r.anchor) for r in rows] == [(1, "Title", "title"), (2, "A", "a"), (3, "deep", "deep"), (2, "A", "a-1"), (2, "tiny", "tiny"), (3, "A", "a-2")]
    assert all(raw[r.offset :].startswith(b"#" * r.level + b" " + r.text.encode()) for r in rows)


def test_no_shuffle_and_no_python(spark):
    plan = chunking.chunk(spark.createDataFrame([(1, MD)], "id int, markdown string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


LONG = "content that goes on for long enough to be a page of its own, over eighty bytes of it. "
PAGES = [
    ("md", "text/markdown", "# T\n\nx  \r\n\r\n\r\n\r\ny", "ok"),
    ("signal", "application/octet-stream", "# T\n\nbody", "ok"),
    ("html", "text/html", f"<title> T </title><nav>menu</nav><main><h2><a href='#x'>Part</a></h2><p>{LONG}<b>bold<script>no()</script></main><footer>foot</footer>", "ok"),
    ("empty", "text/html", "<main></main>", "empty"),
    ("text", "text/plain", "short note", "empty"),
    ("null", "text/html", None, "empty"),
    ("h1", "text/html", f"<body><h1>Only h1</h1><p>{LONG}", "ok"),
]


@pytest.fixture(scope="module")
def rendered(spark):
    df = spark.createDataFrame([("s", f"https://h/{n}", n, ct, b, None) for n, ct, b, _ in PAGES], "source string, url string, path string, content_type string, body string, fetched_at timestamp")
    return df, {r.path: r for r in render.render(df).collect()}


def test_render(rendered):
    _, got = rendered
    assert {n: got[n].status for n, *_ in PAGES} == {n: s for n, _, _, s in PAGES}
    assert got["md"].markdown == "# T\n\nx\n\ny\n" and got["md"].title == "T" == got["signal"].title == got["html"].title
    page = got["html"].markdown
    assert page.startswith("## Part\n\ncontent that") and "**bold**" in page and "no()" not in page and "menu" not in page and "foot" not in page
    assert got["h1"].title == "Only h1" and len(got["h1"].content_hash) == 64


def test_escalation(spark, rendered):
    pages, got = rendered
    docs = render.render(pages)
    better = lambda p: p.where("path <> 'null'").withColumns({"body": F.lit(f"<main><p>{LONG}</p></main>"), "content_type": F.lit("text/html")})
    again = {r.path: r.status for r in render.escalated(pages, docs, better).collect()}
    assert again == {n: s for n, _, _, s in PAGES} | {"empty": "ok", "text": "ok"}


def test_html_elements():
    page = '<main><ul><li>a<li>b<ol start=3><li>c</ol></ul><pre><code class="x language-py">x = 1\n  y</code></pre><blockquote><p>q</blockquote><table><tr><td>1<td>2</table><hr><img src=i.png alt=I>a*b<br>c <a href="../u">l</a></main>'
    assert html.markdown(html.main_content(html.parse(page)), "https://h/d/e") == "- a\n- b\n  3. c\n\n```py\nx = 1\n  y\n```\n\n> q\n\n1 | 2\n\n* * *\n\n![I](https://h/d/i.png)a\\*b\nc [l](https://h/u)"


def test_html_never_fails():
    rng = random.Random(1)
    parts = ["<", ">", "<p", "</p>", "<div>", "</div>", "<!--", "-->", "<b a='", "\"", "x", "&amp;", "<script>", "</script>", "<li>", "<td>", "<title>", "</ul>", "/>", "<br/>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        root = html.stripped(html.parse(page))
        html.markdown(html.main_content(root), "https://h/")
        html.title(root)


def test_selectors():
    root = html.parse('<div class="a doc-content"><main role="main"><p id=x>t</p></main></div><nav><a href=/q>q</a><a>n</a></nav><div id="__next"><main><i>u</i></main></div>')
    assert [n.tag for n in html.select(root, ".doc-content")] == ["div"] and next(html.select(root, "#x")).text() == "t"
    assert len(list(html.select(root, "[role=main]"))) == 1 and [n.text() for n in html.select(root, "#__next main")] == ["u"]
    assert html.navigation('<aside><a href="/1">x</a></aside><div class="my-sidebar"><p><a href="/2">y</a></p></div>') == ["/1", "/2"]


def plain_sections(md, split_level, min_body):
    """Outline and sections as loops over lines."""
    import re

    slug = lambda t: re.sub(r"[ \t_-]+", "-", re.sub(r"[^\w \t_-]", "", t.lower())).strip("-") or "section"
    seen, inside, stack, out, cur, where = {}, False, [], [], [], ([], "")
    for line in md.split("\n"):
        if line.strip().startswith("```"):
            inside = not inside
        m = None if inside else re.match(r"^(#{1,6})[ \t](.*)$", line)
        level, text = (len(m[1]), m[2].rstrip("#").strip()) if m else (0, "")
        if text and level >= 2:
            n = seen.get(slug(text), 0)
            seen[slug(text)] = n + 1
            stack = [g for g in stack if g[0] < level] + [(level, text)]
            if level <= split_level:
                out.append((*where, "\n".join(cur).strip()))
                cur, where = [], ([t for _, t in stack] if split_level > 2 else [text], slug(text) + (f"-{n}" if n else ""))
        cur.append(line)
    out.append((*where, "\n".join(cur).strip()))
    return [(p, a, b) for p, a, b in out if len(b.encode()) >= min_body]


@pytest.mark.parametrize("split_level", [2, 3, 6])
def test_sections_against_loops(spark, split_level):
    """Random headings, fences and repeats, many of them: more than a scan takes at once."""
    rng = random.Random(split_level)
    line = lambda: rng.choice(["", "text of a line", "```", "#" * rng.randint(1, 7) + " " + rng.choice(["A", "B b", "a", "C"]), "##x", "## ", "\t```x"])
    docs = [(i, "\n".join(line() for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 200, 1500, 3000] + [30] * 40)]
    df = spark.createDataFrame(docs, "id int, markdown string")
    got = {r.id: [(s.heading_path, s.anchor, s.body) for s in r.s] for r in df.select("id", chunking.sections("markdown", split_level, 1).alias("s")).collect()}
    for i, md in docs:
        assert got[i] == plain_sections(md, split_level, 1)


def test_outline_offsets_of_many_headings(spark):
    md = "".join(f"# h{i % 7} é\n{'x' * (i % 5)}\n" for i in range(1000))
    got = spark.createDataFrame([(md,)], "markdown string").select(chunking.outline("markdown").alias("o")).first().o
    raw, at = md.encode(), []
    for i, b in enumerate(raw):
        if b == 35 and (i == 0 or raw[i - 1] == 10):
            at.append(i)
    assert [h.offset for h in got] == at and [h.anchor for h in got] == [f"h{i % 7}-é" + (f"-{i // 7}" if i // 7 else "") for i in range(1000)]


def test_time_grows_with_length(spark):
    """32,000 headings in one document, in seconds; fences and fenced paragraphs too."""
    import time

    chunking.chunk(spark.createDataFrame([(1, "## a\ntext that is long enough\n")], "id int, markdown string")).count()
    for md in ("".join(f"## Heading {i % 1000}\n" + "body of this one is long enough\n" for i in range(32_000)), "## A\n" + "```\nx y z\n\n```\nsome words of text\n\n" * 16_000, "```\n" + "line of a fence\n\n" * 32_000):
        df = spark.createDataFrame([(1, md)], "id int, markdown string")
        began = time.time()
        n = chunking.chunk(df).agg(F.count("*"), F.max("anchor")).first()[0]
        flat = chunking.flat_outline(df).count()
        assert time.time() - began < 20 and (n, flat)[0] > 0


def test_titles_resolve_entities():
    """As the text of a parsed tree; the SQL of html_title, render_title and render_html leaves &quot; in titles as it is."""
    page = "<html><head><title> a &quot;b&quot; &amp; c &quo</title></head><body></body></html>"
    assert html.title(html.parse(page)) == 'a "b" & c &quo'
