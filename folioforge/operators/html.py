"""A small forgiving HTML tree, selection by simple selectors, and markdown from it."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin

import regex

_TOKEN = regex.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>")
_ATTR = regex.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element of the key ends open ones of the value, up to the nearest element of the third kind.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "body": (("head",), ("html",)),
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"} | {"li", "dt", "dd"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """Itself and all elements below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)


def parse(page: str) -> Node:
    """A tree of a page. Unclosed elements end with what holds them; stray end tags are skipped."""
    root = top = Node("#document")
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            top.children.append(_html.unescape(page[at:]))
            break
        if m.start() > at:
            top.children.append(_html.unescape(page[at : m.start()]))
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = stop + 3 if stop >= 0 else end
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                top = node.parent
            continue
        if tag in ENDS_P:  # an open paragraph ends before a block
            node = top
            while node.parent is not None and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in ENDS:
            ended, within = ENDS[tag]
            node, cut = top, None
            while node.parent is not None and node.tag not in within:
                if node.tag in ended:
                    cut = node
                node = node.parent
            if cut is not None:
                top = cut.parent
        attrs = {a[1].lower(): _html.unescape(next((x for x in a.groups()[1:] if x is not None), "")) for a in _ATTR.finditer(m[3])} if m[3].strip(" /\n\t") else {}
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in RAW:
            stop = regex.compile(rf"</{regex.escape(tag)}\s*>", regex.I).search(page, at)
            body = page[at : stop.start()] if stop else page[at:]
            node.children.append(body if tag in ("script", "style", "noscript", "iframe") else _html.unescape(body))
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
    return root


@lru_cache(maxsize=256)
def _parts(selector: str) -> tuple[tuple[str, str, str], ...]:
    """(attribute or "" for the tag, how, value) of each part."""
    out = []
    for part in regex.findall(r"[.#]?[\w-]+|\[[^\]]+\]", selector):
        if part[0] == ".":
            out.append(("class", "~", part[1:]))
        elif part[0] == "#":
            out.append(("id", "=", part[1:]))
        elif part[0] == "[":
            name, op, value = regex.fullmatch(r"\[([\w-]+)(?:(\*?=)\"?([^\"\]]*)\"?)?\]", part).groups()
            out.append((name, op or "", value or ""))
        else:
            out.append(("", "=", part))
    return tuple(out)


def matches(node: Node, selector: str) -> bool:
    """tag, .class, #id, [attr], [attr=value], [attr*="value"], or several of them in a row."""
    for name, op, value in _parts(selector):
        if not name:
            if node.tag != value:
                return False
            continue
        found = node.attrs.get(name)
        if found is None or not (op == "" or (found == value if op == "=" else value in found if op == "*=" else value in found.split())):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements that match, parts separated by blanks being ancestors."""
    *above, last = selector.split()
    for node in root.walk():
        if node.parent is not None and matches(node, last):
            up, need = node.parent, list(above)
            while need and up is not None:
                if up.parent is not None and matches(up, need[-1]):
                    need.pop()
                up = up.parent
            if not need:
                yield node


#: What is never shown, and where a page's content is looked for, in order.
REMOVED = ("script", "style", "noscript", "iframe", "link[rel=stylesheet]", "svg", "[aria-hidden=true]")
MAIN = ("main", "[role=main]", "article", ".markdown-body", ".prose", ".docs-content", ".doc-content", ".content", "#content", "#main-content", "#__next main")
#: Fixed value: bytes of text under which a page is empty.
EMPTY = 80


def stripped(root: Node) -> Node:
    """The tree without what is never shown."""
    gone = [n for n in root.walk() if n.parent is not None and any(matches(n, s) for s in REMOVED)]
    for n in gone:
        n.parent.children.remove(n)
    return root


def main_content(root: Node) -> Node:
    for selector in MAIN:
        node = next(select(root, selector), None)
        if node is not None and len(node.text().strip().encode()) >= EMPTY:
            return node
    return next(select(root, "body"), root)


def title(root: Node) -> str:
    for tag in ("title", "h1"):
        node = next(select(root, tag), None)
        if node is not None and node.text().strip():
            return node.text().strip()
    return ""


_SPACE = regex.compile(r"\s+")
_BREAKS = regex.compile(r" *\n *")
_MARKS = regex.compile(r"([\\`*_\[\]])")


def markdown(node: Node, base: str = "") -> str:
    """Markdown of an element: ATX headings, emphasis, links, images, lists, quotes, code, rules, rows of tables."""
    return "\n\n".join(b for b in _blocks(node, base) if b.strip())


def _blocks(node: Node, base: str) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = "\n".join(x.strip() for x in _BREAKS.sub("\n", "".join(line)).strip().split("\n"))
        if text.strip():
            out.append(text)
        line.clear()

    for child in node.children:
        if isinstance(child, str):
            line.append(_MARKS.sub(r"\\\1", _SPACE.sub(" ", child)))
        elif child.tag not in BLOCK and not _has_block(child):
            line.append(_inline(child, base))
        else:
            flush()
            out += _block(child, base)
    flush()
    return out


def _has_block(node: Node) -> bool:
    return any(n.tag in BLOCK for n in node.walk() if n is not node)


def _block(node: Node, base: str) -> list[str]:
    tag = node.tag
    if tag in ("head", "title"):
        return []
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        text = " ".join(" ".join(_blocks(node, base)).split())
        return [f"{'#' * int(tag[1])} {text}"] if text else []
    if tag == "hr":
        return ["* * *"]
    if tag == "pre":
        code = next((c for c in node.children if not isinstance(c, str) and c.tag == "code"), node)
        lang = next((c.removeprefix("language-") for c in code.attrs.get("class", "").split() if c.startswith("language-")), "")
        return [f"```{lang}\n{node.text().strip(chr(10))}\n```"]
    if tag in ("ul", "ol"):
        items, n = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
        for child in node.children:
            if isinstance(child, str):
                continue
            body = "\n".join(b for b in _blocks(child, base) if b.strip())
            if body:
                mark = "- " if tag == "ul" else f"{n}. "
                items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
                n += 1
        return ["\n".join(items)] if items else []
    if tag == "blockquote":
        body = "\n\n".join(_blocks(node, base))
        return ["\n".join(f"> {x}".rstrip() for x in body.split("\n"))] if body else []
    if tag == "tr":
        cells = [" ".join(" ".join(_blocks(c, base)).split()) for c in node.children if not isinstance(c, str)]
        return [" | ".join(cells)] if any(cells) else []
    return _blocks(node, base)


def _inline(node: Node, base: str) -> str:
    tag = node.tag
    if tag == "br":
        return "\n"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({_absolute(node.attrs['src'], base)})" if node.attrs.get("src") else ""
    if tag == "code":
        text = node.text()
        return f"`{text}`" if text.strip() else ""
    inner = "".join(_MARKS.sub(r"\\\1", _SPACE.sub(" ", c)) if isinstance(c, str) else _inline(c, base) for c in node.children)
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*"}.get(tag)
    text = inner.strip()
    if mark and text:
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return lead + "\n".join(f"{mark}{x.strip()}{mark}" if x.strip() else x for x in text.split("\n")) + tail
    if tag == "a" and node.attrs.get("href"):
        return f"[{' '.join(text.split())}]({_absolute(node.attrs['href'], base)})" if text else ""
    return inner


def _absolute(url: str, base: str) -> str:
    """Links into the page itself stay as they are."""
    if not base or url.startswith("#"):
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


#: Fixed value: where links to other pages of a site are looked for.
NAVIGATION = ("nav a[href]", "aside a[href]", '[class*="sidebar"] a[href]', '[class*="Sidebar"] a[href]', '[class*="navigation"] a[href]', '[class*="toc"] a[href]', '[class*="menu"] a[href]', '[role="navigation"] a[href]')


def navigation(page: str) -> list[str]:
    """href values of navigation links, by selector, then by place; each element once a selector."""
    root = parse(page)
    return [n.attrs["href"] for s in NAVIGATION for n in select(root, s)]
