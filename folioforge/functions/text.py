"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


#: Fixed value: Unicode white space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim_space(x: C) -> Column:
    """Without Unicode white space at the ends; what lies between is not searched for it."""
    return F.btrim(_c(x), F.lit(SPACES))


def estimate_tokens(x: C) -> Column:
    """UTF-8 bytes by four, at least 1; nothing has 0."""
    n = F.octet_length(_c(x))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.floor(n / 4).cast("int"), F.lit(1))).cast("int")


def content_hash(markdown: C) -> Column:
    return F.sha2(_c(markdown), 256)


def normalize_markdown(x: C) -> Column:
    """LF line ends, no blanks at line ends, at most one empty line in a row, one newline at the end."""
    x = F.replace(_c(x), F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, r"(?d)(?m)[ \t]+$", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.concat(trim_space(x), F.lit("\n"))


def strip_self_links(x: C) -> Column:
    """On heading lines a link into the page itself becomes its text."""
    lines = F.split(_c(x), "\n", -1)
    return F.array_join(F.transform(lines, lambda line: F.when(line.rlike(r"^[ \t]*#"), F.regexp_replace(line, SELF_LINK, "$1")).otherwise(line)), "\n")


#: A link into the page itself, and what a body of markdown may start a line with.
SELF_LINK = r"\[([^\]]+)\]\(#[^)]*\)"
MARKDOWN_SIGNAL = r"(?d)(?m)^(#{1,6}\s|[-*]\s|\d+\.\s|```|>\s|\[.+\]\(.+\))"


def is_markdown(content_type: C, body: C) -> Column:
    """By content type; a body of another known type but HTML counts by its looks."""
    ct = F.lower(F.coalesce(_c(content_type), F.lit("")))
    return ct.contains("text/markdown") | ct.contains("text/x-markdown") | ((ct != "") & ~ct.contains("text/html") & _c(body).rlike(MARKDOWN_SIGNAL))


def markdown_title(x: C) -> Column:
    """The first line that starts with "# ", fences not minded; empty if there is none."""
    return F.coalesce(F.trim(F.regexp_extract(_c(x), r"(?d)(?m)^[\t\f\r ]*# (.*)$", 1)), F.lit(""))


def first_non_empty(*xs: C) -> Column:
    """The first that has more than white space, trimmed; empty if none."""
    return F.coalesce(*(F.nullif(trim_space(x), F.lit("")) for x in xs), F.lit(""))


def heading_level(line: C) -> Column:
    """Level of a heading line for the chunker, 0 if it is none."""
    line = _c(line)
    return F.when(line.rlike(r"^#{1,6}[ \t]") & (heading_text(line) != ""), F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]", 1))).otherwise(0).cast("int")


def heading_text(line: C) -> Column:
    """A heading line's text: no marks on either side, self links unwrapped; empty if there is none."""
    text = trim_space(F.regexp_extract(_c(line), r"(?s)^#{1,6}[ \t](.*?)#*\z", 1))
    return trim_space(F.regexp_replace(text, SELF_LINK, "$1"))


def outline_level(line: C) -> Column:
    """Level of a heading line for outlines, where only a blank may follow the marks."""
    line = _c(line)
    return F.when(line.rlike(r"^#{1,6} ") & (outline_text(line) != ""), F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))).otherwise(0).cast("int")


def outline_text(line: C) -> Column:
    text = F.regexp_extract(_c(line), r"(?s)^#{1,6} (.*)$", 1)
    return trim_space(F.regexp_replace(trim_space(text), r"#+$", ""))


def slugify(x: C) -> Column:
    """Lower-case letters and digits; runs of blanks, tabs, "-" and "_" are one "-"; all else goes."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{Nd} \t_-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \t_-]+", "-"), "^-+|-+$", "")


def source_slug(x: C) -> Column:
    """A directory name: a-z, 0-9 and "."; separators are one "-"; "source" if nothing is left."""
    kept = F.regexp_replace(F.lower(F.regexp_replace(_c(x), r"[^A-Za-z0-9.\-_ /]", "")), r"[\-_ /]+", "-")
    slug = F.regexp_replace(kept, "^-+|-+$", "")
    return F.when(slug.isin("", ".", ".."), F.lit("source")).otherwise(slug)


def normalize_path(x: C) -> Column:
    """A page's path inside its source with ``.md``; empty if it would leave the source.

    Segments are folded from the left over an array: "." and empty ones go, ".." takes its parent, and one without
    a parent stays, which rejects the path.
    """
    p = F.regexp_replace(F.regexp_replace(_c(x), "^/", ""), r"^\\", "")
    rooted = F.replace(p, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(rooted, "/", -1), lambda s: (s != "") & (s != "."))
    top = rooted.startswith("/")

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((s == "..") & top, done).otherwise(F.concat(done, F.array(s)))

    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    return let(clean, lambda c: F.when((F.size(c) == 0) | (F.get(c, 0) == ".."), F.lit("")).otherwise(F.concat(F.when(top, F.lit("/")).otherwise(F.lit("")), F.array_join(c, "/"), F.when(F.array_join(c, "/").endswith(".md"), F.lit("")).otherwise(F.lit(".md")))))


FRONT = r"(?s)\A---\n(.*?)\n---\n(.*)\z"


def split_front_matter(raw: C) -> tuple[Column, Column]:
    """(body, front matter as a map). Without a closed block the text stays as it is and the map is empty.

    Lines "key: value" are cut at the first colon; quotes at the edges go, escapes stay; the last of a key counts.
    """
    raw = _c(raw)
    has = raw.rlike(FRONT)
    body = F.when(has, F.regexp_replace(F.regexp_extract(raw, FRONT, 2), r"\A\n+", "")).otherwise(raw)
    lines = F.transform(F.split(F.regexp_extract(raw, FRONT, 1), "\n", -1), trim_space)
    lines = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & (F.instr(s, ":") > 1))
    pairs = F.transform(lines, lambda s: F.struct(trim_space(F.regexp_extract(s, r"(?s)^([^:]+):", 1)).alias("k"), F.regexp_replace(trim_space(F.regexp_extract(s, r"(?s)^[^:]+:(.*)$", 1)), r'^"+|"+$', "").alias("v")))
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1))), lambda y: y["k"] == x["k"])))
    return body, F.when(has, F.map_from_entries(last)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def front_matter(title: C, url: C, source: C, fetched_at: C, content_hash_: C) -> Column:
    """The block before a page's markdown; empty fields are left out."""

    def line(name: str, value: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', '\\\\"'), "\n", r"\\n")
        return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f'{name}: "'), quoted, F.lit('"\n')))

    at = F.date_format(_c(fetched_at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.lit("---\n"), line("title", _c(title)), line("url", _c(url)), line("source", _c(source)), line("fetched_at", at), line("content_hash", _c(content_hash_)), F.lit("---\n\n"))


def trim_snippet(x: C, most: int = 240) -> Column:
    """One line of at most ``most`` bytes; a longer one ends in "..." after whole characters."""
    flat = F.replace(_c(x), F.lit("\n"), F.lit(" "))
    return F.when(F.octet_length(flat) > most, F.concat(_byte_prefix(flat, most - 3), F.lit("..."))).otherwise(flat)


def _byte_prefix(s: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many bytes, by bisection on its length (unrolled)."""
    n: Column = F.lit(0)
    k = 1 << (most.bit_length() - 1)
    while k:
        n = let(n, lambda m, k=k: m + F.when((m + k <= F.length(s)) & (F.octet_length(F.substr(s, F.lit(1), m + k)) <= most), F.lit(k)).otherwise(F.lit(0)))
        k >>= 1
    return F.substr(s, F.lit(1), n)


def human_ago(then: C, as_of: C) -> Column:
    """Age as text, against a given time."""
    s = F.unix_timestamp(_c(as_of).cast("timestamp")) - F.unix_timestamp(_c(then).cast("timestamp"))
    n = lambda by: F.floor(s / by).cast("string")
    return F.when(_c(then).isNull(), F.lit("never")).when(s < 60, F.lit("just now")).when(s < 3600, F.concat(n(60), F.lit("m ago"))).when(s < 86400, F.concat(n(3600), F.lit("h ago"))).when(s < 14 * 86400, F.concat(n(86400), F.lit("d ago"))).otherwise(F.date_format(_c(then), "yyyy-MM-dd"))


_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def parse_refresh(x: C) -> Column:
    """Seconds of a refresh interval: durations such as 1h30m, or days; "", manual, never and anything else are 0."""
    t = F.lower(trim_space(_c(x)))
    one = r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)"
    whole = t.rlike(rf"^\+?(?:[0-9]*\.?[0-9]+(?:ns|us|µs|ms|s|m|h))+$")
    unit = F.create_map(*[F.lit(v) for kv in _UNITS.items() for v in kv])
    number, units = F.regexp_extract_all(t, F.lit(one), F.lit(1)), F.regexp_extract_all(t, F.lit(one), F.lit(2))
    seconds = F.aggregate(F.zip_with(number, units, lambda a, b: F.coalesce(a.try_cast("double") * F.element_at(unit, b), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    days = F.regexp_extract(t, r"^([0-9]+)d$", 1).try_cast("long") * 86400
    return F.coalesce(F.when(t.isin("", "manual", "never"), F.lit(0)).when(whole, F.floor(seconds).cast("long")).otherwise(days), F.lit(0)).cast("long")


#: Fixed value: how a repository is named.
REPOSITORY = r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+(@[A-Za-z0-9._/-]+)?(/[A-Za-z0-9._/-]+)?$"


def detect_kind(spec: C) -> Column:
    """Kind of a source by how it is named (without a look at the disk); empty if none fits."""
    s = _c(spec)
    local = s.rlike(r"^(\.{1,2}/|/|~)") | s.rlike(r"^.:[/\\]")
    web = s.rlike(r"^(?i)https?://")
    path = F.regexp_extract(s, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(local, "local").when(web & path.rlike(r"/llms(-full)?\.txt$"), "llms_txt").when(web, "website").when(s.rlike(REPOSITORY), "github").otherwise("")


def derive_name(spec: C, kind: C) -> Column:
    """A name for a source: owner/repo, the last part of a folder, or the host."""
    s, k = _c(spec), _c(kind)
    bare = F.regexp_replace(s, r"@[^/]*", "")
    repo = F.when(bare.contains("/"), F.concat_ws("/", F.get(F.split(bare, "/"), 0), F.get(F.split(bare, "/"), 1))).otherwise(bare)
    base = F.regexp_extract(F.regexp_replace(s, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    host = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(k == "local", F.when(base.isin("", ".", ".."), F.lit("local")).otherwise(base)).when(k == "github", repo).otherwise(F.when(host == "", s).otherwise(host))


def entry_error(name: C, kind: C, root: C) -> Column:
    """Why a catalog entry is not valid; null if it is."""
    blank = lambda x: trim_space(F.coalesce(_c(x), F.lit(""))) == ""
    return F.when(blank(name), "name required").when(blank(kind), "kind required").when(blank(root), "root required").when(~_c(kind).isin("website", "llms_txt", "github", "local"), "unknown kind")


def format_hit(rank: C, source: C, heading_path: C, url: C, snippet: C) -> Column:
    """A search result as the command line prints it."""
    where = F.when(F.size(_c(heading_path)) > 0, F.array_join(_c(heading_path), " › ")).otherwise(F.lit("(intro)"))
    return F.concat(_c(rank).cast("string"), F.lit(". "), _c(source), F.lit(" › "), where, F.lit("\n   "), _c(url), F.lit("\n   "), _c(snippet))
