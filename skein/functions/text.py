"""Column functions over text: tokens, links, citations, names, escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
TOKEN = f"{CJK}+|[A-Za-z0-9]+"
#: path.ext:line[-line]; the extension starts with a letter.
CITATION = r"([A-Za-z0-9_./\-]+\.[A-Za-z][A-Za-z0-9]*):([1-9][0-9]*)(?:-([1-9][0-9]*))?"
#: White space as both Java and Python have it, for splitting at.
SPACE = r"[ \t\n\x0B\f\r]+"
RESIDUE = r"\{\{\s*\w[\w\s]*\}\}"


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def tokens(c: Column) -> Column:
    """Keyword tokens in order: runs of ASCII letters and digits as they are, CJK runs as two-character windows (a single character gives none).

    Texts without CJK characters, nearly all, go by one pattern.
    """
    pair = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    mixed = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.when(is_cjk(t), pair(t)).otherwise(F.array(t))))
    return F.when(is_cjk(c), mixed).otherwise(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def cjk_tokens(*cs: Column) -> Column:
    """The CJK windows of several columns, joined by spaces."""
    return F.array_join(F.filter(F.flatten(F.array(*map(tokens, cs))), is_cjk), " ")


def normal_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def directory(path: Column) -> Column:
    """The text before the last slash; without one '.', for an empty path '<root>'."""
    return F.when(path == "", F.lit("<root>")).when(~path.contains("/"), F.lit(".")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def cluster_directory(path: Column) -> Column:
    """directory(), with a trailing /common folded into its parent."""
    return F.regexp_replace(directory(path), "/common$", "")


def top_domain(path: Column) -> Column:
    s = F.split(path, r"[/\\]")
    return F.when(F.size(s) == 1, F.lit("<root>")).otherwise(F.element_at(s, 1))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^\.[^.]*$") | ~name.contains("."), name).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def module_path(path: Column) -> Column:
    """Segments of a path, the last without its extension, joined by '::'."""
    return F.array_join(F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/"), "::")


def body_slice(source: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive; carriage returns are ignored."""
    return F.array_join(F.slice(F.split(F.replace(source, F.lit("\r")), "\n", -1), start, F.greatest(F.lit(0), end - start + 1)), "\n")


def span_hash(source: Column, start: Column, end: Column) -> Column:
    """First 8 hex digits of the SHA-256 of a span of lines with line ends made equal."""
    clean = F.regexp_replace(source, r"\r\n?", "\n")
    return F.substring(F.sha2(F.array_join(F.slice(F.split(clean, "\n", -1), start, F.greatest(F.lit(0), end - start + 1)), "\n"), 256), 1, 8)


def call_names(body: Column) -> Column:
    """Names that a parenthesis follows at once, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_]+)\("), F.lit(1)))


def links(markdown: Column) -> Column:
    """Targets of ](...), trimmed, without empty ones; an open one runs to the end."""
    return F.filter(F.transform(F.regexp_extract_all(markdown, F.lit(r"\]\(([^)]*)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def citations(text: Column) -> Column:
    """array<struct<path, start, end>> of path:line[-line] outside fences; end is not below start."""
    bare = F.regexp_replace(text, r"(?s)```.*?(```|$)", "")
    found = F.regexp_extract_all(bare, F.lit(CITATION), F.lit(0))

    def one(x: Column) -> Column:
        a = F.regexp_extract(x, CITATION, 2).cast("int")
        b = F.nullif(F.regexp_extract(x, CITATION, 3), F.lit("")).cast("int")
        return F.struct(F.regexp_extract(x, CITATION, 1).alias("path"), a.alias("start"), F.greatest(a, F.coalesce(b, a)).alias("end"))

    return F.filter(F.transform(found, one), lambda c: ~c["path"].startswith("/") & ~c["path"].contains("//"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (a["end"] >= b["start"])


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def rewrite_links(markdown: Column) -> Column:
    """The first .md of link targets that are no URLs becomes .html."""
    return F.regexp_replace(markdown, r"\]\((?![a-z]+://)([^)]*?)\.md", r"](\$1.html".replace("\\$", "$"))


def diagram_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "^_+|_+$", "")


def page_file(parts: Column, title: Column) -> Column:
    """Path segments joined by '_', or the title with / \\ : and spaces made '-'."""
    return F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise(F.translate(title, "/\\: ", "----"))


def json_slice(c: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), worked out once however often it is used; written out as an expression it would be worked out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signature_name(sig: Column) -> Column:
    """The entity name that a signature defines; null for impl blocks, opening braces, digits and single characters."""

    def of(s: Column) -> Column:
        head = F.regexp_extract(s, r"^(.*?)(\(|\bwhere\b|:|<|=|\{|;|$)", 1)
        name = F.regexp_extract(F.trim(head), r"([A-Za-z0-9_]+)\s*$", 1)
        return once(name, lambda n: F.when(~(s.rlike(r"^(impl\b|\{)") | (F.length(n) <= 1) | n.rlike("^[0-9]+$")), n))

    s = F.trim(F.regexp_replace(sig, r"^(\s*#\[[^\]]*\])+", ""))
    return once(F.regexp_replace(s, r'^((pub(\([^)]*\))?|async|unsafe|const|extern(\s+"[^"]*")?|export|public|static)\s+)+', ""), of)


def strip_modifiers(sig: Column) -> Column:
    return F.regexp_replace(sig, r'^((pub(\([^)]*\))?|async|unsafe|const|extern(\s+"[^"]*")?)\s+)+', "")


def normal_signature(sig: Column) -> Column:
    return F.regexp_replace(sig, r"\s", "")


def impl_target(name: Column) -> Column:
    return F.trim(F.regexp_extract(name, r"^(?:impl )?(.*?) for ", 1))


def keyword_hits(text: Column, keyword: Column) -> Column:
    """How often a keyword occurs in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, keyword))) / F.greatest(F.length(keyword), F.lit(1))).cast("long")


def rolling_hash(c: Column) -> Column:
    """The 31-polynomial hash of the code points modulo 2**32."""
    points = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("long"))
    return F.when(F.length(c) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(points, F.lit(0).cast("long"), lambda h, x: (h * 31 + x) % F.lit(4294967296)))


def clip(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)
