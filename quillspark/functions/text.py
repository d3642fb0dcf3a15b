"""Cleaning, tokens and windows of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .entities import unescape

#: How a page's character references are decoded.
Decoder = Callable[[Column], Column]

WORD = "[a-záéíóúüñàâçèêëîïôùûœæ]+"
TOKEN = r"[\p{L}\p{N}_]+"
MARK = "\x01"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def pieces(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def chunks(c: Column) -> Column:
    """Runs without white space."""
    return pieces(c, r"\S+")


def words(c: Column) -> Column:
    return pieces(F.lower(c), WORD)


def token_set(c: Column) -> Column:
    """Distinct words of any script, in lower case, sorted."""
    return F.sort_array(F.array_distinct(pieces(F.lower(c), TOKEN)))


def sentences(c: Column) -> Column:
    """Cut after sentence ends that white space follows; a text without any is one sentence."""
    cut = F.split(F.regexp_replace(strip(c), r"([.!?…])\s+", "$1" + MARK), MARK)
    kept = F.filter(cut, lambda s: F.length(strip(s)) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p != "")


def occurrences(c: Column, *marks: str) -> Column:
    """How often any of the marks stands in the text."""
    total = F.lit(0)
    for m in marks:
        total = total + (F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)
    return total.cast("long")


def _body(c: Column) -> Column:
    inner = F.regexp_extract(c, r"(?s)<body[^>]*>(.*)</body>", 1)
    return F.when(c.rlike(r"(?s)<body[^>]*>.*</body>"), inner)


def _trim_lines(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f]*\n[ \t\r\f]*", "\n"), r"^[ \t\r\f]+|[ \t\r\f]+$", ""), r"\n{3,}", "\n\n"))


def html_to_text(c: Column, decode: Decoder = unescape) -> Column:
    """Prose of a chapter page: headings, navigation, star lines and editors' notes go, blocks become paragraphs."""
    for pattern in L.CHAPTER_NOISE:
        c = F.regexp_replace(c, pattern, "")
    c = F.coalesce(_body(c), c)
    c = F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), r"</(?:p|div|blockquote)>", "\n\n")
    return _trim_lines(decode(F.regexp_replace(c, r"<[^>]+>", "")))


def html_main_text(c: Column, decode: Decoder = unescape) -> Column:
    """Text of a page without scripts, styles, navigation, headers, footers and comments; tags part lines."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "header", "footer"):
        c = F.regexp_replace(c, rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    c = decode(F.regexp_replace(c, r"<[^>]+>", "\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n\s*\n", "\n\n"), " +", " "))


def html_epigraph(c: Column, decode: Decoder = unescape) -> Column:
    inner = F.regexp_replace(F.coalesce(_body(c), F.lit("")), r"(?s)<h2[^>]*>.*?</h2>", "")
    inner = decode(F.regexp_replace(F.regexp_replace(inner, r"<br\s*/?>", "\n"), r"<[^>]+>", ""))
    return strip(F.regexp_replace(F.regexp_replace(inner, r"[ \t]+", " "), r"\n[ \t]+", "\n"))


def extract_sequence(c: Column) -> Column:
    """Whole numbers, in order, of lines that hold three or more."""
    plain = unescape(F.regexp_replace(F.coalesce(_body(c), c), r"<[^>]+>", " "))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda s: pieces(s, "[0-9]+")), lambda a: F.size(a) >= 3)
    return F.transform(F.flatten(lines), lambda s: s.cast("long"))


def section_of(n: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Name of the inclusive range that holds n; null if none does."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(ranges):
        out = F.when(n.between(low, high), name).otherwise(out)
    return out


def editorial_kind(line: Column) -> Column:
    """The first kind of editorial apparatus that a stripped line is, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(L.EDITORIAL.items()):
        hit = line.rlike(pattern)
        if kind == "Publisher blurb":
            hit = hit & (F.length(line) < L.BLURB_LENGTH)
        if kind == "Running header":
            hit = hit & (F.length(line) < L.HEADER_LENGTH)
        out = F.when(hit, kind).otherwise(out)
    return out


def strip_editorial(c: Column) -> Column:
    """Lines that aren't editorial; an empty first or last line goes too."""
    lines = F.split(c, "\n")
    marked = F.transform(lines, lambda s, i: F.struct(s.alias("s"), ((i == 0) | (i == F.size(lines) - 1)).alias("edge")))
    kept = F.filter(marked, lambda x: ~(x["edge"] & (strip(x["s"]) == "")) & editorial_kind(strip(x["s"])).isNull())
    return F.array_join(F.transform(kept, lambda x: x["s"]), "\n")


def marker_counts(c: Column) -> dict[str, Column]:
    """Distinct marker words of each language in the text."""
    found = F.array_distinct(pieces(F.lower(c), "[a-záéíóúñ]+"))
    return {k: F.size(F.array_intersect(found, F.array(*map(F.lit, v)))).cast("long") for k, v in L.MARKERS.items()}


def title_guess(c: Column) -> Column:
    """The first of five lines that could be a title: not empty, under 100 characters, without a full stop at its end."""
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 5), strip)
    return F.get(F.filter(lines, lambda s: (s != "") & (F.length(s) < 100) & ~s.endswith(".")), F.lit(0))


def split_by_marker(c: Column, pattern: str) -> Column:
    """Parts that begin at a match of the pattern; what comes before the first is dropped; without two matches the text is one part."""
    parts = F.split(F.regexp_replace(c, f"({pattern})", MARK + "$1"), MARK)
    return F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts))).otherwise(F.array(c))


def encoding_suspect(c: Column) -> Column:
    """A replacement character anywhere, or a mis-decoded two-byte character among the first 100."""
    return F.coalesce(c.contains("�") | F.substring(c, 1, 100).contains("Ã"), F.lit(False))


def excerpt(c: Column, limit: int = 280) -> Column:
    one = collapse(c)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 3)), F.lit("...")))


def leak_flag(c: Column) -> Column:
    low = F.lower(collapse(c))
    out = F.lit(False)
    for m in L.LEAKS:
        out = out | low.startswith(m)
    return F.coalesce(out, F.lit(False))


def strip_prefix(c: Column) -> Column:
    """Without leading paragraphs of visible reasoning."""
    return strip(F.regexp_replace(strip(c), L.REASONING_PREFIX, ""))


def strip_suffix(c: Column) -> Column:
    """Without a trailing comment after a blank line, unless nothing else is left."""
    cut = F.regexp_replace(F.regexp_replace(c, L.COMMENT_SUFFIX, ""), r"\s+$", "")
    return F.when(cut != "", strip(cut)).otherwise(strip(c))


def suffix_marker(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(c, L.COMMENT_SUFFIX, ""), r"\s+$", "")
    return F.when(c.rlike(L.COMMENT_SUFFIX) & (cut != ""), strip(F.regexp_extract(c, L.COMMENT_SUFFIX, 1)))


def normalize_output(c: Column) -> Column:
    """Reasoning prefix, think block, code fence and trailing comment taken off, in this order."""
    c = strip_prefix(c)
    c = F.when(F.lower(c).startswith("<think>") & F.lower(c).contains("</think>"), strip(F.regexp_replace(c, r"(?is)^.*</think>", ""))).otherwise(c)
    fenced = c.startswith("```") & c.endswith("```") & (F.size(F.split(c, "\n")) >= 3)
    c = F.when(fenced, strip(F.regexp_replace(F.regexp_replace(c, r"^[^\n]*\n", ""), r"\n[^\n]*$", ""))).otherwise(c)
    return strip_suffix(strip(c))


def forbidden_markers(c: Column) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, L.FORBIDDEN)), lambda m: low.contains(F.lower(m)))


def links(c: Column) -> Column:
    """Distinct targets of href attributes, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r'href="([^"]*)"'), F.lit(1))))


def hygiene(c: Column) -> Column:
    """Lines with white space at their end, and whether a final newline is missing."""
    bad = F.size(F.filter(F.split(c, "\n"), lambda s: s.rlike(r"[ \t]+$"))).cast("long")
    return F.struct(bad.alias("trailing"), ((c != "") & ~c.endswith("\n")).alias("no_final_newline"))


def valid_run_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))


def slug(url: Column) -> Column:
    """owner/name of a git remote, over ssh or https; null if it is neither."""
    found = F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def embedded_json(c: Column, name: str) -> Column:
    """The JSON in an assignment to a variable of a script."""
    found = F.regexp_extract(c, rf"(?s){name}\s*=\s*(\{{.*?\}}|\[.*?\]);", 1)
    return F.when(found != "", found)


def windows(n: Column, low: int, high: int) -> Column:
    """Bounds of windows without overlap: as long as ``high`` allows; a rest under ``low`` is dropped."""
    starts = F.when(n >= low, F.sequence(F.lit(0), n - low, F.lit(high))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda s: F.struct(s.alias("word_start"), F.least(s + high, n).alias("word_end")))


def sliding_windows(n: Column, size: int, stride: int) -> Column:
    """Bounds of overlapping windows, until one reaches the end."""
    last = F.when(n > size, F.ceil((n - size) / stride).cast("int") * stride).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.struct(s.alias("word_start"), F.least(s + size, n).alias("word_end")))
