"""HTML to text, titles, links and tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that the cleaned text loses wherever they stand, in this order of alternatives.
LAYOUT_WORDS = "content|div|menu|width|height|main|contents|sidebar|hide|navigation"
#: A small list of English stop words; callers give their own, of any length, from a file (sources.tables.read_lines).
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visible_text(html: Column | str, strict: bool = True) -> Column:
    """Scripts and tags become blanks, then everything but ASCII letters, digits and white space does.

    CSS inside style elements stays, as the index has always had it; strict=False takes it out first.
    """
    text = F.regexp_replace(_col(html), r"(?s)<script\b.*?</script\s*>", " ")
    if not strict:
        text = F.regexp_replace(text, r"(?is)<(style|noscript)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"[^a-zA-Z0-9\s]", " ")


def page_text(html: Column | str, stop_words: Iterable[str] = STOP_WORDS, strict: bool = True) -> Column:
    """The text the index is built from: visible text without layout and stop words, in lower case with single blanks."""
    text = F.lower(F.regexp_replace(visible_text(html, strict), LAYOUT_WORDS, " "))
    dropped = sorted({w.lower() for w in stop_words if w.isascii() and w.isalnum()})
    # Only letters, digits and white space are left, so whole words are what white space parts; a set is asked for each.
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(dropped) if dropped else w != "")
    return F.array_join(words, " ")


def page_title(html: Column | str) -> Column:
    """What stands between the first <title> and </title>; empty if nothing does."""
    return F.regexp_extract(_col(html), r"(?s)<title>(.*?)</title>", 1)


def page_description(html: Column | str, strict: bool = True) -> Column:
    """The description of the literal meta tag, else the first 50 characters of the visible text, cut behind "wikipedia"."""
    meta = F.regexp_extract(_col(html), r"(?s)<meta name=\"description\" content=\"(.*?)\"", 1)
    start = F.left(visible_text(html, strict), F.lit(50))
    cut = F.when(F.locate("wikipedia", start) > 0, F.left(start, F.locate("wikipedia", start) + 8)).otherwise(start)
    return F.coalesce(F.nullif(meta, F.lit("")), cut)


# An opening tag of an anchor whose attributes are plain words with or without a value, and one attribute.
ANCHOR = r"""(?i)<\s*a((?:\s+\w+(?:\s*=\s*(?:"[^"\n]*"|'[^'\n]*'|[^'">\s]+))?)*)\s*>"""
ATTRIBUTE = r"""\s+(\w+)(?:\s*=\s*("[^"\n]*"|'[^'\n]*'|[^'">\s]+))?"""


def page_links(html: Column | str) -> Column:
    """Array of the values of every href of anchors whose attributes are all plain words; blank ones left out.

    An attribute need not have a value; blanks may stand behind the bracket; a tag with any other sign is no anchor.
    """
    inside = F.regexp_extract_all(_col(html), F.lit(ANCHOR), F.lit(1))
    pairs = F.flatten(F.transform(inside, lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))))
    values = F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) == "href"), lambda p: F.regexp_replace(p["v"], r"""^["']|["']$""", ""))
    return F.filter(values, lambda v: F.trim(v) != "")


def index_tokens(text: Column | str) -> Column:
    """Different words of a text, split at punctuation and white space, in lower case."""
    parts = F.split(_col(text), r"[.,:;!?'\"()\-]|\s")
    return F.array_distinct(F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.lower(x)))


def term_tokens(text: Column | str) -> Column:
    """Words of a text by single blanks, with repeats."""
    return F.split(F.trim(_col(text)), " ")
