"""Problem 4: which markup a page holds, and its text without it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import table

KINDS = ("html", "markdown", "wiki", "latex")
_TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|button|center|cite|code|col|dd|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|label|li|link|main|meta|nav|noscript|ol|option|p|pre|s|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|video"
_HTML_TAG = re.compile(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>", re.I)
#: A comment, told from the last opening before its end, so that many openings without an end cost no more than one look each.
_COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->|<!doctype[^<>]*>", re.I | re.S)
_DOCTYPE = re.compile(r"<!doctype[^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-f]{1,5}|nbsp|amp|lt|gt|quot|apos|copy|reg|[a-z]{2,8}(?:acute|grave|circ|uml|tilde|cedil|slash|ring)|ndash|mdash|hellip|bull|middot|laquo|raquo|[lr]s?[dq]?quo|times|euro|szlig|trade|deg);", re.I)
_COMMANDS = "section|subsection|subsubsection|chapter|paragraph|begin|end|textbf|textit|emph|underline|texttt|citep?|citet|ref|eqref|label|footnote|url|href|caption|item|title|author|documentclass|usepackage|includegraphics|frac|sum|int|sqrt|alpha|beta|gamma|left|right|leq|geq|cdot|times|ldots|mathrm|mathbf"
#: What is counted in a block, by name; each pattern is evidence for or against one kind.
SIGNS = {
    "tag": _HTML_TAG,
    "comment": _COMMENT,
    "entity": _ENTITY,
    "angle": re.compile(r"[<>]"),
    "bold": re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^*]*[^\s*]\*\*(?![\w*])"),
    "under": re.compile(r"(?<![\w_])__(?=[^\s_])[^_]*[^\s_]__(?![\w_])"),
    "link": re.compile(r"!?\[[^\[\]]*\]\([^()\s]+(?:\s\"[^\"]*\")?\)"),
    "hashes": re.compile(r"^\s{0,3}#{1,6}\s+(?!\d+ )\S"),
    "fence": re.compile(r"^\s*(?:```|~~~)"),
    "note": re.compile(r"\[\^\w+\]"),
    "rule": re.compile(r"^\s*\|?(?:\s*:?-{2,}:?\s*\|)+(?:\s*:?-{2,}:?\s*)?\|?\s*$"),
    "strike": re.compile(r"(?<!~)~~\S[^~]*~~(?!~)"),
    "tick": re.compile(r"(?<!`)`[^`\s][^`]*`(?!`)"),
    "quote": re.compile(r"^\s{0,3}>\s+\S"),
    "star": re.compile(r"\*"),
    "apostrophes": re.compile(r"(?<!')'{2,3}(?!')[^']+'{2,3}(?!')"),
    "wikilink": re.compile(r"\[\[[^\[\]]+\]\]"),
    "template": re.compile(r"\{\{[^{}]+\}\}"),
    "equals": re.compile(r"^\s*(={2,6})\s*[^=\s].*?\s*\1\s*$"),
    "wikitable": re.compile(r"^\s*(?:\{\||\|\}|\|-)"),
    "double": re.compile(r"^\s*(?:\|.*\|\||!.*!!)"),
    "square": re.compile(r"\["),
    "command": re.compile(rf"(?<!:)\\(?:{_COMMANDS})(?=[{{\[])|(?<![:\w])\\(?:{_COMMANDS})(?![a-zA-Z\\])"),
    "braces": re.compile(r"\\[a-zA-Z]+\{[^{}]*"),
    "math": re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$\d])[^$]{0,200}[\\^_{][^$]{0,200}\$(?![\w$])"),
    "backslash": re.compile(r"\\"),
    "dollar": re.compile(r"\$"),
}
#: What every match of a sign holds, by name: none of SIGNS can be where its need is not.
_NEEDS = {
    "tag": r"<",
    "comment": r"<",
    "entity": r"&[#\w]+;",
    "angle": r"[<>]",
    "bold": r"\*",
    "under": r"__",
    "link": r"\[",
    "hashes": r"^\s*#",
    "fence": r"`|~~",
    "note": r"\[",
    "rule": r"-{2,}:?\s*\|",
    "strike": r"~~",
    "tick": r"`",
    "quote": r"[<>]",
    "star": r"\*",
    "apostrophes": r"''",
    "wikilink": r"\[",
    "template": r"\{\{",
    "equals": r"^\s*==",
    "wikitable": r"^\s*(?:\{\||\|\}|\|-)",
    "double": r"\|\||!!",
    "square": r"\[",
    "command": r"\\",
    "braces": r"\\",
    "math": r"\$",
    "backslash": r"\\",
    "dollar": r"\$",
}
#: A block without any of these has no sign; it is cheap to see.
_ANY = re.compile("|".join(dict.fromkeys(_NEEDS[name] for name in SIGNS)), re.M)
_URL = re.compile(r"https?://\S+|href\s*=\s*\S+", re.I)
_TEXT_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>|\[[^\[\]]*\]\([^()]*\)|\[\[[^\[\]]+\]\]", re.I | re.S)

#: The labelled table: blocks of invented text and the kinds of markup they hold.
LABELLED: list[tuple[str, tuple[str, ...]]] = [
    ("The old bridge was closed after the flood.", ()),
    ("* Bring two eggs and a cup of milk", ()),
    ("- three red apples", ()),
    ("1. Open the lid", ()),
    ("#7 in our list: the lighthouse", ()),
    ("#summer #holiday #beach", ()),
    ("The R&D budget is $40 to $60 a day.", ()),
    ("It cost $12 and then $15.", ()),
    ("If a < b and c > d, stop.", ()),
    ("We found x < 3 and y > 9 in 5 tests.", ()),
    ("He typed 2**8 and {name} by hand.", ()),
    ("Use my_long_variable_name = 5 in C:\\temp\\files.", ()),
    ("Look in D:\\section\\item for it.", ()),
    ("They was [sic] late, he wrote.", ()),
    ("[Skip to content]", ()),
    ("* A star marks what nobody [sic] saw.", ()),
    ("News | Sport | Weather", ()),
    ("| left |", ()),
    ("Home > World > Europe", ()),
    ("5 + 6 = 11", ()),
    ("See you at 10 ~ 11 o'clock!!!", ()),
    ("Tom & Jerry; AT&T", ()),
    ("The score was 3:2 *after* extra time", ()),
    ("don't, won't, can't and 'so on'", ()),
    ("====", ()),
    ("price: 5$ or 6$ each", ()),
    ("> ", ()),
    ("-----", ()),
    ("<p>The old bridge was closed.</p>", ("html",)),
    ("It was <b>cold</b> that day.", ("html",)),
    ("<li><a href=\"/news\">News</a></li>", ("html",)),
    ("<DIV CLASS=\"x\">Once more", ("html",)),
    ("first line<br/>second line", ("html",)),
    ("a long line<br>", ("html",)),
    ("<!-- start of article -->The mayor said no.", ("html",)),
    ("<!-- hidden -->", ("html",)),
    ("Fish &amp; chips", ("html",)),
    ("two&nbsp;words", ("html",)),
    ("quote &#8211; &quot;word&quot;", ("html",)),
    ("&lt;em&gt;so&lt;/em&gt; it was", ("html",)),
    ("</div>", ("html",)),
    ("see <a href=/x/y.html rel=nofollow>this</a> page", ("html",)),
    ("# Heading of the page", ("markdown",)),
    ("## Results and notes", ("markdown",)),
    ("### Cache", ("markdown",)),
    ("It was **very important** to them.", ("markdown",)),
    ("It was __very important__ to them.", ("markdown",)),
    ("Read [the report](/files/report) first.", ("markdown",)),
    ("![a boat](img/boat.png)", ("markdown",)),
    ("```", ("markdown",)),
    ("```python", ("markdown",)),
    ("As others found. [^2]", ("markdown",)),
    ("|---|:--|", ("markdown",)),
    ("| --- | --- |", ("markdown",)),
    ("Run `make all` twice.", ("markdown",)),
    ("That is ~~wrong~~ right.", ("markdown",)),
    ("> The committee agreed with the plan.", ("markdown",)),
    ("> It rained", ("markdown",)),
    ("> They came home late, and nobody asked them why.", ("markdown",)),
    ("The '''fort''' stands on a hill.", ("wiki",)),
    ("It was ''never'' taken.", ("wiki",)),
    ("The [[river]]s meet here.", ("wiki",)),
    ("The [[fort (building)|fort]] is old.", ("wiki",)),
    ("[[Category:Forts of the north]]", ("wiki",)),
    ("It was built early.{{cite web|title=Forts}}", ("wiki",)),
    ("{{Infobox fort|name=Old|size=4}}", ("wiki",)),
    ("== History ==", ("wiki",)),
    ("=== Later years ===", ("wiki",)),
    ("{| class=\"wikitable\"", ("wiki",)),
    ("|-", ("wiki",)),
    ("|}", ("wiki",)),
    ("! year !! people", ("wiki",)),
    ("| 1900 || 45", ("wiki",)),
    ("\\section{Methods and data}", ("latex",)),
    ("\\begin{itemize}", ("latex",)),
    ("\\end{itemize}", ("latex",)),
    ("\\item the first case", ("latex",)),
    ("This was \\emph{not} seen before.", ("latex",)),
    ("A \\textbf{strong} effect.", ("latex",)),
    ("as shown in \\cite{smith2001}", ("latex",)),
    ("see~\\ref{sec:data}", ("latex",)),
    ("It grew\\footnote{See above.} fast.", ("latex",)),
    ("where $x_{2} = \\frac{a^2}{4}$ holds", ("latex",)),
    ("$$\\sum_{i=1}^{n} x_i \\leq 9$$", ("latex",)),
    ("for $n^2$ steps", ("latex",)),
    ("A \\textbf{strong} and \\emph{new} effect, \\cite{lee1999}", ("latex",)),
]
#: Short labelled pages: each line with its kinds, learned together with the lines before and after it.
LABELLED_PAGES: list[list[tuple[str, tuple[str, ...]]]] = [
    [("Home", ()), ("> World", ()), ("> Europe", ()), ("> North Sea", ()), ("A storm closed the harbours on Monday, and the ferries stayed in.", ())],
    [("Start", ()), ("> News", ()), ("> Local News", ()), ("The mayor opened the new bridge over the river this week.", ())],
    [("Shop", ()), ("> Garden", ()), ("> Tools", ()), ("", ()), ("All our tools come with a warranty of two years.", ())],
    [("The committee met on Monday, and this is what it wrote:", ()), ("> It rained", ("markdown",)), ("", ()), ("Nobody had anything to add to that.", ())],
    [("He was asked whether he would come again next year.", ()), ("> Yes.", ("markdown",)), ("The others laughed, because they had heard it before.", ())],
    [("", ()), ("> They came home late, and nobody asked them why.", ("markdown",)), ("> It rained", ("markdown",)), ("", ())],
    [("Where they had been, the two of them never told anyone.", ()), ("", ()), ("> North Sea", ("markdown",)), ("", ()), ("Years later a letter was found in the old house.", ())],
    [("He wrote:", ()), ("> They came home late, and nobody asked them why.", ("markdown",)), ("", ())],
    [("Letters", ()), ("> The committee agreed with the plan.", ("markdown",)), ("> It rained all day, so they stayed where they were.", ("markdown",)), ("Anna", ())],
    [("All the news of the week in one list: https://news.example/lists/all-the-news-of-the-week-in-one-long-list", ()), ("> What the coast said", ()), ("Everything on the weather of the north: https://news.example/weather/everything-on-the-weather-of-the-north", ())],
    [("The best stories of the last year by topic: https://news.example/years/the-best-stories-of-the-last-year", ()), ("> More of them, they said", ()), ("", ())],
    [("The committee met on Monday, and this is what it wrote:", ()), ("> What the coast said", ("markdown",)), ("Everything else was left for the next meeting in the spring.", ())],
    [("The cleaners had just left when we came into the hall.", ()), ("! Attention !! Wet floor", ()), ("We walked around it, because the sign was large enough.", ())],
    [("Many people came to the market on the first day of spring.", ()), ("! Hurry !! Last day", ()), ("", ())],
    [("{| class=\"wikitable\"", ("wiki",)), ("! year !! people", ("wiki",)), ("|-", ("wiki",)), ("| 1900 || 45", ("wiki",)), ("|-", ("wiki",)), ("| 1910 || 60", ("wiki",)), ("|}", ("wiki",))],
    [("The town grew fast after the railway had come to the valley.", ()), ("{| class=\"wikitable\"", ("wiki",)), ("|-", ("wiki",)), ("! mayor !! from !! to", ("wiki",)), ("|}", ("wiki",)), ("Its oldest house stands near the western gate.", ())],
    [("The fort was built on a hill over the river in 1450.", ()), ("== Later years ==", ("wiki",)), ("It was ''never'' taken, though many tried in those years.", ("wiki",)), ("The [[river]]s meet here, and the road crosses both of them.", ("wiki",))],
    [("## Results and notes", ("markdown",)), ("The first test took longer than we had thought it would.", ()), ("It was **very important** to the people who ran it.", ("markdown",)), ("Read [the report](/files/report) first.", ("markdown",)), ("Run `make all` twice.", ("markdown",))],
    [("We put the figures into a table for those who want them.", ()), ("| size | price |", ()), ("|---|:--|", ("markdown",)), ("| 4 | 12 |", ()), ("", ())],
    [("We start it from the shell, as everybody does these days.", ()), ("```", ("markdown",)), ("make all", ()), ("```", ("markdown",)), ("After that it runs by itself until the evening comes.", ())],
    [("<p>The old bridge was closed after the flood of last year.</p>", ("html",)), ("<p>It was <b>cold</b> that day, and few went out.</p>", ("html",)), ("</div>", ("html",))],
    [("Few came to the hall, because the snow had closed the roads.", ()), ("Fish &amp; chips", ("html",)), ("Those who came were glad to have something warm to eat.", ())],
    [("\\section{Methods and data}", ("latex",)), ("We asked the people of three towns about their weather.", ()), ("This was \\emph{not} seen before, as far as we know.", ("latex",)), ("where $x_{2} = \\frac{a^2}{4}$ holds", ("latex",)), ("All of them said that it had rained more in the past.", ())],
    [("The cases are these, in the order in which they were found.", ()), ("\\begin{itemize}", ("latex",)), ("\\item the first case", ("latex",)), ("\\end{itemize}", ("latex",)), ("The sum of all that is what we call the total loss.", ()), ("$$\\sum_{i=1}^{n} x_i \\leq 9$$", ("latex",)), ("", ())],
    [("News | Sport | Weather", ()), ("Home > World > Europe", ()), ("The R&D budget is $40 to $60 a day, said the mayor of the town.", ()), ("* Bring two eggs and a cup of milk", ()), ("* A star marks what nobody [sic] saw.", ()), ("If a < b and c > d, stop.", ())],
]
FEATURES = (*SIGNS, "words", "links", "words_before", "links_before", "words_after", "links_after")


def link_density(block: str) -> float:
    """Share of a block's characters in links."""
    inside = sum(len(m.group(0)) for m in _TEXT_LINK.finditer(block)) or sum(len(m.group(0)) for m in _URL.finditer(block))
    return min(1.0, inside / max(1, len(block)))


def features(block: str, before: str = "", after: str = "") -> list[float]:
    """Counts of the signs, words and link density of the block, and those of its neighbours."""
    row = [float(sum(1 for _ in p.finditer(block))) for p in SIGNS.values()]
    for text in (block, before, after):
        row += [float(len(text.split())), link_density(text)]
    return row


class Tree:
    """A decision tree for yes or no, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12) -> None:
        self.leaf, self.yes = True, bool(y.mean() >= 0.5) if len(y) else False
        if depth == 0 or not len(y) or y.all() or not y.any():
            return
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for t in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= t
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, j, t)
        if best is None:
            return
        _, self.feature, self.threshold = best
        left = x[:, self.feature] <= self.threshold
        self.leaf = False
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def says(self, row: list[float]) -> bool:
        node = self
        while not node.leaf:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.yes


_trees: dict[str, Tree] = {}


def labelled() -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """Features and kinds of all labelled blocks: those of the table, which stand alone, and those of the labelled pages."""
    rows, answers = [], []
    for page in [[block] for block in LABELLED] + LABELLED_PAGES:
        lines = [line for line, _ in page]
        for i, (line, kinds) in enumerate(page):
            rows.append(features(line, *neighbours(lines, i)))
            answers.append(kinds)
    return np.array(rows), answers


def neighbours(lines: list[str], i: int) -> tuple[str, str]:
    """The blocks before and after a block; an empty one at either end."""
    return lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""


def trees() -> dict[str, Tree]:
    """One tree a kind, grown from the labelled table and pages at first use."""
    if not _trees:
        x, answers = labelled()
        for kind in KINDS:
            _trees[kind] = Tree(x, np.array([kind in kinds for kinds in answers]))
    return _trees


def comments_of(page: str) -> Iterator[tuple[int, int]]:
    """Where comments begin and end, one after the other."""
    at = page.find("<!--")
    while at >= 0:
        end = page.find("-->", at + 4)
        if end < 0:
            return
        yield at, end + 3
        at = page.find("<!--", end + 3)


def without_comments(page: str) -> str:
    out, at = [], 0
    for begin, end in comments_of(page):
        out.append(page[at:begin])
        at = end
    return _DOCTYPE.sub("", "".join([*out, page[at:]]))


def blocks_of(page: str) -> list[str]:
    """The page's lines; lines that a comment spans are one block."""
    out, at = [], 0
    for begin, end in comments_of(page):
        if begin >= at and "\n" in page[begin:end]:
            first = page.rfind("\n", at, begin) + 1 or at
            last = page.find("\n", end)
            last = len(page) if last < 0 else last
            out += page[at : first - 1].split("\n") if first > at else []
            out.append(page[first:last])
            at = last + 1
    return out + page[at:].split("\n") if at <= len(page) else out


def kinds_of(page: str) -> set[str]:
    """Kinds of markup that a page's blocks (its lines; a comment may span several) hold."""
    if not _ANY.search(page):
        return set()
    found: set[str] = set()
    lines = blocks_of(page)
    grown = trees()
    for i, line in enumerate(lines):
        if _ANY.search(line):
            row = features(line.strip(), *neighbours(lines, i))
            found.update(kind for kind in KINDS if kind not in found and grown[kind].says(row))
            if len(found) == len(KINDS):
                break
    return found


_HEAD_TAG = re.compile(r"<h[1-6][^>]*>(.*?)</h[1-6]\s*>", re.I | re.S)
_SCRIPT = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>", re.I | re.S)
_PRE = re.compile(r"<pre[^>]*>(.*?)</pre\s*>", re.I | re.S)
_BREAK = re.compile(r"<(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table)\b[^>]*>", re.I)
_LATEX_HEAD = re.compile(r"\\(?:sub){0,2}(?:section|chapter|paragraph|title)\*?\{([^{}]*)\}")
_LATEX_DROP = re.compile(r"~?\\(?:cite[pt]?|ref|eqref|label|begin|end|documentclass|usepackage|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}]*\})?")
_LATEX_KEEP = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|url|text|mbox|caption)\*?\{([^{}]*)\}")
_LATEX_NOTE = re.compile(r"\\footnote\{([^{}]*)\}")
_LATEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?\n?(.*?)\n?\\end\{\1\*?\}", re.S)
_LATEX_FORMULA = re.compile(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.*?)\\\]", re.S)
_LATEX_INLINE = re.compile(r"\\\((.+?)\\\)")
_MATH = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$", re.S)
_WIKI_CODE = re.compile(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", re.I | re.S)
_WIKI_FORMULA = re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.I | re.S)
_WIKI_FILE = re.compile(r"\[\[(?:File|Image):[^\[\]]*?(?:\|([^\[\]|]*))?\]\]", re.I)
#: Parameters of a picture, which are no caption.
_WIKI_LOOKS = frozenset("thumb thumbnail frame frameless border left right center none upright".split())
_FENCE = "```"


def _fenced(code: str) -> str:
    return f"\n{_FENCE}\n{code.strip(chr(10))}\n{_FENCE}\n"


def _formula(body: str) -> str:
    text = " ".join(body.split())
    return f"\n$$ {text} $$\n" if text else "\n"


def _caption(m: re.Match[str]) -> str:
    last = (m.group(1) or "").strip()
    return "" if last.lower() in _WIKI_LOOKS or re.fullmatch(r"\d+px", last) else last


def _indented(text: str) -> str:
    """Lines that four blanks or a tab indent, behind a blank line and outside fences and lists, as fenced code."""
    out: list[str] = []
    fence = listed = code = False
    before = ""
    for line in text.split("\n"):
        if SIGNS["fence"].match(line):
            fence = not fence
        deep = line.startswith(("    ", "\t")) and bool(line.strip())
        if code and not deep and line.strip():
            out.append(_FENCE)
            code = False
        if deep and not code and not fence and not listed and not before.strip():
            out.append(_FENCE)
            code = True
        if line.strip() and not deep:
            listed = re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) is not None
        out.append(re.sub(r"^(?:    |\t)", "", line) if code else line)
        before = line
    return "\n".join([*out, _FENCE] if code else out)


def clean(page: str, kinds: set[str]) -> str:
    """The page's text without markup of these kinds.

    Headings come as lines that begin with `# `, list items with `- `, code between lines of three back-ticks (also what
    Markdown indents, and LaTeX and wikis put into their elements), formulas between dollar signs; cells of a table row are
    parted by ` | `. Footnotes stand in brackets, captions stay. Signs of other kinds stay as they are.
    """
    text = page
    if "latex" in kinds and "\\end{" in text:
        text = _LATEX_CODE.sub(lambda m: _fenced(m.group(2)), text)
    if "latex" in kinds:
        text = _LATEX_FORMULA.sub(lambda m: _formula(m.group(3) or m.group(4) or ""), text)
        text = _LATEX_INLINE.sub(r"$\1$", text)
    if "wiki" in kinds and "</" in text:
        text = _WIKI_CODE.sub(lambda m: _fenced(m.group(2)), text)
        text = _WIKI_FORMULA.sub(lambda m: f"${m.group(1).strip()}$", text)
    if "markdown" in kinds and ("    " in text or "\t" in text):
        text = _indented(text)
    if "html" in kinds:
        text = without_comments(text)
        # Elements that never end are looked for only once.
        lower = text.lower()
        if any(f"</{name}" in lower for name in ("script", "style", "noscript")):
            text = _SCRIPT.sub(" ", text)
        if "</pre" in lower:
            text = _PRE.sub(lambda m: _fenced(m.group(1)), text)
        if "</h" in lower:
            text = _HEAD_TAG.sub(r"\n# \1\n", text)
        text = re.sub(r"<li\b[^>]*>", "\n- ", _BREAK.sub("\n", text), flags=re.I)
        text = html.unescape(_HTML_TAG.sub("", text))
        text = _HTML_TAG.sub("", text).replace("\xa0", " ")
    out: list[str] = []
    code = False
    for line in text.split("\n"):
        bare = line.rstrip("\r")
        if "markdown" in kinds and SIGNS["fence"].match(bare) or kinds and bare == _FENCE:
            code = not code
            out.append(_FENCE)
            continue
        if code:
            out.append(bare)
            continue
        if "markdown" in kinds:
            if SIGNS["rule"].match(bare) and "|" in bare:
                continue
            bare = re.sub(r"^\s{0,3}#{1,6}\s+(?!\d+ )(.*?)\s*#*$", r"# \1", bare)
            bare = re.sub(r"^\s{0,3}>\s+", "", bare)
            bare = SIGNS["note"].sub("", re.sub(r"!?\[([^\[\]]*)\]\([^()\s]+(?:\s\"[^\"]*\")?\)", r"\1", bare))
            for sign, n in (("bold", 2), ("under", 2), ("strike", 2), ("tick", 1)):
                bare = SIGNS[sign].sub(lambda m, n=n: m.group(0)[n:-n], bare)
            if re.match(r"^\s*\|.*\|\s*$", bare) and "||" not in bare:
                bare = " | ".join(c.strip() for c in bare.strip().strip("|").split("|"))
        if "wiki" in kinds:
            if SIGNS["wikitable"].match(bare):
                continue
            bare = _WIKI_FILE.sub(_caption, SIGNS["template"].sub("", bare))
            bare = re.sub(r"\[\[Category:[^\[\]]*\]\]", "", bare, flags=re.I)
            bare = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", bare)
            bare = re.sub(r"^\s*(={2,6})\s*([^=\s].*?)\s*\1\s*$", r"# \2", bare)
            bare = re.sub(r"(?<!')('{2,3})(?!')([^']+)\1(?!')", r"\2", bare)
            if SIGNS["double"].match(bare):
                bare = " | ".join(c.strip() for c in re.split(r"\|\||!!", bare.strip().lstrip("|!")))
        if "latex" in kinds:
            if re.match(r"^\s*%", bare):
                continue
            maths: list[str] = []
            bare = _MATH.sub(lambda m, kept=maths: kept.append(m.group(0)) or f"\x00{len(kept) - 1}\x00", bare) if SIGNS["math"].search(bare) else bare
            bare = _LATEX_DROP.sub("", _LATEX_HEAD.sub(r"# \1", bare))
            for _ in range(3):
                bare = _LATEX_NOTE.sub(r" (\1)", _LATEX_KEEP.sub(r"\1", bare))
            bare = re.sub(r"^\s*\\item\s*", "- ", bare)
            bare = re.sub("\x00(\\d+)\x00", lambda m, kept=maths: kept[int(m.group(1))], bare)
        out.append(re.sub(r"^\s*[*•]\s+", "- ", bare.rstrip()) if kinds else bare)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def strip_markup(pages: DataFrame, id: str = "fetch_id", page: str = "page", text: bool = True) -> DataFrame:  # noqa: A002
    """id, kinds (array, in the order of KINDS) and, if asked, text: each page's markup and what remains without it.

    Blocks are the page's lines; a tree for each kind of markup, trained on the labelled table and pages, judges a block by
    its signs, its words and link density and those of its neighbours. No shuffle; pages of any length. Null pages have no
    kinds and a null text, empty ones an empty text; repeated rows give repeated results; other columns are left out.
    """
    schema = "_id " + dict(pages.select(F.col(id).alias("_id")).dtypes)["_id"] + ", kinds array<string>" + (", text string" if text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_page").to_pylist()
            kinds = [kinds_of(t) if t else set() for t in texts]
            columns = [batch.column("_id"), pa.array([[k for k in KINDS if k in x] for x in kinds], pa.list_(pa.string()))]
            if text:
                columns.append(pa.array([None if t is None else clean(t, k) for t, k in zip(texts, kinds, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "kinds", "text"][: len(columns)])

    return pages.select(F.col(id).alias("_id"), F.col(page).alias("_page")).mapInArrow(run, schema).withColumnRenamed("_id", id)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = strip_markup(table(spark, folder, "crawl").select("fetch_id", "page"), text=False)
    return found.select("fetch_id", F.explode("kinds").alias("markup")).distinct()


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of each fetch, once."""
    return strip_markup(table(spark, folder, "crawl").select("fetch_id", "page")).dropDuplicates(["fetch_id"])


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
