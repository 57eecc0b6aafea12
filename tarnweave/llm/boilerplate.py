"""Problem 3: the main body of a page, by a minimum cut over its lines."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import host_of, table
from tarnweave.llm.labelled_pages import FIT, Page
from tarnweave.llm.sitelines import with_shares
from tarnweave.session import spread

_TAG = re.compile(r"<[^<>]{1,400}>|&(?:nbsp|#160);")
_OPENING = re.compile(r"\s*<([a-zA-Z][a-zA-Z0-9]*)")
_CONTAINER = re.compile(r"<(/?)(?:nav|div|ul|ol|table|section|aside|footer|header|article|main)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[\W\d_]+")
_SEPARATOR = re.compile(r"[|·•»›→]|\s+[/>-]\s")
_WIDE = re.compile(r"\S\s{2,}(?=\S)")
_TITLED = re.compile(r"\b[A-Z\u00c0-\u00d6\u00d8-\u00de\u0386-\u03ab\u0400-\u042f]")
_BULLET = re.compile(r"\s*(?:[-*+•·»›>#=|!←→↑↓«‹\[]|\d+[.)]\s)")
_DIGIT = re.compile(r"\d")
_DATE = re.compile(r"\b(?:19|20)\d\d\b")
_COUNTED = re.compile(r"(?:\(\d+\)|\s\d+)\s*$")
_SIGN = re.compile(r"[©↑↓←→]")
_STOPS, _CLOSERS = frozenset(".!?…"), frozenset("”\"’')]")
_PARTS = re.compile(r"\s[-|–—·:]\s")
_LINK = re.compile(r"https?://\S+|\]\([^()\s]+\)|href\s*=", re.I)

#: Of a page: numbers of its non-blank lines, whether each is of the frame, and what share of the site's documents holds it.
Cut = tuple[list[int], list[bool], list[float]]

#: Smoothness: what it costs to part lines of one block, lines over a blank, and lines two apart in a block.
SAME_BLOCK, OVER_BLANK, TWO_APART = 1.5, 0.35, 0.75
#: Lines of like shape (both sentences or both not) hold together more than others.
LIKE, UNLIKE = 1.4, 0.35
#: Where a page has tags: lines in the same element hold together by this factor, lines of different depth by its inverse.
SAME_ELEMENT = 1.5
#: Capacities grow with a line's words: one of so many words counts twice.
DOUBLE_WORDS = 25
#: Each labelled page is learned from whole and, so many times less one, without some of its blocks.
COPIES = 4
#: Penalties on the squared weights of words, of products of places, and of all others.
WORD_PENALTY, PRODUCT_PENALTY, PENALTY = 0.3, 3.0, 0.3


def minimum_cut(scores: Sequence[float], near: Sequence[float], far: Sequence[float]) -> list[bool]:
    """The source side (boilerplate) of a minimum s-t cut of a graph over lines in a row.

    scores[i] > 0 is the capacity from the source, below 0 to the sink; near[i] joins lines i-1 and i, far[i] lines i-2
    and i, both ways. Edges reach over two lines, so all cuts of the lines so far differ for the rest only in the sides
    of the last two: the least cut of each of these four cases is carried on, which gives the cut that a maximum flow
    would saturate, in linear time for pages of any length. Of equal cuts the one with less boilerplate is taken.
    """
    n = len(scores)
    if n == 0:
        return []
    # State: sides of lines i-1 and i as bits; side 1 is boilerplate.
    big = float("inf")
    s = scores[0]
    c00, c01, c10, c11 = (s if s > 0 else 0.0), (-s if s < 0 else 0.0), big, big
    back = []
    for i in range(1, n):
        s, w, v = scores[i], near[i], far[i] if i > 1 else 0.0
        keep, drop = (s, 0.0) if s > 0 else (0.0, -s)
        # From (before, last) to (last, now): now = 0 costs keep, now = 1 costs drop.
        a0, b0 = c00, c10 + v  # last 0, now 0
        a1, b1 = c00 + v, c10  # last 0, now 1
        d0, e0 = c01, c11 + v  # last 1, now 0
        d1, e1 = c01 + v, c11  # last 1, now 1
        back.append((b0 < a0, b1 < a1, e0 < d0, e1 < d1))
        c00, c01 = (b0 if b0 < a0 else a0) + keep, (b1 if b1 < a1 else a1) + w + drop
        c10, c11 = (e0 if e0 < d0 else d0) + w + keep, (e1 if e1 < d1 else d1) + drop
    best = min(c00, c01, c10, c11)
    last, now = (0, 0) if c00 == best else (1, 0) if c10 == best else (0, 1) if c01 == best else (1, 1)
    sides = [now]
    for choice in reversed(back):
        before = int(choice[last * 2 + now])
        last, now = before, last
        sides.append(now)
    return [bool(x) for x in reversed(sides)]


@dataclass(slots=True)
class Line:
    """What a line is by itself: log odds for boilerplate from its text alone, whether it is a sentence, its letters, words."""

    odds: float
    sentence: bool
    bare: str
    words: int
    separated: bool
    tag: str
    depth: int


SHAPES = ("one", "length", "beyond", "sentence", "ends", "colon", "separators", "bullet", "capitals", "titled", "digits", "date", "counted", "sign", "links", "tags", "commas")


def shape_of(raw: str) -> tuple[list[float], list[str], bool, str]:
    """The shape of a line (SHAPES), its words in lower case, whether it is a sentence, and its letters."""
    text = raw.strip()
    tags = 0
    if "<" in text or "&" in text:
        text, tags = _TAG.subn(" ", text)
        text = " ".join(text.split())
    words = _WORD.findall(text.lower())
    n = len(words)
    digits = _DIGIT.search(text) is not None
    if not n:
        return [1.0, *[0.0] * 9, float(digits), 0.0, 0.0, 0.0, 0.0, float(tags > 0), 0.0], [], False, ""
    last = text.rstrip("”\"’')]")
    ends = last[-1:] in _STOPS and (last[-2:-1].isalnum() or last[-2:-1] in _CLOSERS)
    sentence = ends and n >= 4
    wide = text.count("  ")
    # Where every blank is doubled, doubled blanks part nothing.
    plain = text.isascii()
    separators = len(_SEPARATOR.findall(text)) if not plain or "|" in text or "/ " in text or "> " in text or "- " in text else 0
    separators += len(_WIDE.findall(text)) if 0 < wide < n - 1 else 0
    shape = [
        1.0,
        math.log1p(n),
        max(0.0, math.log(n / 12)),
        float(sentence),
        float(ends),
        float(text[-1] == ":"),
        math.log1p(separators),
        float(_BULLET.match(text) is not None),
        float(text.isupper()),
        len(_TITLED.findall(text)) / n,
        float(digits),
        float(digits and _DATE.search(text) is not None),
        float(digits and _COUNTED.search(text, max(0, len(text) - 24)) is not None),
        float(not plain and _SIGN.search(text) is not None or "@" in text or "(c) " in text),
        float(("://" in raw or "](" in raw or "=" in raw) and _LINK.search(raw) is not None),
        float(tags > 0),
        math.log1p(text.count(",")),
    ]
    return shape, words, sentence, "".join(words)


#: What surrounds a line: its own log odds, those around it, how often the site repeats it, the page's address, where it stands.
PLACES = ("one", "odds", "head_odds", "before_odds", "after_odds", "share", "repeated", "seldom", "head_share", "head_repeated", "near_share", "title", "site", "path", "above_title", "before", "behind", "inside", "top", "bottom", "opens", "closes", "block", "beyond", "sentence", "before_sentence", "behind_sentence", "after_title")


#: Places without bound count by themselves alone, and no two of the log odds are multiplied, so that no product runs away
#: on pages unlike the labelled ones.
SIZES, SIGNED = ("beyond",), ("odds", "head_odds", "before_odds", "after_odds")


@dataclass(slots=True)
class Lines:
    """A page's non-blank lines: their numbers from 1, what they are, whether a blank or the start lies before, their shares."""

    numbers: list[int]
    lines: list[Line]
    starts: list[bool]
    own: list[float]


@dataclass
class LineModel:
    """Log odds for boilerplate: by text (words and SHAPES), then by PLACES and their products; two logistic regressions."""

    words: dict[str, float] = field(default_factory=dict)
    shapes: list[float] = field(default_factory=list)
    places: np.ndarray = field(default_factory=lambda: np.zeros((len(PLACES), len(PLACES))))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        return ((rows @ self.places) * rows).sum(1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Weights of a logistic regression with squared penalties, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _marks(words: list[str]) -> list[tuple[str, float]]:
    """The different words of a line with their weights, which shrink as there are more of them, and its first word."""
    if not words:
        return []
    some = dict.fromkeys(words)
    weight = 1 / math.sqrt(len(some))
    return [*((w, weight) for w in some), ("^" + words[0], 1 / 2)]


def labelled_lines(page: Page, keep: Sequence[bool] | None = None) -> tuple[str, list[bool], list[float], str, str]:
    """Text, labels (frame) of the non-blank lines, shares of all lines, title and url of a labelled page, or of some of its blocks."""
    title, site, path, text = page
    lines, labels, shares = [], [], []
    block = 0
    for k, line in enumerate(text.split("\n")):
        block += not line
        if keep and not keep[block]:
            continue
        lines.append(line[1:])
        # Repeated lines stand on a fifth to all of the site's pages.
        shares.append((0.2 + 0.8 * ((k * 37) % 11) / 10) if line[:1] in ("=", "*") else 0.0)
        if line[1:].strip():
            labels.append(line[0] in "-=")
    return "\n".join(lines), labels, shares, title, f"https://{_LETTERS.sub('', site.lower())}.example:443{path}"


def _fit_text(rows: list[tuple[list[float], list[str]]], y: np.ndarray) -> tuple[dict[str, float], list[float]]:
    seen = Counter(m for _, words in rows for m, _ in _marks(words))
    column = {m: len(SHAPES) + i for i, m in enumerate(sorted(m for m, n in seen.items() if n > 1))}
    x = np.zeros((len(rows), len(SHAPES) + len(column)))
    for k, (shape, words) in enumerate(rows):
        x[k, : len(SHAPES)] = shape
        for m, v in _marks(words):
            if m in column:
                x[k, column[m]] = v
    penalty = np.full(x.shape[1], WORD_PENALTY)
    penalty[: len(SHAPES)] = PENALTY
    w = logistic(x, y, penalty)
    return {m: float(w[i]) for m, i in column.items()}, w[: len(SHAPES)].tolist()


def fit(pages: Sequence[Page], folds: int = 6) -> LineModel:
    """Fit both regressions on labelled pages, of which all lines are taken.

    The second one learns from log odds that the first gives to pages it was not fitted on. It sees each page with and
    without shares, and with and without title, since small sites have no shares and some pages no title, and COPIES times.
    """
    texts = [labelled_lines(p) for p in pages]
    rows = [[shape_of(line)[:2] for line in t[0].split("\n") if line.strip()] for t in texts]
    x, y = [], []
    for k in range(folds):
        rest = [i for i in range(len(pages)) if i % folds != k]
        words, shapes = _fit_text([r for i in rest for r in rows[i]], np.array([v for i in rest for v in texts[i][1]], dtype=float))
        asked = []
        for i in range(k, len(pages), folds):
            for copy in range(COPIES):
                # The first copy is the whole page; the others lack some blocks, so that lists come early and late.
                keep = [copy == 0 or (block * 7 + i * 3 + copy * 5) % 11 > 3 for block in range(len(pages[i][3]))]
                text, labels, shares, title, url = labelled_lines(pages[i], keep)
                for some in (shares, []):
                    for name, address in ((title, url), (f"{title} - {pages[i][1]}", url), (None, url.rpartition("/")[0] + "/")):
                        asked.append((text, some, name, address))
                        y += labels
        x.append(Labeller(LineModel(words, shapes)).surroundings(asked)[1])
    i, j = np.array([(a, b) for a in range(len(PLACES)) for b in range(a, len(PLACES)) if not a or PLACES[b] not in SIZES and not (PLACES[a] in SIGNED and PLACES[b] in SIGNED) and PLACES[a] not in SIZES]).T
    table_ = np.concatenate(x)
    # PLACES begins with one, so the first products are the places themselves.
    places = np.zeros((len(PLACES), len(PLACES)))
    places[i, j] = logistic(table_[:, i] * table_[:, j], np.array(y, dtype=float), np.where(i == 0, PENALTY, PRODUCT_PENALTY))
    words, shapes = _fit_text([r for page in rows for r in page], np.array([v for t in texts for v in t[1]], dtype=float))
    return LineModel(words, shapes, places)


@functools.cache
def line_model() -> LineModel:
    """The model fitted on the labelled pages of the module, once a process."""
    return fit(FIT)


class Labeller:
    """Scores lines with a memory of bounded size for those that many pages share, and cuts pages."""

    SIZE = 200_000

    def __init__(self, model: LineModel) -> None:
        self.model = model
        self.known: dict[str, Line] = {}

    def line(self, raw: str) -> Line:
        got = self.known.get(raw)
        if got is None:
            shape, words, sentence, bare = shape_of(raw)
            weights = self.model.words
            odds = sum(map(mul, shape, self.model.shapes))
            if words:
                some = dict.fromkeys(words)
                odds += sum(map(weights.get, some, repeat(0.0))) / math.sqrt(len(some)) + weights.get("^" + words[0], 0.0) / 2
            tag, depth = "", 0
            if "<" in raw:
                first = _OPENING.match(raw)
                tag = first.group(1).lower() if first else ""
                depth = sum(-1 if m.group(1) else 1 for m in _CONTAINER.finditer(raw))
            got = Line(max(-6.0, min(6.0, odds)), sentence, bare, len(words), shape[SHAPES.index("separators")] > 0, tag, depth)
            if len(raw) < 160:
                if len(self.known) >= self.SIZE:
                    self.known.clear()
                self.known[raw] = got
        return got

    def surroundings(self, pages: Sequence[Sequence]) -> tuple[list[Lines], np.ndarray]:
        """The lines of pages (text, shares, title, url), and PLACES of all lines, one page after the other."""
        found: list[Lines] = []
        begins: list[int] = []
        ends: list[int] = []
        headings: list[int] = []
        titles: list[bool] = []
        sites: list[bool] = []
        paths: list[bool] = []
        for page, shares, title, url in pages:
            address = (url or "").lower().split("://", 1)[-1]
            host, _, path = address.partition("/")
            slug = _LETTERS.sub("", path)
            names = [x for x in re.split(r"[.:/-]", host) if len(x) > 3]
            head = _LETTERS.sub("", (title or "").lower())
            numbers: list[int] = []
            lines: list[Line] = []
            starts: list[bool] = []
            own: list[float] = []
            blank, held = True, len(shares)
            for i, raw in enumerate(page.split("\n")):
                if not raw or raw.isspace():
                    blank = True
                    continue
                numbers.append(i + 1)
                lines.append(self.line(raw))
                starts.append(blank)
                own.append(shares[i] if i < held else 0.0)
                blank = False
            found.append(Lines(numbers, lines, starts, own))
            # The title without the site's name behind a dash or bar, which a path to the page ends with.
            parts = [_LETTERS.sub("", p.lower()) for p in _PARTS.split(title or "")]
            titled = [not x.sentence and len(x.bare) >= 8 and (x.bare in slug or head.startswith(x.bare)) for x in lines]
            heading = titled.index(True) if True in titled else -1
            cores = [c for c in (lines[heading].bare if heading >= 0 else max(parts, key=len), _LETTERS.sub("", path.rstrip("/").rpartition("/")[2])) if len(c) >= 8]
            titles += titled
            paths += [x.separated and not x.sentence and not t and any([len(x.bare) > len(c) and c in x.bare for c in cores]) for x, t in zip(lines, titled, strict=True)]
            sites += [not x.sentence and any([x.bare.startswith(m) for m in names]) for x in lines]
            # Sentences that the site does not repeat, and the title, mark where the page's own text begins and ends.
            marked = [k for k, x in enumerate(lines) if x.sentence and x.odds < 0 and x.words >= 6 and not own[k]]
            begins.append(min([*marked[:1], *([heading] if heading >= 0 else [])], default=len(lines)))
            ends.append(marked[-1] if marked else -1)
            headings.append(heading)
        sizes = np.array([len(f.lines) for f in found], dtype=np.int64)
        n = int(sizes.sum())
        if not n:
            return found, np.zeros((0, len(PLACES)))
        at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - at
        begin, end, heading = (np.repeat(np.array(v), sizes) for v in (begins, ends, headings))
        odds = np.array([x.odds for f in found for x in f.lines])
        share = np.array([v for f in found for v in f.own])
        known = np.repeat(np.array([any(f.own) for f in found]), sizes)
        sentence = np.array([x.sentence for f in found for x in f.lines])
        opens = np.array([v for f in found for v in f.starts]) | (at == 0)
        closes = np.append(opens[1:], True)
        every = np.arange(n)
        first = np.maximum.accumulate(np.where(opens, every, 0))
        last = np.minimum.accumulate(np.where(closes, every, n)[::-1])[::-1]
        after, before = ~opens, ~closes  # a line of the same block lies before, or follows
        previous, following = np.maximum(every - 1, 0), np.minimum(every + 1, n - 1)
        title = np.array(titles)
        columns = (
            np.ones(n),
            odds,
            odds[first] * after,
            odds[previous] * after,
            odds[following] * before,
            share,
            share > 0,
            (share == 0) & known,
            share[first] * after,
            (share[first] > 0) & after,
            np.maximum(share[previous] * after, share[following] * before),
            title,
            np.array(sites),
            np.array(paths),
            at < heading,
            at < begin,
            at > end,
            (at > begin) & (at < end),
            1 / (1 + at),
            1 / left,
            opens,
            closes,
            np.minimum(1.0, np.log(last - first + 1) / 3),
            np.log(np.maximum(1.0, np.array([x.words for f in found for x in f.lines]) / 12)),
            sentence,
            sentence[following] & before,
            sentence[previous] & after,
            title[previous] & (at > 0),
        )
        return found, np.column_stack(columns)

    def cut(self, pages: Sequence[Sequence]) -> list[Cut]:
        """Of each page (text, shares, title, url) the Cut. A single line is body."""
        found, places = self.surroundings(pages)
        odds = self.model.odds(places).tolist()
        out: list[Cut] = []
        at = 0
        for f in found:
            n = len(f.lines)
            scores = [s * (1 + x.words / DOUBLE_WORDS) for s, x in zip(odds[at : at + n], f.lines, strict=True)]
            at += n
            out.append((f.numbers, minimum_cut(scores, *edges(f)) if n > 1 else [False] * n, f.own))
        return out


def edges(f: Lines) -> tuple[list[float], list[float]]:
    """What it costs to part each line from the one before, and from the one two before."""
    lines, starts = f.lines, f.starts
    near, far = [0.0], [0.0]
    block, depth, tagged = 0, lines[0].depth, bool(lines[0].tag)
    for k in range(1, len(lines)):
        a, b = lines[k - 1], lines[k]
        like = LIKE if a.sentence == b.sentence else UNLIKE
        if tagged or b.tag:
            tagged = True
            like *= SAME_ELEMENT if a.tag == b.tag and (a.tag or depth > 0) else 1 / SAME_ELEMENT if b.depth else 1.0
            depth += b.depth
        if starts[k]:
            block = 0
            near.append(OVER_BLANK * like)
            far.append(0.0)
        else:
            block += 1
            near.append(SAME_BLOCK * like)
            far.append(TWO_APART * like if block >= 2 and lines[k - 2].sentence == b.sentence else 0.0)
    return near, far


_labellers: dict[str, Labeller] = {}


def labeller(model: LineModel) -> Labeller:
    """One for a process, so that its memory serves all batches."""
    if not _labellers:
        _labellers["only"] = Labeller(model)
    return _labellers["only"]


def label_lines(pages: DataFrame, id: str = "fetch_id", page: str = "page", url: str = "url", title: str = "title") -> DataFrame:  # noqa: A002
    """id and, for each page, arrays `body` and `frame` of the numbers of its non-blank lines, counted from 1 by line feed.

    A graph over the page's lines: a line's log odds for boilerplate, as a classifier fitted on the labelled pages gives
    them from its words, shape, place, likeness to title and site's name and the share of the site's pages that hold it,
    are its capacities to the terminals, in proportion to its words; neighbours in a block, over a blank line and two
    apart are joined by smoothness edges, closer in the same element of a page with tags. The minimum cut parts frame
    from body. The site's shares are counted over all pages; labelling takes one page at a time, of any length.

    Null, empty and blank pages and pages of one line have an empty frame. Null urls have no site, null titles no title.
    Repeated rows give repeated results. Other columns are left out.
    """

    def parts(texts: list[str], cuts: list[Cut]) -> dict[str, pa.Array]:
        kind = pa.list_(pa.int32())
        body = [[n for n, c, _ in zip(*x, strict=True) if not c] for x in cuts]
        frame = [[n for n, c, _ in zip(*x, strict=True) if c] for x in cuts]
        return {"body": pa.array(body, kind), "frame": pa.array(frame, kind)}

    return over_pages(pages, parts, "body array<int>, frame array<int>", id, page, url, title)


def over_pages(pages: DataFrame, make: Callable[[list[str], list[Cut]], dict[str, pa.Array]], schema: str, id: str, page: str, url: str, title: str, kept: Sequence[str] = ()) -> DataFrame:  # noqa: A002
    """id, the columns that `make(texts, cuts)` gives for batches of pages with the cut of each, and the columns `kept`."""
    rows = pages.select(F.col(id).alias("_id"), F.col(page).alias("page"), F.col(url).alias("url"), F.col(title).alias("title"), host_of(url).alias("host"), *kept)
    model = line_model()
    shared = with_shares(rows, "host", "url", "page").where(F.col("page").isNotNull()).select("_id", "page", "url", "title", "_shares", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = labeller(model)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                columns = [batch.column(c).to_pylist() for c in ("page", "_shares", "title", "url")]
                made = make(columns[0], of.cut(list(zip(*columns, strict=True))))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *made.values(), *(batch.column(c) for c in kept)], ["_id", *made, *kept])

    kinds = dict(rows.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in kept)
    return shared.mapInArrow(run, f"_id {kinds['_id']}, {schema}{more}").withColumnRenamed("_id", id)


def main_body(pages: DataFrame, id: str = "fetch_id", page: str = "page", url: str = "url", title: str = "title") -> DataFrame:  # noqa: A002
    """id and `body`: the lines of the main body, each page once; blank lines between them are dropped."""
    once = pages.dropDuplicates([id])
    numbers = label_lines(once, id, page, url, title).select(id, "body")
    lines = once.select(id, F.split(page, "\n").alias("_lines"))
    text = F.array_join(F.transform("body", lambda n: F.element_at("_lines", n)), "\n")
    return lines.join(numbers, id).select(id, text.alias("body"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each non-blank line that is not of the main body."""
    found = label_lines(spread(table(spark, folder, "crawl").select("fetch_id", "url", "title", "page")))
    return found.select("fetch_id", F.explode("frame").alias("line_no")).distinct()


def p3_body(spark: SparkSession, folder: str) -> DataFrame:
    return main_body(spread(table(spark, folder, "crawl").select("fetch_id", "url", "title", "page")))


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found, "p3_body": p3_body}
