"""Problem 7: pages of repeated keywords, links or product tags instead of sentences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.boilerplate import Cut, over_pages
from tarnweave.llm.common import table
from tarnweave.llm.reading import ENGLISH, OTHERS
from tarnweave.session import materialise, spread

#: Texts are compressed in blocks of at most so many characters.
BLOCK = 1024
#: A body is redundant below this share of what sentences of like length and language have, of bytes after compression
#: and of different words, by the mean of both.
REDUNDANT = 0.9
#: So few bytes after compression alone are redundant too.
EXTREME = 0.82
#: Where the page has so many out-links in a hundred of its own words, this share is redundant already.
MANY_LINKS, REDUNDANT_LINKS = 10.0, 0.95
#: Sentences end less often than so many times in a hundred words where there are none.
FEW_ENDS = 4.0
#: A unit of at least so many words that ends like a sentence is one; of scripts without blanks, of so many letters.
SENTENCE_WORDS, SENTENCE_LETTERS = 4, 8
#: Of lines that the cut of problem 3 drops, those of so many words are measured all the same, unless the site repeats them.
OWN_WORDS = 12
_WORD = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[.!?][”\"’'»)])\s+")
#: Signs that end sentences in scripts that put no blank behind them.
_TIGHT = "。！？।؟"
_TIGHT_UNIT = re.compile(_UNIT.pattern + f"|(?<=[{_TIGHT}])")
_END = re.compile(r"(?<=[\w”\"’'»)\]])[.?!…。！？।؟](?![.?!\w])")
_ENDS = frozenset(".?!…。！？।؟")
_LETTER = re.compile(r"[^\W\d_]")
_BEYOND = re.compile(r"[^\W\d_\x00-\u00bf]")
_FAR_LETTER = re.compile(r"[^\W\d_\x00-\u024f]")


#: Function words by language; of as many of two, the earlier one is meant. They tell languages, not sentences.
LANGUAGES = {"en": ENGLISH | frozenset("a in on no so its how than while why if between who".split()), **OTHERS}
_MARKS = {w: tuple(name for name, words in LANGUAGES.items() if w in words) for w in frozenset().union(*LANGUAGES.values())}


def units(text: str) -> Iterator[str]:
    """Lines and sentences; runs of over 80 words without an end in pieces of 25."""
    for unit in (_TIGHT_UNIT if any(c in text for c in _TIGHT) else _UNIT).split(text):
        words = unit.split()
        if len(words) > 80:
            for k in range(0, len(words), 25):
                yield " ".join(words[k : k + 25])
        elif words:
            yield unit


def split_prose(text: str) -> tuple[str, str]:
    """What ends like sentences, and the rest. Signs that are repeated (!!!) end none; no words of any language are asked for."""
    prose, other = [], []
    for unit in units(text):
        tail = unit.rstrip("”\"’'»)] \t\r")
        ends = tail[-1:] in _ENDS and _END.search(tail, len(tail) - 1) is not None
        long = ends and (len(_WORD.findall(unit)) >= SENTENCE_WORDS or not unit.isascii() and len(_FAR_LETTER.findall(unit)) >= SENTENCE_LETTERS)
        (prose if long else other).append(unit)
    return "\n".join(prose), "\n".join(other)


def _foreign(text: str) -> bool:
    return not text.isascii() and _BEYOND.search(text) is not None


def own_text(text: str, cut: Cut) -> str:
    """The lines of a page that are its own: those of the main body, and long ones that the site does not repeat."""
    lines = text.split("\n")
    return "\n".join(lines[n - 1].strip() for n, frame, share in zip(*cut, strict=True) if not frame or share == 0 and len(lines[n - 1].split()) >= OWN_WORDS)


@dataclass(slots=True)
class Block:
    """Bytes (n), those after compression (z), words (w), the different ones (d); function words by language, script, letters."""

    n: int
    z: int
    w: int
    d: int
    marks: dict[str, int]
    script: str
    foreign: bool


def block_of(text: str) -> Block:
    raw = text.encode("utf-8", "surrogatepass")
    words = _WORD.findall(text.lower())
    return Block(len(raw), len(zlib.compress(raw, 6)), len(words), len(set(words)), function_words(words), script(text), _foreign(text))


def blocks(text: str) -> list[Block]:
    return [block_of(text[k : k + BLOCK]) for k in range(0, len(text), BLOCK)]


def function_words(words: list[str]) -> dict[str, int]:
    """How many of the words are function words of each language."""
    counts: dict[str, int] = {}
    for w in filter(_MARKS.__contains__, words):
        for name in _MARKS[w]:
            counts[name] = counts.get(name, 0) + 1
    return counts


def script(text: str) -> str:
    """The script of most of a text's letters where that is not Latin, else an empty string."""
    if text.isascii() or not _FAR_LETTER.search(text):
        return ""
    far = Counter(_FAR_LETTER.findall(text))
    if 2 * far.total() <= len(_LETTER.findall(text)):
        return ""
    scripts: Counter[str] = Counter()
    for c, n in far.items():
        scripts[unicodedata.name(c, "other").split()[0].lower()] += n
    return "script " + max(sorted(scripts), key=scripts.__getitem__)


def language(found: Sequence[Block], page: str = "") -> str:
    """Language of a text's blocks by their function words, or its script where that is not Latin.

    Latin texts of too few function words are of the page's language, if that is a Latin one. Else those with letters
    beyond ASCII are "latin+", others "latin", which stands for all languages of that script. Bytes after compression
    and different words depend on all of this.
    """
    sizes: Counter[str] = Counter()
    counts: Counter[str] = Counter()
    for b in found:
        sizes[b.script] += b.n
        counts.update(b.marks)
    of = max(sizes, key=sizes.__getitem__, default="")
    if of:
        return of
    most = max(counts.values(), default=0)
    if most >= 2 and most * 12 >= sum(b.w for b in found):
        best = [name for name in LANGUAGES if counts[name] == most]
        return page if page in best else best[0]
    if page and not page.startswith("script "):
        return page
    return "latin+" if any(b.foreign for b in found) else "latin"


def stuffed_pages(pages: DataFrame, id: str = "fetch_id", page: str = "page", url: str = "url", title: str = "title", links: str = "urls", redundant: float = REDUNDANT) -> DataFrame:  # noqa: A002
    """id, prose and rest (characters), ratio (redundancy of the rest against sentences), ends and links (per 100 words), stuffed.

    Of each page's own lines (the main body, as the minimum cut finds it, and long lines that the site does not repeat),
    what ends like sentences is parted from the rest. Both are compressed in blocks. The median ratio of the sentences'
    blocks of all pages, by length (quarters of a power of two) and language of the block, is what a block may be expected
    to have, and so is the median share of different words: tables of one form compress well but name different things.
    Where a Latin language has no sentences of a length, those of all Latin ones stand in. A page is stuffed if most of its
    own text is no sentences, those parts have less than `redundant` of the expectation, by the mean of both measures or
    extremely by compression alone, or a little more on a page of many out-links, and sentence ends are rare in them.

    Null and blank pages are left out; null lists have no links. Repeated rows give repeated results.
    """

    def measured(texts: list[str], cuts: list[Cut]) -> dict[str, pa.Array]:
        made: dict[str, list] = {"prose": [], "rest": [], "ends": [], "words": [], "of_prose": [], "of_rest": []}
        for text, cut in zip(texts, cuts, strict=True):
            prose, rest = split_prose(own_text(text, cut))
            of_prose, of_rest = blocks(prose), blocks(rest)
            lang = language(of_prose + of_rest)
            words = sum(b.w for b in of_rest)
            more = len(rest) > len(prose)
            made["prose"].append(len(prose))
            made["rest"].append(len(rest))
            made["ends"].append(100 * len(_END.findall(rest)) / max(1, words))
            made["words"].append(words + sum(b.w for b in of_prose))
            for name, some in (("of_prose", of_prose), ("of_rest", of_rest if more else [])):
                made[name].append([{"n": b.n, "z": b.z, "w": b.w, "d": b.d, "l": language([b], lang)} for b in some])
        block = pa.list_(pa.struct([*((c, pa.int32()) for c in "nzwd"), ("l", pa.string())]))
        kinds = {"prose": pa.int32(), "rest": pa.int32(), "ends": pa.float64(), "words": pa.int32(), "of_prose": block, "of_rest": block}
        return {k: pa.array(v, kinds[k]) for k, v in made.items()}

    block = "array<struct<n: int, z: int, w: int, d: int, l: string>>"
    linked = pages.withColumn("_links", F.greatest(F.size(links), F.lit(0)))
    got = over_pages(linked, measured, f"prose int, rest int, ends double, words int, of_prose {block}, of_rest {block}", id, page, url, title, ["_links"])
    got = got.withColumn("links", 100 * F.col("_links") / F.greatest("words", F.lit(1))).drop("_links", "words")
    rows = materialise(got.withColumnRenamed(id, "_id"), "measured")
    size = F.floor(F.log2("b.n") * 4).cast("int").alias("size")
    # A block counts for its language and, where the script is Latin, for all languages of that script.
    kinds = F.when(F.col("b.l").startswith("script "), F.array("b.l")).otherwise(F.array_distinct(F.array("b.l", F.lit("latin"))))
    usual = rows.select(F.explode("of_prose").alias("b")).select(F.explode(kinds).alias("lang"), size, (F.col("b.z") / F.col("b.n")).alias("q"), F.try_divide("b.d", "b.w").alias("r"))
    # At most 45 sizes of nine Latin classes and each script.
    usual = materialise(usual.groupBy("lang", "size").agg(F.percentile_approx("q", 0.5, 10000).alias("dense"), F.percentile_approx("r", 0.5, 10000).alias("different")), "usual")
    latin = usual.where("lang = 'latin'").select("size", F.col("dense").alias("dense_latin"), F.col("different").alias("different_latin"))
    asked = rows.where(F.col("rest") > F.col("prose")).select("_id", "prose", "rest", "ends", "links", F.explode("of_rest").alias("b")).select("_id", "prose", "rest", "ends", "links", F.col("b.l").alias("lang"), "b", size)
    found = asked.join(F.broadcast(usual), ["lang", "size"], "left").join(F.broadcast(latin), "size", "left")
    of_latin = ~F.col("lang").startswith("script ")
    # A size that no sentences have counts as dense and as varied as long texts are.
    dense = F.coalesce(F.col("dense"), F.when(of_latin, F.col("dense_latin")), F.lit(0.45))
    different = F.coalesce(F.col("different"), F.when(of_latin, F.col("different_latin")), F.lit(0.5))
    of_bytes = F.sum("b.z") / F.sum(dense * F.col("b.n"))
    of_words = F.coalesce(F.try_divide(F.sum("b.d"), F.sum(different * F.col("b.w"))), F.lit(1.0))
    per_page = found.groupBy("_id", "prose", "rest", "ends", "links").agg(((of_bytes + of_words) / 2).alias("ratio"), of_bytes.alias("bytes"))
    bound = F.when(F.col("links") >= MANY_LINKS, F.greatest(F.lit(redundant), F.lit(REDUNDANT_LINKS))).otherwise(F.lit(redundant))
    stuffed = ((F.col("ratio") < bound) | (F.col("bytes") < EXTREME)) & (F.col("ends") < FEW_ENDS)
    judged = per_page.select(F.col("_id").alias(id), "prose", "rest", "ratio", "ends", "links", stuffed.alias("stuffed"))
    plain = rows.where(F.col("rest") <= F.col("prose")).select(F.col("_id").alias(id), "prose", "rest", F.lit(None).cast("double").alias("ratio"), "ends", "links", F.lit(False).alias("stuffed"))
    return judged.unionByName(plain)


def _crawl(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "crawl").select("fetch_id", "url", "title", "page", "urls"))


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(_crawl(spark, folder)).dropDuplicates(["fetch_id"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(_crawl(spark, folder)).where("stuffed").select("fetch_id").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_scores": p7_scores}
