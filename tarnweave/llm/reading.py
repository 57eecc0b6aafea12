"""Problem 10: reading level of a text by regularised ordinal regression, calibrated to graded texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import table
from tarnweave.session import materialise

#: So many of the commonest words are broadcast with their counts; those of rarer ones are joined.
VOCABULARY = 20_000
#: Graded documents that the regression is fitted on at most: those with the smallest hash of their id.
MOST_GRADED = 5_000
#: Shorter texts have no level.
LEAST_WORDS = 40
#: Strength of the penalty on the squared weights.
PENALTY = 1e-2

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_END = re.compile(r"[.!?]+(?=[\s”\"’')]|$)")
#: Function words by which languages are told apart; those of other languages stand for Latin scripts alone.
ENGLISH = frozenset("the of and to is was that which with for from they it its this by are has had been but not as we were have their there when would could these those who what than then them his her she he you your if or an be at".split())
OTHERS = {
    "de": frozenset("der die das und ist nicht ein eine einen einem dem den des mit von zu auf für sich auch als wie oder aber wenn weil jeder jede kein keine während obwohl wird wurde sind".split()),
    "fr": frozenset("le la les et est pas un une des du de que qui dans pour sur avec ce cette ces il elle nous vous mais ou où son sa ses chaque parce aux au par plus".split()),
    "es": frozenset("el la los las y es no un una de que en por para con su sus se lo como pero más al del este esta cada porque cuando aunque ningún".split()),
    "it": frozenset("il lo la gli le e è non un una di che in per con su si come ma più al del della questo questa ogni perché quando anche sono".split()),
    "pt": frozenset("o os as e é não um uma de que em por para com seu sua se como mas mais ao do da este esta cada porque quando".split()),
    "nl": frozenset("de het een en is niet van dat die in te op voor met zijn er maar om ook als aan door elke omdat wanneer".split()),
}
CONNECTIVES = frozenset("because although though whereas while however therefore consequently moreover furthermore nevertheless notwithstanding insofar unless since thus hence provided despite accordingly likewise conversely".split())
SUBORDINATE = frozenset("that which who whose whom because although though whereas while when where if unless since before after until how why whether insofar notwithstanding according compared including".split())
FEATURES = ("word_length", "long_words", "very_long_words", "sentence_length", "diversity", "rarity", "connectives", "clause_depth", "commas", "plain_quarter")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_english(words: list[str]) -> bool:
    """Whether English function words are frequent, and more so than those of any other language."""
    if not words:
        return False
    counts = Counter(words)
    share = {k: sum(counts[w] for w in v) for k, v in {"en": ENGLISH, **OTHERS}.items()}
    return share["en"] >= 0.12 * len(words) and all(share["en"] > v for k, v in share.items() if k != "en")


def text_features(text: str, words: list[str], bits: dict[str, float], rarest: float) -> list[float]:
    """The features of a text of at least one word, all of about the same spread, none of them growing with its length."""
    n = len(words)
    sentences = max(1, len(_END.findall(text)))
    lengths = [len(w) for w in words]
    # Pieces of 50 words; the last one ends with the text, so that every word is in one and all are of one size.
    pieces = [words[k : k + 50] for k in [*range(0, max(0, n - 50), 50), max(0, n - 50)]]
    per_piece = [sum(len(w) for w in p) / len(p) for p in pieces]
    return [
        sum(lengths) / n,
        sum(k >= 7 for k in lengths) / n * 5,
        sum(k >= 11 for k in lengths) / n * 10,
        math.log(n / sentences),
        sum(len(set(p)) / len(p) for p in pieces) / len(pieces) * 5,
        sum([bits.get(w, rarest) for w in words]) / n / 2,
        math.log1p(sum(w in CONNECTIVES for w in words) / sentences),
        math.log1p(sum(w in SUBORDINATE for w in words) / sentences),
        math.log1p(text.count(",") / sentences),
        sorted(per_piece)[len(per_piece) // 4],
    ]


class OrdinalRegression:
    """Proportional odds with a squared penalty: P(grade > k) = sigmoid(w x - c_k), the cuts c_k rising."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 1500) -> None:
        self.grades = np.unique(y)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.spread
        above = (y[:, None] > self.grades[None, :-1]).astype(float)
        w, first, gaps = np.zeros(x.shape[1]), -1.0, np.zeros(max(0, len(self.grades) - 2))
        p = np.concatenate([w, [first], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        d = x.shape[1]
        # Each grade weighs the same, however many texts have it.
        weight = np.array([1 / max(1, (y == g).sum()) for g in self.grades])[np.searchsorted(self.grades, y)]
        weight /= weight.sum()
        for t in range(1, steps + 1):
            cuts = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))[: len(self.grades) - 1]
            s = 1 / (1 + np.exp(-np.clip((z @ p[:d])[:, None] - cuts[None, :], -30, 30)))
            error = (s - above) * weight[:, None]
            grad_cut = -error.sum(0)
            tail = np.cumsum(grad_cut[::-1])[::-1] if len(grad_cut) else grad_cut
            grad = np.concatenate([z.T @ error.sum(1) + penalty * p[:d], tail[:1] if len(tail) else [0.0], (tail[1:] * np.exp(p[d + 1 :])) if len(tail) > 1 else []])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights = p[:d]
        self.cuts = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))[: len(self.grades) - 1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def grade(self, score: np.ndarray) -> np.ndarray:
        """The grade whose bounds the score lies in."""
        return self.grades[np.searchsorted(self.cuts, score)]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word and n, its number in all documents, for every word, from counts that each batch sums up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(words_of(t))
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def measured(docs: DataFrame, id: str, text: str) -> DataFrame:  # noqa: A002
    """_id and x, the features of each document's text; null for texts without level.

    The bits of the VOCABULARY commonest words are broadcast and summed on the spot. All others are counted within their
    document, joined with the table of all counts, and their bits summed by document, so each word has its own.
    """
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, text), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    common = [(r["word"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY).collect()]
    known = spark.sparkContext.broadcast({w: -math.log2(n / total) for w, n in common})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            rows, others, lengths = [], [], []
            for t in batch.column("_text").to_pylist():
                words = words_of(t) if t else []
                fit = len(words) >= LEAST_WORDS and is_english(words)
                rows.append(text_features(t, words, bits, 0.0) if fit else None)
                others.append(list(Counter(w for w in words if w not in bits).items()) if fit else [])
                lengths.append(len(words))
            columns = [batch.column("_id"), pa.array(rows, pa.list_(pa.float64())), pa.array(others, pa.map_(pa.string(), pa.int32())), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "x", "_others", "_words"])

    kind = dict(docs.select(F.col(id).alias("_id")).dtypes)["_id"]
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, x array<double>, _others map<string, int>, _words int")
    if len(common) < VOCABULARY:
        return materialise(rows.select("_id", "x"), "measured")
    # Documents may come twice, so rows are told apart by a number that the written table keeps.
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "measured")
    pairs = rows.select("_row", F.explode("_others").alias("word", "k")).join(counts, "word")
    added = pairs.groupBy("_row").agg(F.sum(-F.col("k") * F.log2(F.col("n") / F.lit(float(total)))).alias("_bits"))
    at = FEATURES.index("rarity")
    more = F.coalesce("_bits", F.lit(0.0)) / F.col("_words") / 2
    x = F.transform("x", lambda v, k: F.when(k == at, v + more).otherwise(v))
    return materialise(rows.join(added, "_row", "left").select("_id", x.alias("x")), "measured")


def reading_levels(docs: DataFrame, graded: DataFrame, id: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:  # noqa: A002
    """id, level (a grade as in `graded`) and score (finer, unbounded) of each document; null where there is none.

    A proportional-odds regression with a squared penalty is fitted on the graded documents' features: length of words,
    share of long ones, sentence length, lexical diversity of pieces of 50 words, mean rarity of the words in the whole
    collection, connectives and subordinating words a sentence. Each document then gets its score and the grade whose
    bounds hold it. Word counts cover all words of all documents; the table of the commonest, the model, and at most
    MOST_GRADED graded rows reach the driver. Texts that are not English, whatever is said of them, or of fewer than 40
    words, null or empty texts have no level. Repeated rows give repeated results. Without two grades among usable texts
    none has one.
    """
    spark = docs.sparkSession
    features = measured(docs, id, text)
    labels = graded.where(F.col(id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(grade).alias("_grade"))
    labels = labels.orderBy(F.xxhash64("_id"), "_id").limit(MOST_GRADED)
    rows = features.join(labels, "_id").where("x is not null").select("x", "_grade").collect()
    grades = {r["_grade"] for r in rows}
    model = OrdinalRegression(np.array([r["x"] for r in rows]), np.array([r["_grade"] for r in rows])) if len(grades) > 1 else None
    shared = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = batch.column("x").to_pylist()
            at = [k for k, r in enumerate(found) if r is not None and m is not None]
            score: list[float | None] = [None] * len(found)
            level: list[int | None] = [None] * len(found)
            if at:
                got = m.score(np.array([found[k] for k in at]))
                for k, s, g in zip(at, got.tolist(), m.grade(got).tolist(), strict=True):
                    score[k], level[k] = s, int(g)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(level, pa.int32()), pa.array(score, pa.float64())], ["_id", "level", "score"])

    kind = dict(features.dtypes)["_id"]
    return features.mapInArrow(judged, f"_id {kind}, level int, score double").withColumnRenamed("_id", id)


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level and score of every document."""
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "graded_docs"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_levels(spark, folder).where("level = 4").select("doc_id")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents have each level; null for those without."""
    return p10_levels(spark, folder).groupBy("level").agg(F.count("*").alias("documents"))


SQL: dict[str, str] = {}
QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile}
