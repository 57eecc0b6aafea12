"""Problem 2: one ranking from scores of different scales, by the first principal component of their ranks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.functions.hashing import hash_key
from tarnweave.llm.common import codes_of, ranges_for, table, with_small
from tarnweave.llm.topn import _POSTINGS_SQL, top_n_per_group
from tarnweave.session import materialise
from tarnweave.sources.packed import NUMBER


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one partition sorted by group and value: how many rows of the group lie below each row's value and how many
    have it, within the partition, and whether the run of equal rows touches an end of the group's rows here.

    Batches are passed on as they come; only the last run of equal rows waits for the next batch, with the batches it
    spans, and the first run of a group is told by the number of the group's rows before it.
    """
    held: list[pa.RecordBatch] = []  # rows of one run, which may go on
    group, value, below = None, None, 0

    def run(some: list[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
        equal = sum(b.num_rows for b in some)
        for b in some:
            n = b.num_rows
            yield _with(b, np.full(n, below), np.full(n, equal), np.full(n, below == 0 or ends))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column, values = batch.column("_g"), batch.column("_v").to_numpy()
        codes = codes_of(column)
        new_group = np.concatenate([[True], codes[1:] != codes[:-1]])
        new_run = new_group | np.concatenate([[True], values[1:] != values[:-1]])
        starts = np.flatnonzero(new_run)
        at = 0
        if held:
            same_group = column[0].as_py() == group
            if same_group and values[0] == value:
                at = int(starts[1]) if len(starts) > 1 else n
                held.append(batch.slice(0, at))
                if at == n:
                    continue
                same_group = not new_group[at]
            yield from run(held, not same_group)
            below = below + sum(b.num_rows for b in held) if same_group else 0
            held = []
        last = int(starts[-1])
        if last > at:
            # Whole runs, of which the last row's may go on in the next batch.
            rows = np.arange(at, last)
            runs = starts[(starts >= at) & (starts < last)]
            of = np.searchsorted(runs, rows, side="right") - 1
            ends = np.append(runs[1:], last)
            groups = np.flatnonzero(new_group)
            group_start = np.where(groups[np.searchsorted(groups, rows, side="right") - 1] > at, groups[np.searchsorted(groups, rows, side="right") - 1], at - below)
            before = runs[of] - group_start
            closes = np.append(new_group, True)[ends[of]] & (ends[of] <= last)
            yield _with(batch.slice(at, last - at), before, (ends - runs)[of], (before == 0) | closes)
            below = 0 if new_group[last] and last > at else last - int(group_start[-1])
        elif at and last == at:
            below = 0 if new_group[last] else below
        held = [batch.slice(last)]
        group, value = column[last].as_py(), values[last]
    if held:
        yield from run(held, True)


def _with(batch: pa.RecordBatch, below: np.ndarray, equal: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    more = [pa.array(below.astype(np.int64)), pa.array(equal.astype(np.int64)), pa.array(edge.astype(bool))]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_below", "_equal", "_edge"])


def rank_transform(df: DataFrame, group: str, value: str, into: str) -> DataFrame:
    """Replace `value` by its mid-rank within its group, scaled to (0, 1): (rows below + half of the equal ones) / rows.

    Rows are range-partitioned by group, value and a hash, so that neither a large group nor a value that many rows share
    stays in one task, in as many ranges as their number asks for, and numbered where they lie, batch by batch. What lies
    before a partition's part of a group is added from the sizes of the parts; runs of equal rows over several partitions,
    of which there are fewer than partitions, are put together from their parts. One shuffle of the rows, which should be
    a written table. Values must not be null or NaN; null groups form one group.
    """
    rest = [c for c in df.columns if c not in (group, value)]
    rows = df.select(F.col(group).alias("_g"), (F.col(value).cast("double") + 0.0).alias("_v"), *rest).withColumn("_h", F.hash(*rest) if rest else F.lit(0))
    ranged = rows.repartitionByRange(ranges_for(df), F.col("_g"), F.col("_v"), F.col("_h")).drop("_h").withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_g", "_v")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = materialise(ranged.mapInArrow(_positions, f"{schema}, _below bigint, _equal bigint, _edge boolean"), "placed")
    key = F.struct(F.col("_g").alias("v")).alias("k")
    parts = placed.groupBy(key, "_range").agg(F.count("*").alias("rows"))
    # A group has at most one part for each partition.
    whole = Window.partitionBy("k")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(parts.select("k", "_range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("size")), "offsets")
    edges = placed.where("_edge").groupBy(key, "_v", "_range").agg(F.first("_below").alias("below"), F.count("*").alias("rows"))
    edges = edges.join(offsets.select("k", "_range", "before"), ["k", "_range"])
    spans = edges.groupBy("k", "_v").agg(F.count("*").alias("parts"), F.min(F.col("before") + F.col("below")).alias("all_below"), F.sum("rows").alias("all_equal")).where("parts > 1").drop("parts")
    spans = materialise(spans, "spans")
    joined = with_small(placed.withColumn("k", key), offsets, ["k", "_range"])
    joined = with_small(joined, spans, ["k", "_v"], "left")
    rank = (F.coalesce("all_below", F.col("before") + F.col("_below")) + F.coalesce("all_equal", "_equal") / 2) / F.col("size")
    return joined.select(F.col("_g").alias(group), rank.alias(into), *rest)


def correlations(df: DataFrame, columns: Mapping[str, int]) -> np.ndarray:
    """The correlation matrix of columns turned to their declared directions, from one aggregate of sums and products.

    A column without spread, or an empty table, has no correlation: it counts as uncorrelated with the others.
    """
    names = list(columns)
    turned = [F.col(c) * (1 if way >= 0 else -1) for c, way in columns.items()]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.covar_pop(turned[i], turned[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    matrix = np.eye(len(names))
    for i, j in pairs:
        spread = (row[f"c{i}_{i}"] or 0.0) * (row[f"c{j}_{j}"] or 0.0)
        if i < j and spread > 0:
            matrix[i, j] = matrix[j, i] = (row[f"c{i}_{j}"] or 0.0) / np.sqrt(spread)
    return matrix


def first_component(matrix: np.ndarray) -> np.ndarray | None:
    """The first principal component of columns turned to their directions, with the sign that agrees with most of them.

    None where it sets a column against its direction or leaves it out: then the columns have no ranking in common. Of
    equal components the even one is taken.
    """
    values, vectors = np.linalg.eigh(matrix)
    even = np.ones(len(matrix)) / np.sqrt(len(matrix))
    top = vectors[:, values >= values[-1] - 1e-12]
    first = top @ (top.T @ even) if top.shape[1] > 1 else vectors[:, -1] * (1 if vectors[:, -1].sum() >= 0 else -1)
    size = np.linalg.norm(first)
    return first / size if size > 1e-9 and np.all(first > 1e-9) else None


def principal_loadings(df: DataFrame, columns: Mapping[str, int]) -> dict[str, float]:
    """Loadings of the first principal component of the columns' correlation matrix, signs turned to the directions.

    Columns are turned to their declared directions first, and the component as a whole is given the sign that agrees.
    Where it still sets a column against its direction (scores that contradict each other have no common ranking along
    it), all columns weigh the same.
    """
    first = first_component(correlations(df, columns))
    if first is None:
        first = np.ones(len(columns)) / np.sqrt(len(columns))
    return {name: float(size * (1 if way >= 0 else -1)) for (name, way), size in zip(columns.items(), first, strict=True)}


def ranked_scores(df: DataFrame, group: str, id: str, columns: Mapping[str, int]) -> DataFrame:  # noqa: A002
    """g, i and r0, r1, …: the group, the id and the mid-rank of each score within the group, as a written table."""
    rows = materialise(df.select(F.col(group).alias("g"), F.col(id).alias("i"), *(F.col(name).cast("double").alias(f"v{k}") for k, name in enumerate(columns))), "scores")
    for k in range(len(columns)):
        rows = materialise(rank_transform(rows, "g", f"v{k}", f"r{k}"), "ranks")
    return rows


def combined_ranking(df: DataFrame, group: str, id: str, columns: Mapping[str, int]) -> DataFrame:  # noqa: A002
    """Order the items of each group by one score made from several of any scale.

    columns: name of a score -> 1 if more is better, -1 if less is. Each is replaced by its mid-rank within the group,
    the loadings of the first principal component of those ranks over all rows weigh them, and the projection orders.
    Rows without a finite value in each score, or without id, are left out; a repeated (group, id) should be merged
    before. Ties are equal projections. Columns: group, id, projection. Null groups form one group. The id travels with
    the rows: a short one keeps shuffles small.
    """
    finite = F.col(id).isNotNull()
    for name in columns:
        finite &= F.coalesce(F.abs(F.col(name).cast("double")) < float("inf"), F.lit(False))
    rows = ranked_scores(df.where(finite), group, id, columns)
    loadings = principal_loadings(rows, {f"r{k}": way for k, way in enumerate(columns.values())})
    projection = sum((F.col(c) - 0.5) * w for c, w in loadings.items())
    # Rounded, so that items of equal say tie whatever the order of a sum.
    return rows.select(F.col("g").alias(group), F.col("i").alias(id), (F.round(projection, 9) + 0.0).alias("projection"))


def _located(scores: DataFrame) -> DataFrame:
    """Postings with a finite score and where they stand: word, url, score, saved_at, at (put_id and place in the value)."""
    places = F.posexplode(F.split("value", ";")).alias("place", "part")
    cut = scores.where("word is not null and value is not null").select("word", "saved_at", "put_id", places).where(F.col("part").contains(","))
    number = F.trim(F.substring_index("part", ",", -1))
    url = F.trim(F.expr("substring(part, 1, length(part) - length(substring_index(part, ',', -1)) - 1)"))
    rows = cut.select("word", url.alias("url"), F.when(number.rlike(NUMBER), number.try_cast("double")).alias("score"), "saved_at", F.struct("put_id", "place").alias("at"))
    return rows.where((F.abs("score") < float("inf")) & (F.col("url") != ""))


def _key_hashes(key) -> list:
    return [F.xxhash64(key).alias("k1"), F.hash(key).alias("k2")]


def rated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """word, at, score, rank of each page found for a word that has a rank; of a key's ranks the latest holds.

    `at` tells the posting that holds for word and url: the last saved, then of the larger put_id, then of the higher
    score. Urls and keys are compared by 160 bits of hashes and do not travel.
    """
    ranks = table(spark, folder, "pageranks").where("key is not null").groupBy("key").agg(F.max_by("rank", F.struct("saved_at", "rank")).alias("rank"))
    ranks = ranks.where(F.abs("rank") < float("inf")).select(*_key_hashes("key"), "rank")
    found = _located(table(spark, folder, "combinedscores")).select("word", "score", "saved_at", "at", F.xxhash64("url").alias("u"), hash_key("url").alias("key"))
    found = found.select("word", "score", "saved_at", "at", "u", *_key_hashes("key"))
    last = F.max(F.struct("saved_at", F.col("at.put_id").alias("put_id"), "score", "at")).alias("l")
    held = found.groupBy("word", "u", "k1", "k2").agg(last).select("word", "k1", "k2", F.col("l.score").alias("score"), F.col("l.at").alias("at"))
    return held.join(ranks, ["k1", "k2"]).select("word", "at", "score", "rank")


def _with_urls(spark: SparkSession, folder: str, ranked: DataFrame) -> DataFrame:
    """word, url, projection for word, at, projection. A row that was delivered twice is one place."""
    places = _located(table(spark, folder, "combinedscores")).select("word", "at", "url")
    return ranked.join(places, ["word", "at"]).select("word", "url", "projection").distinct()


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The combined score of every page of every word; the highest come first."""
    ranked = combined_ranking(rated_pages(spark, folder), "word", "at", {"score": 1, "rank": 1})
    return _with_urls(spark, folder, ranked)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The n_best first pages of each judged word, of the ranking of all words."""
    judged = table(spark, folder, "judged_words").where("word is not null").groupBy("word").agg(F.max("n_best").alias("n_best"))
    ranked = combined_ranking(rated_pages(spark, folder), "word", "at", {"score": 1, "rank": 1})
    asked = _with_urls(spark, folder, ranked.join(judged.select("word"), "word", "left_semi")).join(judged, "word")
    return top_n_per_group(asked, "word", "projection", "url", "n_best", unique=True).select("word", "url")


def p2_loadings(spark: SparkSession, folder: str) -> DataFrame:
    """score, correlation of the two scores' ranks, whether the first component ranks by both, and the loading of each."""
    ranks = ranked_scores(rated_pages(spark, folder), "word", "at", {"score": 1, "rank": 1})
    matrix = correlations(ranks, {"r0": 1, "r1": 1})
    loadings = principal_loadings(ranks, {"r0": 1, "r1": 1})
    rows = [(name, float(matrix[0, 1]), first_component(matrix) is not None, loading) for name, loading in zip(("score", "rank"), loadings.values(), strict=True)]
    made = spark.createDataFrame(rows, "score string, correlation double, common boolean, loading double")
    return made.select("score", (F.round("correlation", 6) + 0.0).alias("correlation"), "common", F.round("loading", 6).alias("loading"))


_RANKED_SQL = rf"""
latest AS (SELECT key, rank FROM pageranks WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY saved_at DESC NULLS LAST, rank DESC NULLS LAST) = 1),
{_POSTINGS_SQL},
digests AS (SELECT word, url, score, sha1(url) AS h FROM postings),
bytes AS (SELECT word, url, score, list_transform(range(20), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT) AS b FROM digests),
keyed AS (SELECT word, url, score, list_aggregate(list_transform(b, lambda x: (CASE WHEN x = 0 THEN 255 WHEN x < 128 THEN x ELSE x - 1 END)), 'list') AS v FROM bytes),
named AS (SELECT word, url, score, array_to_string(list_transform(v, lambda x: chr((97 + x % 26)::INT) || substr('acegikmoqs', (x // 26 + 1)::INT, 1)), '') AS key FROM keyed),
rated AS (SELECT word, url, score, rank FROM named JOIN latest USING (key) WHERE isfinite(rank)),
ranked AS (
  SELECT word, url, (rank() OVER (PARTITION BY word ORDER BY score) - 1 + count(*) OVER (PARTITION BY word, score) / 2.0) / count(*) OVER (PARTITION BY word) AS a,
    (rank() OVER (PARTITION BY word ORDER BY rank) - 1 + count(*) OVER (PARTITION BY word, rank) / 2.0) / count(*) OVER (PARTITION BY word) AS b
  FROM rated),
projected AS (SELECT word, url, round((a - 0.5 + b - 0.5) / sqrt(2), 9) + 0.0 AS projection FROM ranked)"""

SQL = {
    "p2_found": f"WITH {_RANKED_SQL} SELECT word, url FROM projected JOIN (SELECT word, max(n_best) AS n_best FROM judged_words WHERE word IS NOT NULL GROUP BY word) USING (word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY projection DESC, url) <= n_best",
    # Of two columns the first component is (1, 1) where they correlate positively, else (1, -1), which sets one against its direction.
    "p2_loadings": f"WITH {_RANKED_SQL}, c AS (SELECT coalesce(corr(a, b), 0) AS r FROM ranked) SELECT score, round(r, 6) + 0.0 AS correlation, r >= -1e-12 AS common, round(1 / sqrt(2), 6) AS loading FROM c, (VALUES ('score'), ('rank')) AS names(score)",
    "p2_ranking": f"WITH {_RANKED_SQL} SELECT word, url, projection FROM projected",
}
QUERIES = {"p2_found": p2_found, "p2_loadings": p2_loadings, "p2_ranking": p2_ranking}
