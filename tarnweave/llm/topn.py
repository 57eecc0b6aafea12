"""Problem 5: the N best items of every group, by simultaneous bisection of the groups' cutoffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import table, with_small
from tarnweave.session import materialise
from tarnweave.sources.packed import latest_scores as postings

#: A pass counts rows above this many midpoints of each open group at once: as many as ten halvings.
BUCKETS = 1024


def _letters(id_: Column, skip: Column) -> Column:
    """Six bytes of the id behind `skip` ones as a number that keeps their order; the end of the id comes first."""
    raw = F.encode(id_, "UTF-8")
    size, total = F.octet_length(id_), F.lit(0).cast("bigint")
    for k in range(6):
        byte = F.ascii(F.decode(F.substring(raw, skip + 1 + k, F.lit(1)), "ISO-8859-1"))
        total = total * 512 + F.when(skip + k < size, byte + 1).otherwise(0)
    return -total.cast("double")


def _common(a: Column, b: Column) -> Column:
    """How many leading bytes two ids share."""
    x, y = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")
    upto = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))


def top_n_per_group(df: DataFrame, group: str, score: str, id: str, n: int | str, unique: bool = False) -> DataFrame:  # noqa: A002
    """The n rows of each group with the highest score, of equal scores those with the smaller id (bytes of UTF-8).

    Every group keeps an interval that holds its n-th row. A pass counts the rows of all open groups in 1024 equal parts
    of their intervals (pre-aggregated), takes the parts above the cutoff, drops those below it and goes on with the one
    part that holds it, until a group holds exactly n. The code that is cut is the score's signed logarithm, then the
    score, then the id, six bytes behind what the open rows share; so ties end too. Rows leave after one pass or two, no
    group is ever in one task, and what a pass leaves is written to the shared folder.

    n is a number, or the name of a column with each group's own (its largest value holds, null is 0).
    Null or non-finite scores and null ids never count; a null group is a group. A repeated (group, id) counts once,
    with its highest score; `unique` says there is none. Columns: group, id, score. Any other column is left out.
    An empty table, and n < 1, give no row.
    """
    # A struct as key lets null groups meet in joins.
    rows = df.select(F.struct(F.col(group).alias("v")).alias("g"), F.col(id).cast("string").alias("i"), F.col(score).cast("double").alias("s"), (F.col(n) if isinstance(n, str) else F.lit(n)).cast("bigint").alias("n"))
    rows = rows.where(F.col("i").isNotNull() & (F.abs("s") < float("inf")))
    if not unique:
        rows = rows.groupBy("g", "i").agg(F.max("s").alias("s"), F.max("n").alias("n"))
    rows = rows.withColumn("s", F.col("s") + 0.0)  # no negative zero
    base = materialise(rows.withColumn("c", F.signum("s") * F.log1p(F.abs("s"))), "topn")
    on = ["g"]
    stats = base.groupBy(*on).agg(F.coalesce(F.max("n"), F.lit(0)).alias("need"), F.count("*").alias("count"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    state = materialise(stats, "state")
    small = with_small(base, state.where("need > 0"), on)
    taken = [small.where("count <= need").select(*on, "i", "s")]
    open_ = small.where("count > need").select(*on, "i", "s", "c", F.lit(0).alias("level"), F.lit(0).alias("skip"), "lo", "hi", "need")
    level, lo, hi = (F.col(k) for k in ("level", "lo", "hi"))
    deep = False  # whether an open group is cut by its ids
    while True:
        at = F.when(level == 0, F.col("c")).otherwise(F.col("s"))
        if deep:
            at = F.when(level == 2, _letters(F.col("i"), F.col("skip"))).otherwise(at)
        # Halves, so that the width of an interval can't overflow; every step keeps the order of the rows.
        share = (hi * 0.5 - F.col("at") * 0.5) / (hi * 0.5 - lo * 0.5)
        part = F.when(hi == lo, 0).when(hi * 0.5 == lo * 0.5, F.when(F.col("at") == hi, 0).otherwise(BUCKETS - 1)).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        cut = open_.withColumn("at", at).withColumn("part", part.cast("int"))
        counted = cut.groupBy(*on, "part").agg(F.count("*").alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("s").alias("smin"), F.max("s").alias("smax"), F.max("level").alias("was"), F.max("need").alias("wanted"))
        upto = Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        found = counted.withColumn("sum", F.sum("rows").over(upto)).where((F.col("sum") >= F.col("wanted")) & (F.col("sum") - F.col("rows") < F.col("wanted")))
        # The part with the n-th row: its rows are all taken, or it is cut again, by the next level once its numbers are equal.
        same, was = F.col("low") == F.col("high"), F.col("was")
        then = F.when(~same, was).when((was == 0) & (F.col("smin") < F.col("smax")), 1).otherwise(2)
        fresh = same & (then == 2)
        whole = F.col("sum") == F.col("wanted")
        decided = found.select(*on, F.col("part").alias("edge"), whole.alias("whole"), (F.col("wanted") - F.col("sum") + F.col("rows")).alias("left"), then.alias("then"), fresh.alias("fresh"), F.when(then == 1, F.col("smin")).otherwise(F.col("low")).alias("new_lo"), F.when(then == 1, F.col("smax")).otherwise(F.col("high")).alias("new_hi"))
        decided = materialise(decided, "cutoffs")
        going = ~F.col("whole")
        seen = decided.agg(F.count("*").alias("groups"), F.max(going).alias("more"), F.max(going & (F.col("then") == 2)).alias("deep"), F.max(going & F.col("fresh")).alias("fresh")).first()
        if not seen["groups"]:
            break
        step = with_small(cut, decided, on).where(F.col("part") <= F.col("edge"))
        step = step.select(*on, "i", "s", "c", ((F.col("part") < F.col("edge")) | F.col("whole")).alias("in"), F.col("then").alias("level"), "skip", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("left").alias("need"), "fresh")
        step = materialise(step, "cut")
        taken.append(step.where("in").select(*on, "i", "s"))
        if not seen["more"]:
            break
        open_, deep = step.where("not in").drop("in"), seen["deep"]
        if seen["fresh"]:
            # Rows of equal numbers so far: cut by the ids from where their least and greatest differ.
            ends = open_.where("fresh").groupBy(*on).agg(F.min("i").alias("imin"), F.max("i").alias("imax"))
            ends = ends.select(*on, "imin", "imax", _common(F.col("imin"), F.col("imax")).alias("new_skip"))
            ends = materialise(ends.select(*on, "new_skip", _letters(F.col("imax"), F.col("new_skip")).alias("id_lo"), _letters(F.col("imin"), F.col("new_skip")).alias("id_hi")), "ends")
            joined = with_small(open_, ends, on, "left")
            open_ = joined.select(*on, "i", "s", "c", "level", F.coalesce("new_skip", "skip").alias("skip"), F.coalesce("id_lo", "lo").alias("lo"), F.coalesce("id_hi", "hi").alias("hi"), "need")
        else:
            open_ = open_.drop("fresh")
    best = reduce(DataFrame.unionAll, taken)
    return best.select(F.col("g.v").alias(group), F.col("i").alias(id), F.col("s").alias(score))


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five best pages of each word with their scores."""
    return top_n_per_group(postings(table(spark, folder, "combinedscores")), "word", "score", "url", 5, unique=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top(spark, folder).select("word", "url")


_POSTINGS_SQL = r"""
postings AS (
  SELECT word, url, score FROM (
    SELECT word, trim(regexp_extract(part, '^(.*),[^,]*$', 1, 's')) AS url, TRY_CAST(trim(regexp_extract(part, ',([^,]*)$', 1, 's')) AS DOUBLE) AS score, saved_at, put_id
    FROM (SELECT word, saved_at, put_id, unnest(string_split(value, ';')) AS part FROM combinedscores WHERE word IS NOT NULL AND value IS NOT NULL)
    WHERE contains(part, ','))
  WHERE score IS NOT NULL AND isfinite(score) AND url <> ''
  QUALIFY row_number() OVER (PARTITION BY word, url ORDER BY saved_at DESC NULLS LAST, put_id DESC NULLS LAST, score DESC) = 1)"""

SQL = {
    "p5_found": f"WITH {_POSTINGS_SQL} SELECT word, url FROM postings QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, url) <= 5",
    "p5_top": f"WITH {_POSTINGS_SQL} SELECT word, url, score FROM postings QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, url) <= 5",
}
QUERIES = {"p5_found": p5_found, "p5_top": p5_top}
