"""Problem 1: how characteristic each term is of its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.llm.common import behind_host, table
from tarnweave.session import materialise

TERM = "[a-z0-9]+"
#: Scale of the length normalisation. Below 1, a term that stands once in a short record gains less against repeated ones.
C = 0.5


def terms(text: Column) -> Column:
    """Longest runs of a-z and digits after lower-casing; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def dfr_weight(tf: Column, length: Column, average: Column, frequency: Column, records: Column, c: float = C) -> Column:
    """Divergence from randomness: geometric model, Laplace after-effect, length-normalised term frequency.

    With tfn = tf * log2(1 + c * average / length) and mean = frequency / records, a term has
    log2(1 + mean) + tfn * log2((1 + mean) / mean) bits, of which the share 1 / (1 + tfn) is gained.
    """
    tfn = tf * F.log2(1 + c * average / length)
    mean = frequency / records
    return (F.log2(1 + mean) + tfn * F.log2((1 + mean) / mean)) / (1 + tfn)


def characteristic_terms(records: DataFrame, wanted: DataFrame, id: str, text: str, unit: str, least_units: int = 2, c: float = C) -> DataFrame:  # noqa: A002
    """id, term, tf, weight of every term of the wanted records that at least two units hold, against all records.

    records: id, text, unit; `unit` is what a term must be found with twice (the url). wanted: ids. Frequencies, lengths and
    the number of records are counted over all rows of `records`, each row once: give different records. Counts are
    pre-aggregated by term, so a term that every record holds is no hot key; whether two units hold it is told from the
    smallest and the largest of their 64-bit hashes. Null texts and units hold no terms; a record without any term counts
    for nothing. least_units may be 1 or 2.
    """
    rows = materialise(records.select(F.col(id).alias("id"), F.col(unit).alias("unit"), F.col(text).alias("text")), "records")
    found = rows.select(F.xxhash64("unit").alias("u"), F.explode(terms(F.col("text"))).alias("term"))
    counted = found.groupBy("term").agg(F.count("*").alias("frequency"), F.min("u").alias("u1"), F.max("u").alias("u2"))
    counted = materialise(counted, "vocabulary")
    sizes = rows.select(F.size(terms(F.col("text"))).alias("n")).where("n > 0").agg(F.count("*").alias("records"), F.avg("n").alias("average")).first()
    usable = counted.where(F.col("u1") < F.col("u2")) if least_units > 1 else counted
    asked = wanted.select(F.col(id).alias("id")).distinct()
    own = rows.join(asked, "id").select("id", terms(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    tf = own.select("id", "length", F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(usable.select("term", "frequency"), "term")
    weight = dfr_weight(F.col("tf"), F.col("length"), F.lit(sizes["average"] or 1.0), F.col("frequency"), F.lit(sizes["records"] or 1), c)
    return weighed.select(F.col("id").alias(id), "term", "tf", weight.alias("weight"))


def crawl_records(spark: SparkSession, folder: str) -> DataFrame:
    """fetch_id, url and text (page, and url behind host and port) of each fetch, once."""
    crawl = table(spark, folder, "crawl").select("fetch_id", "url", "page").groupBy("fetch_id").agg(F.first("url").alias("url"), F.first("page").alias("page"))
    return crawl.select("fetch_id", "url", F.concat_ws(" ", "page", behind_host("url")).alias("text"))


def p1_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Every weighed term of the probe pages."""
    return characteristic_terms(crawl_records(spark, folder), table(spark, folder, "probe_pages"), "fetch_id", "text", "url")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The n_terms most characteristic terms of each probe page; of equal weights the smaller term first."""
    asked = table(spark, folder, "probe_pages").groupBy("fetch_id").agg(F.max("n_terms").alias("n_terms"))
    order = Window.partitionBy("fetch_id").orderBy(F.round("weight", 9).desc(), "term")
    ranked = p1_weights(spark, folder).withColumn("place", F.row_number().over(order))
    return ranked.join(asked, "fetch_id").where(F.col("place") <= F.col("n_terms")).select("fetch_id", "term")


_WEIGHTS_SQL = rf"""
  records AS (SELECT fetch_id, url, string_agg(t, ' ') AS text FROM (SELECT DISTINCT fetch_id, url, page AS t FROM crawl UNION ALL SELECT DISTINCT fetch_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') FROM crawl) GROUP BY ALL),
  termed AS (SELECT fetch_id, url, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM records),
  found AS (SELECT fetch_id, url, len(terms) AS length, unnest(terms) AS term FROM termed),
  counted AS (SELECT term, count(*) AS frequency FROM found GROUP BY term HAVING count(DISTINCT url) >= 2),
  sizes AS (SELECT count(*) AS records, avg(len(terms)) AS average FROM termed WHERE len(terms) > 0),
  tf AS (SELECT fetch_id, term, length, count(*) AS tf FROM found WHERE fetch_id IN (SELECT fetch_id FROM probe_pages) GROUP BY ALL),
  normed AS (SELECT fetch_id, term, tf, tf * log2(1 + {C} * average / length) AS tfn, frequency / records AS mean FROM tf JOIN counted USING (term), sizes),
  weighed AS (SELECT fetch_id, term, tf, (log2(1 + mean) + tfn * log2((1 + mean) / mean)) / (1 + tfn) AS weight FROM normed)"""
SQL = {
    "p1_found": f"WITH {_WEIGHTS_SQL}, ranked AS (SELECT fetch_id, term, row_number() OVER (PARTITION BY fetch_id ORDER BY round(weight, 9) DESC, term) AS place FROM weighed) SELECT fetch_id, term FROM ranked JOIN (SELECT fetch_id, max(n_terms) AS n_terms FROM probe_pages GROUP BY fetch_id) USING (fetch_id) WHERE place <= n_terms",
}
QUERIES = {"p1_found": p1_found, "p1_weights": p1_weights}
