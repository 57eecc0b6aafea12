"""Problem 9: a mix of sources with target shares of its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import grouped_prefix_sum, table, with_small
from tarnweave.llm.tokens import count_tokens
from tarnweave.session import materialise


def source_name(source: Column | str) -> Column:
    """A source's name without the blanks around it, in lower case; null for blank."""
    name = F.lower(F.regexp_replace(F.col(source) if isinstance(source, str) else source, r"^\s+|\s+$", ""))
    return F.nullif(name, F.lit(""))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: supply, budget, whole epochs and tokens of the last part.

    sizes: source, n_tokens. total: tokens of the mix; by default those of all rows, each once, whatever their source.
    budget = target_share * total. A source is used whole as often as its budget and max_repeats allow; the rest of the
    budget is cut from one more pass unless max_repeats is reached. One row a source; of a repeated source in targets
    the largest share and repeats hold, null shares and repeats count 0.
    """
    wanted = targets.select(source_name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    if total is None:
        total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    plan = wanted.join(per_source, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    plan = plan.withColumn("budget", F.col("target_share") * float(total))
    epochs = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.col("max_repeats"))).otherwise(0).cast("int")
    plan = plan.withColumn("epochs", epochs)
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.least(F.col("budget") - F.col("epochs") * F.col("supply"), F.col("supply").cast("double"))).otherwise(0.0)
    return plan.select("source", "target_share", "max_repeats", "supply", "budget", "epochs", rest.alias("rest"))


def mix_sources(sizes: DataFrame, targets: DataFrame, id: str = "doc_id", seed: int = 0, total: int | None = None, tolerance: float = 0.001) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """How often each document is used, and the report of the shares.

    sizes: id, source, n_tokens, a row for each document. Documents of a source come in the order of a hash of seed and
    id; the last, partial epoch takes them up to where their tokens, summed before each over all tasks, reach the rest of
    the budget. A document that would pass it is left out, so a source never exceeds its budget; where more than
    `tolerance` of the budget stays open, those behind it are cut again, as often as one of them fits. Documents of null or
    untargeted sources, and those without tokens beyond the whole epochs, are used as the rule says; null n_tokens is 0.

    Uses: id, source, n_tokens, uses (0 to max_repeats). Report: source, target_share, max_repeats, supply, budget,
    reached, actual_share (of what all sources reached), share_of_total (of the wanted total) and short.
    """
    key = F.xxhash64(F.lit(seed), F.col(id).cast("string"))
    rows = sizes.select(id, source_name("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = materialise(rows, "sizes")
    plan = materialise(budgets(rows, targets, total), "plan")
    targeted = with_small(rows, plan.select("source", "epochs", "rest", "max_repeats"), ["source"])
    ordered = grouped_prefix_sum(targeted.withColumn("_key", key), "source", ["_key", id], "n_tokens", "_before")
    fits = (F.col("_before") + F.col("n_tokens") <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    cut = materialise(ordered.select(id, "source", "n_tokens", "_key", "epochs", "max_repeats", "rest", fits.alias("_in")), "cut")
    while True:
        # What a document too long for the rest left open goes to those behind it, while that is more than the tolerance.
        taken = cut.groupBy("source").agg(F.sum(F.when(F.col("_in"), F.col("n_tokens")).otherwise(0)).alias("_taken"))
        left = plan.join(taken, "source").where(F.col("epochs") < F.col("max_repeats")).select("source", (F.col("rest") - F.col("_taken")).alias("_open"), "budget")
        left = materialise(left.where(F.col("_open") > tolerance * F.col("budget")).drop("budget"), "left")
        again = with_small(cut.where("not _in and n_tokens > 0"), left, ["source"]).where(F.col("n_tokens") <= F.col("_open"))
        again = materialise(again.select(id, "source", "n_tokens", "_key", "_open"), "again")
        if again.isEmpty():
            break
        more = grouped_prefix_sum(again, "source", ["_key", id], "n_tokens", "_before").where(F.col("_before") + F.col("n_tokens") <= F.col("_open"))
        more = materialise(more.select(id, "source", "_key", F.lit(True).alias("_more")), "more")
        cut = materialise(cut.join(more, [id, "source", "_key"], "left").withColumn("_in", F.col("_in") | F.coalesce("_more", F.lit(False))).drop("_more"), "cut")
    uses = cut.select(id, "source", "n_tokens", (F.col("epochs") + F.col("_in").cast("int")).alias("uses"))
    uses = materialise(uses, "uses")
    reached = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("reached"), F.min("uses").alias("least"))
    report = plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    # Short is what every document used as often as allowed has not filled.
    short = (F.col("reached") < F.col("budget")) & (F.coalesce("least", "max_repeats") >= F.col("max_repeats"))
    everything = uses.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] or 0
    report = report.select("source", "target_share", "max_repeats", "supply", "budget", "reached", F.try_divide("reached", F.lit(everything)).alias("actual_share"), (F.try_divide("reached", "budget") * F.col("target_share")).alias("share_of_total"), short.alias("short"))
    return uses, report


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), "text", ["doc_id", "source"])


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document of a targeted source is used."""
    return mix_sources(_sizes(spark, folder), table(spark, folder, "source_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_sizes(spark, folder), table(spark, folder, "source_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that stay below their target even when each document is used max_repeats times."""
    return p9_report(spark, folder).where("short").select("source")


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_uses": p9_uses, "p9_report": p9_report}
