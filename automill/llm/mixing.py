"""Mixing sources to target weights.

Word counts are summed by source, targets are shared out by weight under a cap, and each document is
emitted floor(rate) times plus one more copy with probability equal to the fraction. The copy is drawn
from a hash of the document's id and a seed. Of ``SEEDS`` seeds each source uses the one whose total
comes nearest to its target, so long documents do not throw a small source off.

Edge cases: null or empty text has size 0; a null source is a source of its own and comes last; a
source without words has target 0 and its documents are not emitted; with no words at all every
target is 0; equal ids draw alike, so repeated rows are repeated or left together; an empty table
gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.llm.scratch import keep
from automill.llm.text import WORD, filled, free_prefix

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Times its own size that a source's target may reach.
CAP = 3
#: Draws that are tried for each source.
SEEDS = 16
#: Sources that are broadcast at most.
BROADCAST_SOURCES = 100_000


def draw(id_col: str, seed: int | Column) -> Column:
    """A number in [0, 1) fixed by the id and the seed."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), seed))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target from (source, size) rows; one row per source.

    Ranks come from a range partitioning and the number of rows of each partition, so no task holds
    all sources. Targets are min(cap, level * weight); the level rises until the set of capped sources
    stays the same. Only sums come to the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = keep(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")), "mix-totals"
    )
    offset, offsets = 0, {}
    for row in sorted(ordered.groupBy("part").count().collect()):
        offsets[row["part"]] = offset
        offset += row["count"]
    before = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part")) if offsets else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + before
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ordered.select("source", "source_size", weight.alias("weight"))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        full = F.lit(CAP) * F.col("source_size") <= F.lit(level) * F.col("weight")
        held, left, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, CAP * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == capped or not left:
            break
        level, capped = (total - held) / left, n
    target = F.least((CAP * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' (id, source, size), and a table of the sources: source, source_size, target, rate, seed."""
    size = F.regexp_count(filled(text_col), F.lit(WORD)).cast("long")
    sized = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    targets = source_targets(sized)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = keep(targets.withColumn("rate", rate), "mix-targets")
    part = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(draw("id", s) < part, F.col("size")).otherwise(0)).alias(f"extra{s}") for s in range(SEEDS)]
    base = F.sum(F.col("size") * F.floor("rate")).alias("base")
    sums = attach(sized, rates).groupBy("source").agg(base, *extra)
    miss = [F.struct(F.abs(F.col("base") + F.col(f"extra{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]
    picked = rates.join(sums, rates["source"].eqNullSafe(sums["source"])).select(
        rates["source"], "source_size", "target", "rate", F.least(*miss)["seed"].alias("seed")
    )
    return sized, keep(picked, "mix-seeds")


def attach(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with their source's columns: broadcast while the sources are few, else a join that can split a hot source."""
    sources = rates.withColumnRenamed("source", "source__")
    if rates.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    return rows.join(sources, rows["source"].eqNullSafe(sources["source__"])).drop("source__")


def copies(id_col: str = "id") -> Column:
    """How often a row with rate and seed is emitted."""
    whole = F.floor("rate")
    return (whole + F.when(draw(id_col, F.col("seed")) < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target, copies and taken (size times copies)."""
    sized, rates = mix_plan(docs, id_col, text_col, source_col)
    out = attach(sized, rates).withColumn("copies", copies())
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every document as often as its source's rate says, with ``copy`` counting from 0.

    All columns of the documents stay, whatever they are called; where ``copy`` is one, the count's name begins with two or more underscores.
    """
    _, rates = mix_plan(docs, id_col, text_col, source_col)
    p = free_prefix(docs.columns)
    few = rates.count() <= BROADCAST_SOURCES
    sources = rates.select(*[F.col(c).alias(f"{p}{c}") for c in ("source", "rate", "seed")])
    rows = docs.join(F.broadcast(sources) if few else sources, docs[source_col].eqNullSafe(sources[f"{p}source"]))
    whole, rate = F.floor(f"{p}rate"), F.col(f"{p}rate")
    times = (whole + F.when(draw(id_col, F.col(f"{p}seed")) < rate - whole, 1).otherwise(0)).cast("int")
    rows = rows.withColumn(f"{p}times", times).where(F.col(f"{p}times") > 0)
    extra = "copy" if "copy" not in [c.lower() for c in docs.columns] else f"{p}copy"
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(f"{p}times") - 1)).alias(extra))
