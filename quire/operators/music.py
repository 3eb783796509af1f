"""Sanity warnings over semantic music strings, by window functions over exploded events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import music


def warnings(parts: DataFrame, system: str = "system", part: str = "part", semantic: str = "semantic") -> DataFrame:
    """system, part, measure, kind, detail.

    overfull_bar: more ticks than the time signature allows at a barline, unless the measure already has an
    impossible_duration (one event longer than a measure; the first counts). underfull_bar: fewer, save for
    the first measure, the last such measure of a part, and empty ones. key_mismatch: parts of a system whose
    first key differs from the commonest (greatest on ties), measure 0. Measures count barlines, empty ones too.
    """
    events = parts.select(F.col(system).alias("system"), F.col(part).alias("part"), F.posexplode(F.split(F.col(semantic), r"\+")).alias("ord", "event")).where("event <> ''")
    line = Window.partitionBy("system", "part").orderBy("ord")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    bar = F.col("event") == "barline"
    timed = F.startswith("event", F.lit("timeSignature-"))
    signature = F.when(timed, F.struct(music.bar_ticks(F.regexp_replace("event", "^timeSignature-", "")).alias("ticks")))
    counted = F.when(~bar & ~timed & ~F.col("event").rlike("^(keySignature|clef|multirest)-"), music.event_ticks(F.col("event")))
    placed = events.withColumns(
        {
            "measure": F.sum(F.when(bar, 1).otherwise(0)).over(so_far) - F.when(bar, 1).otherwise(0) + 1,
            "expected": F.last(signature, ignorenulls=True).over(so_far)["ticks"],
            "ticks": counted,
        }
    )
    placed = placed.withColumn("long", F.coalesce(F.col("ticks") > F.col("expected"), F.lit(False)))
    measures = placed.groupBy("system", "part", "measure").agg(
        F.sum(F.coalesce("ticks", F.lit(0))).alias("total"),
        F.max(F.struct("ord", "event", "expected")).alias("end"),
        F.min(F.when(F.col("long"), F.struct("ord", "ticks", "expected"))).alias("first_long"),
    )
    closed = (F.col("end.event") == "barline") & F.col("end.expected").isNotNull()
    says = lambda n, of, what: F.concat(n.cast("string"), F.lit(f"{what} in a "), of.cast("string"), F.lit("-tick measure"))
    keep = ("system", "part", F.col("measure").cast("int").alias("measure"))
    longs = measures.where("first_long IS NOT NULL").select(*keep, F.lit("impossible_duration").alias("kind"), says(F.col("first_long.ticks"), F.col("first_long.expected"), "-tick note").alias("detail"))
    over = measures.where(closed & F.col("first_long").isNull() & (F.col("total") > F.col("end.expected"))).select(*keep, F.lit("overfull_bar").alias("kind"), says(F.col("total"), F.col("end.expected"), " ticks").alias("detail"))
    last = placed.groupBy("system", "part").agg(F.max_by("expected", "ord").alias("final"))
    under = measures.where(closed & (F.col("total") > 0) & (F.col("total") < F.col("end.expected")) & (F.col("measure") > 1))
    later = Window.partitionBy("system", "part").orderBy(F.col("measure").desc())
    under = under.withColumn("nth", F.row_number().over(later)).where("nth > 1").join(last, ["system", "part"])
    under = under.select(*keep, F.lit("underfull_bar").alias("kind"), says(F.col("total"), F.coalesce("final", F.lit(0)), " ticks").alias("detail"))
    keys = events.where(F.startswith("event", F.lit("keySignature-"))).groupBy("system", "part").agg(F.min_by(F.regexp_replace("event", "^keySignature-", ""), "ord").alias("key"))
    votes = keys.groupBy("system", "key").agg(F.count("*").alias("n")).groupBy("system").agg(F.max_by("key", F.struct("n", "key")).alias("majority"))
    odd = keys.join(votes, "system").where("key <> majority")
    text = F.concat(F.lit("staff reads keySignature-"), F.col("key"), F.lit(" while the system majority is keySignature-"), F.col("majority"))
    odd = odd.select("system", "part", F.lit(0).alias("measure"), F.lit("key_mismatch").alias("kind"), text.alias("detail"))
    return longs.unionByName(over).unionByName(under).unionByName(odd)
