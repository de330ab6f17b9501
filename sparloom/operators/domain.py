"""One index over the entities of a domain and what they refer to, read by slice.

Entities of every kind have one schema, references too; a reference whose target is no entity is kept and marked. Both
are written by kind and swapped in together. A slice follows references either way from some entities, level by level,
over written frontiers. Survey rows: DOM-01, DOM-04, DOM-03.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as V
from .graph import hops


def build(entities: list[DataFrame], references: list[DataFrame], place: str) -> str:
    """Write the index of entities (kind, key, name, source) and references (from_kind, from_key, to_kind, to_key, why). An
    entity that several sources name counts once, by its first source in order; a reference counts once."""
    def united(parts: list[DataFrame], columns: list[str]) -> DataFrame:
        out = parts[0].select(columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(columns))
        return out

    def write(folder: str) -> None:
        spark = entities[0].sparkSession
        every = united(entities, ["kind", "key", "name", "source"]).where("key IS NOT NULL")
        once = every.groupBy("kind", "key").agg(F.min(F.struct("source", "name")).alias("e")).select("kind", "key", "e.name", "e.source")
        once.write.partitionBy("kind").parquet(f"{folder}/entities")
        known = spark.read.parquet(f"{folder}/entities").select(F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), F.lit(True).alias("found"))
        said = united(references, ["from_kind", "from_key", "to_kind", "to_key", "why"]).where("from_key IS NOT NULL AND to_key IS NOT NULL").distinct()
        marked = said.join(known, ["to_kind", "to_key"], "left").withColumn("resolved", F.coalesce("found", F.lit(False))).drop("found")
        marked.write.partitionBy("from_kind").parquet(f"{folder}/references")

    return V.publish(entities[0].sparkSession, place, write)


def summary(spark: SparkSession, place: str) -> DataFrame:
    """kind, entities, outgoing, unresolved, unreferenced: entities of each kind, their references, those to no entity,
    and entities that nothing refers to."""
    e, r = V.opened(spark, place, "entities"), V.opened(spark, place, "references")
    out = r.groupBy(F.col("from_kind").alias("kind")).agg(F.count("*").alias("outgoing"), F.count_if(~F.col("resolved")).alias("unresolved"))
    named = r.where("resolved").select(F.col("to_kind").alias("kind"), F.col("to_key").alias("key")).distinct()
    alone = e.join(named, ["kind", "key"], "left_anti").groupBy("kind").agg(F.count("*").alias("unreferenced"))
    whole = e.groupBy("kind").agg(F.count("*").alias("entities")).join(out, "kind", "left").join(alone, "kind", "left")
    return whole.na.fill(0)


def slice_of(spark: SparkSession, place: str, start: DataFrame, depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """kind, key, name, hops of the entities within depth references of start (kind, key), either way, start included.
    kinds: only references between these are followed."""
    e, r = V.opened(spark, place, "entities"), V.opened(spark, place, "references").where("resolved")
    if kinds is not None:
        r = r.where(F.col("from_kind").isin(kinds) & F.col("to_kind").isin(kinds))
    node = lambda kind, key: F.concat_ws("\n", kind, key)
    edges = r.select(node("from_kind", "from_key").alias("src"), node("to_kind", "to_key").alias("dst"))
    begin = start.join(e.select("kind", "key"), ["kind", "key"], "left_semi").select(node("kind", "key").alias("node"))
    found = hops(edges, begin, depth, directed=False)
    at = found.select(F.substring_index("node", "\n", 1).alias("kind"), F.expr("substring(node, instr(node, '\\n') + 1)").alias("key"), "hops")
    return at.join(e, ["kind", "key"]).select("kind", "key", "name", "hops")
