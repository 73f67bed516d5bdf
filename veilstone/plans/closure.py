"""What a root needs, directly or through others, and whether its licences may be combined."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.runtime import cut


def closure(needs: DataFrame, root: str) -> DataFrame:
    """``(name)`` of all that ``root`` needs by ``needs(name, requires)``, without itself; each once, cycles included.

    Each round joins what the one before found with what it requires and leaves out what is known; there are as many rounds as
    the longest chain of requirements.
    """
    edges = needs.where("name is not null and requires is not null").select("name", "requires").distinct()
    found = edges.where(F.col("name") == root).select(F.col("requires").alias("name")).distinct()
    reached = found
    while not found.isEmpty():
        found = cut(found.join(edges, "name").select(F.col("requires").alias("name")).distinct().join(reached, "name", "left_anti"))
        reached = reached.unionByName(found)
    return reached.where(F.col("name") != root).distinct()


def compatible(licence: Column, forbidden: Iterable[str]) -> Column:
    """A licence is compatible if any of its alternatives (apart by OR) has no forbidden part; unknown and null ones aren't."""
    choices = F.split(licence, r"\s+OR\s+")
    parts = [x.lower() for x in forbidden]
    fine = F.exists(choices, lambda c: ~F.exists(F.array(*map(F.lit, parts)), lambda x: F.lower(c).contains(x)) if parts else F.lit(True))
    return F.coalesce(fine & ~licence.contains("UNKNOWN"), F.lit(False))
