"""Filling of fixed-capacity containers with texts measured in tokens.

Variable-capacity best fit over the histogram of sizes: sizes are at most the capacity, so the histogram has
a bounded number of rows, whatever the corpus. It is packed on the driver into patterns with multiplicities. The
permitted lengths are optimised jointly: which length is opened for items of each class of sizes is chosen for all
classes together, by the cost of the whole packing; finished bins are downsized to the smallest permitted length that
holds their content. Items meet their bins by their rank within their size, by binary search in the bounded table of patterns.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.encoding import encoder, vocabulary_path
from veilstone.runtime import cut

CAPACITY = 2048
#: Permitted lengths; the largest is the capacity.
LENGTHS = (256, 512, 1024, 2048)
#: Cost of a container besides its length, in tokens, where no costs are given.
OVERHEAD = 64
#: Assignments of lengths to classes of sizes that are all tried; of more, one class after the other is improved.
ALL_POLICIES = 64
#: Items of one rank group; a hot size is ranked in many such groups.
RANK_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]


def token_counts(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)``; null and empty texts have 0 tokens."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(one(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int32())], ["doc_id", "n_tokens"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens int")


def _fitting(size: int, lengths: tuple[int, ...]) -> int:
    """Number of the smallest length that holds an item: its class."""
    return bisect.bisect_left(lengths, size)


def best_fit(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, policy: tuple[int, ...] | None = None) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of ``{size: count}`` as ``[(content, how many bins)]``; content is ``((size, n), ...)``.

    Where an item fits no open bin, the length that ``policy`` names for its class is opened; the largest where there is none.
    """
    policy = policy or (lengths[-1],) * len(lengths)
    residuals: list[int] = []  # residuals with open bins, ascending
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, content: Pattern, bins: int) -> None:
        if bins:
            if room not in groups:
                bisect.insort(residuals, room)
                groups[room] = []
            groups[room].append((content, bins))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect.bisect_left(residuals, size)
            if i < len(residuals):
                room = residuals[i]
                content, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    residuals.pop(i)
                k = min(room // size, left)
            else:
                room = policy[_fitting(size, lengths)]
                content, k = (), min(room // size, left)
                bins = left // k
            take = min(bins, left // k)
            put(room, content, bins - take)
            put(room - k * size, content + ((size, k),), take)
            left -= take * k
    return [g for room in residuals for g in groups[room]]


def sized(histogram: dict[int, int], lengths: tuple[int, ...], policy: tuple[int, ...] | None = None) -> list[tuple[Pattern, int, int]]:
    """The packing of one policy as ``(content, bins, length)``, each bin downsized to its content."""
    return [(c, n, lengths[_fitting(sum(s * k for s, k in c), lengths)]) for c, n in best_fit(histogram, lengths, policy)]


def cost_of(plan: list[tuple[Pattern, int, int]], costs: dict[int, float]) -> float:
    return sum(n * costs[x] for _, n, x in plan)


def cheapest(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, costs: dict[int, float] | None = None) -> list[tuple[Pattern, int, int]]:
    """Patterns ``(content, bins, downsized length)`` of the jointly best lengths to open, by total cost.

    A policy names for each class of sizes (between two neighbouring lengths) the length that is opened, any that
    holds the class. All policies are tried where there are at most :data:`ALL_POLICIES`; otherwise those of one length each
    are, and the best is improved class by class until no change of one class makes it cheaper.
    """
    costs = costs or {x: x + OVERHEAD for x in lengths}
    tried: dict[tuple[int, ...], float] = {}

    def value(policy: tuple[int, ...]) -> float:
        if policy not in tried:
            tried[policy] = cost_of(sized(histogram, lengths, policy), costs)
        return tried[policy]

    choices = [lengths[k:] if any(_fitting(s, lengths) == k for s in histogram) else lengths[-1:] for k in range(len(lengths))]
    uniform = [tuple(max(x, lengths[k]) for k in range(len(lengths))) for x in reversed(lengths)]
    if np.prod([float(len(c)) for c in choices]) <= ALL_POLICIES:
        best = min(itertools.product(*[c[::-1] for c in choices]), key=value)  # the first of equals opens the larger ones
    else:
        best = min(uniform, key=value)
        while (better := min((best[:k] + (x,) + best[k + 1 :] for k, c in enumerate(choices) for x in c), key=value)) and value(better) < value(best):
            best = better
    return sized(histogram, lengths, best)


def _place(slots: list[tuple[int, int, int, int, int]]):
    """Arrow batches of ``(doc_id, piece_no, token_start, n_tokens, rank)`` to their containers.

    ``slots`` has ``(size, first rank, items per bin, first bin, length)`` by size and rank; it is bounded by the sizes.
    """
    size, begin, per, first, length = np.array(slots, np.int64).reshape(-1, 5).T
    step = np.int64(1) << 44  # ranks are below
    keys = size * step + begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, b.column("n_tokens").to_numpy().astype(np.int64) * step + rank, side="right") - 1
            container = first[at] + (rank - begin[at]) // per[at]
            cols = [b.column(c) for c in ("doc_id", "piece_no", "token_start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(container), pa.array(length[at].astype(np.int32))], ["doc_id", "piece_no", "token_start", "n_tokens", "container_id", "container_length"])

    return run


def pack(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", size_col: str = "n_tokens", rank_rows: int = RANK_ROWS, costs: dict[int, float] | None = None) -> DataFrame:
    """``(doc_id, piece_no, token_start, n_tokens, container_id, container_length)`` of every item.

    An item goes whole into one container unless it exceeds the largest length; then it is cut into pieces of
    that length and a rest. Items of size null or 0 need no container: their container is null. Ids may repeat;
    each row is an item of its own. ``costs`` gives the cost of a container of each length.
    """
    spark = sizes.sparkSession
    lengths = tuple(sorted(set(lengths)))
    cap = lengths[-1]
    size = F.coalesce(F.col(size_col).cast("int"), F.lit(0))
    items = sizes.select(F.col(id_col).alias("doc_id"), size.alias("size"))
    steps = F.sequence(F.lit(0), F.greatest((F.col("size") - 1).cast("int"), F.lit(0)), F.lit(cap))
    pieces = items.select("doc_id", "size", F.posexplode(steps).alias("piece_no", "token_start"))
    pieces = cut(pieces.select("doc_id", "piece_no", "token_start", F.least(F.col("size") - F.col("token_start"), F.lit(cap)).alias("n_tokens")))
    counted = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most cap rows

    slots, taken, first = [], dict.fromkeys(counted, 0), 0
    for content, bins, length in cheapest(counted, lengths, costs) if counted else []:
        for s, k in content:
            slots.append((s, taken[s], k, first, length))
            taken[s] += k * bins
        first += bins
    hot = [(s, -(-n // rank_rows)) for s, n in counted.items() if n > rank_rows]
    parts = F.broadcast(spark.createDataFrame(hot, "n_tokens int, parts int"))  # at most cap rows
    real = pieces.where("n_tokens > 0").join(parts, "n_tokens", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.coalesce("parts", F.lit(1)))).drop("parts")
    per = real.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # a row per rank group
    offsets = per.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    order = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = real.withColumn("r", F.row_number().over(order) - 1).join(offsets, ["n_tokens", "salt"]).select("doc_id", "piece_no", "token_start", "n_tokens", (F.col("r") + F.col("skip")).cast("long").alias("rank"))
    own = pieces.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(_place(sorted(slots)), f"doc_id {own}, piece_no int, token_start int, n_tokens int, container_id long, container_length int")
    none = pieces.where("n_tokens = 0").select("doc_id", "piece_no", "token_start", "n_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("container_length"))
    return placed.unionByName(none)
