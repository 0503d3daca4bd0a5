"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a hash of signs of random projections, written one after another into one number; in the
order of these numbers vectors at a small angle tend to stand close together, since they share their first signs. Each
vector is compared with those that follow it within a window; verified pairs of all passes are united. Links are then
counted exactly inside each group found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import broadcast_within, discard, write_table
from soundtable.llm.components import connected_components
from soundtable.llm.ordering import ranked

#: Signs in a hash, vectors that each is compared with after it in a pass, and the share of pairs at the least similarity
#: that all passes together may miss if vectors point anywhere.
SIGNS, WINDOW, MISSED = 62, 32, 0.001
#: Vectors of an order that one task compares at once, and vectors of a group that it counts links among.
BLOCK, TILE = 4096, 2048


def passes_for(largest: int, similarity: float, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which at most `missed` of the pairs at that similarity are not found among `largest` vectors: a pair
    meets in a pass if it shares the signs that narrow the order down to half a window."""
    same = 1 - math.acos(similarity) / math.pi
    signs = max(1.0, math.log2(max(largest, 2) / (window / 2)))
    return max(2, math.ceil(math.log(missed) / math.log(1 - same**signs)))


def vector_classes(spark: SparkSession, df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, v1, v2), a row for each row of df, and (cid, v1, v2, label, dim, vec, m, least), written, for each different vector of a label.

    v1 and v2 are null where a row cannot link: no label, no vector, a null, infinite or NaN component, or all zero."""
    vec, label = F.col(f"`{vec_col}`"), F.col(f"`{label_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.coalesce(label.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    v1, v2 = F.xxhash64(label, vec), F.xxhash64(F.lit(1), vec, label)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.when(ok, v1).alias("v1"), F.when(ok, v2).alias("v2"), label.alias("label"), vec.cast("array<double>").alias("vec"))
    grouped = rows.where("v1 IS NOT NULL").groupBy("v1", "v2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("id").alias("least"))
    classes = grouped.select(F.monotonically_increasing_id().alias("cid"), "v1", "v2", "label", F.size("vec").alias("dim"), "vec", "m", "least")
    return rows.select("id", "v1", "v2"), write_table(spark, classes, "vector-classes")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    found = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    scaled = found / np.abs(found).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _hashed(classes: DataFrame, number: int) -> DataFrame:
    """classes with `hash`: the signs of that pass's projections, the first one highest."""

    def run(batches):
        for batch in batches:
            dims, vecs = batch.column(2).to_numpy(), batch.column(3)
            out = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                planes = np.random.default_rng([number, dim]).standard_normal((dim, SIGNS))
                signs = _matrix(vecs.take(pa.array(mine)), dim) @ planes > 0
                out[mine] = signs @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "hash"])

    narrow = classes.select("cid", "label", "dim", "vec")
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("hash", T.LongType())]))


def _merged(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of each of n numbers' components under the pairs (a, b)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            return least


def pass_links(spark: SparkSession, classes: DataFrame, number: int, similarity: float, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b) of cids, written: links that connect all pairs of one pass with at least that similarity and at most `window` places apart.

    Blocks of the order are compared each in a task, which also gets the `window` vectors that follow; it sends for each
    vector at most one link, to the first of those that it is connected with there."""
    order = ranked(spark, _hashed(classes, number), ["label", "dim", "hash", "cid"], "place", "projection")
    own = F.floor(F.col("place") / block)
    dealt = order.select("cid", "label", "dim", "vec", "place", F.explode(F.array_distinct(F.array(own, F.greatest(F.floor((F.col("place") - window) / block), F.lit(0))))).alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, dims = table["place"].to_numpy(), table["dim"].to_numpy()
        _, label = np.unique(np.array(table["label"].to_pylist()), return_inverse=True)
        first = place // block == table["block"][0].as_py()
        pairs = [np.zeros((2, 0), np.int64)]
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            x = _matrix(table["vec"].take(pa.array(mine)), dim)
            for step in range(1, min(window, len(mine) - 1) + 1):
                i, j = mine[:-step], mine[step:]
                close = (place[j] - place[i] <= window) & (label[i] == label[j]) & first[i]
                at = np.flatnonzero(close)
                at = at[np.einsum("ij,ij->i", x[at], x[at + step]) >= similarity]
                pairs.append(np.stack([i[at], j[at]]))
        a, b = np.concatenate(pairs, axis=1)
        root = _merged(a, b, len(place))
        cid, linked = table["cid"].to_numpy(), np.flatnonzero(root != np.arange(len(place)))
        return pa.table([cid[root[linked]], cid[linked]], names=["a", "b"])

    found = write_table(spark, dealt.groupBy("block").applyInArrow(compare, "a long, b long"), "projection-links")
    discard(spark, order)
    return found


def _counted_links(spark: SparkSession, members: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(cid, near): how many rows of other vectors of its group (cid, dim, vec, m, label) each vector links with.

    A group is cut into tiles of about `tile` vectors; each pair of tiles is one task's matrix product, which sends a
    count for each vector, no pair. Groups of one tile share tasks."""
    sizes = write_table(spark, members.groupBy("label").agg(F.count("*").alias("size")).withColumnRenamed("label", "l"), "group-sizes")
    bins = max(1, (sizes.agg(F.sum("size")).first()[0] or 0) // tile)
    tiles = F.ceil(F.col("size") / tile).cast("long")
    mine = F.pmod(F.xxhash64("cid"), F.col("tiles"))
    met = members.join(broadcast_within(sizes), F.col("label") == F.col("l")).withColumn("tiles", tiles).withColumn("mine", mine)
    pair = F.struct(F.least("mine", F.col("other")).alias("i"), F.greatest("mine", F.col("other")).alias("j"))
    met = met.select("cid", "vec", "dim", "m", "label", "tiles", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")).withColumn("pair", pair)
    task = F.when(F.col("tiles") == 1, F.struct(F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("label"), F.lit(bins)).alias("i"), F.lit(0).cast("long").alias("j"))).otherwise(F.struct(F.col("label").alias("g"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j")))
    met = met.select(task.alias("task"), "label", "cid", "vec", "dim", "m", (F.col("mine") != F.col("pair.i")).alias("second"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        label, dims, second, m = (table[c].to_numpy() for c in ("label", "dim", "second", "m"))
        near = np.zeros(len(m), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            x, side, w = _matrix(table["vec"].slice(i, j - i), int(dims[i])), second[i:j].astype(bool), m[i:j]
            for k in range(0, j - i, 256):  # so many rows of the product at once
                close = x[k : k + 256] @ x.T >= similarity
                if side.any():
                    close &= side[k : k + 256, None] != side
                else:
                    close[np.arange(len(close)), np.arange(k, k + len(close))] = False
                near[i + k : i + k + len(close)] += close @ w
        return pa.table([table["cid"].to_numpy(), near], names=["cid", "near"])

    counted = met.groupBy("task").applyInArrow(count, "cid long, near long")
    return counted.groupBy("cid").agg(F.sum("near").alias("near"))


def near_vectors(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", similarity: float = 0.98, window: int = WINDOW, passes: int | None = None, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of df.

    Rows with one label and cosine (in doubles) of at least `similarity` link; vectors of different lengths do not. Null
    labels, and vectors that are null, empty, zero or hold null, NaN or infinite components, link with nothing. Equal
    vectors of a label are one class, so copies are counted, not compared. Groups are what the passes connect; inside a
    group every link counts, found in a pass or not. So no link is counted wrongly, and one is missed only where its ends
    are not connected by any pass; `passes` (by default) follows from the number of vectors of the largest label.
    component_id is the smallest id of a group, null ids apart; a row is kept if its id is that. Repeated rows and ids are
    rows of their own. An empty table gives an empty result; other columns are not read.
    """
    rows, classes = vector_classes(spark, df, id_col, vec_col, label_col)
    if passes is None:
        largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
        passes = passes_for(largest, similarity, window)
    found = [pass_links(spark, classes, number, similarity, window, block) for number in range(passes)]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    groups = connected_components(spark, links).select("node", F.col("label").alias("head"))
    groups = groups.union(groups.select("head", "head").distinct())  # the first of a group has no row of its own
    groups = broadcast_within(write_table(spark, groups, "vector-groups"))
    members = classes.join(groups, F.col("cid") == F.col("node"))
    members = write_table(spark, members.select("cid", "dim", "vec", "m", F.col("head").alias("label"), "least"), "vector-members")
    counts = _counted_links(spark, members, similarity, tile)
    leasts = members.groupBy("label").agg(F.min("least").alias("component_id"))
    counted = members.select(F.col("cid").alias("c"), "label").join(counts, F.col("c") == F.col("cid")).join(broadcast_within(write_table(spark, leasts, "vector-components")), "label").select("cid", "near", "component_id")
    # Only classes with several rows or links go back to the rows.
    told = classes.select("cid", "v1", "v2", "m", "least").join(counted, "cid", "left").where("m > 1 OR near > 0")
    told = told.select("v1", "v2", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("component_id"))
    told = broadcast_within(write_table(spark, told, "linked-vectors"))
    out = rows.join(told, ["v1", "v2"], "left").withColumn("component", F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
