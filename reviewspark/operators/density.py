"""Topics where points lie dense, with outliers: a tree of dense cells whose small branches are dissolved.

Points are counted in the cells of a lattice. How dense a cell is says how many points lie in
it and in the cells around it; the cells that reach 1, 2, 4, ... times the least density form
levels, and linked cells of a level are its branches. Branches of one level lie inside those
of the level below, so all levels together are a tree. From the counts on, no step touches
points, so a crowded place costs as much as any other.
"""

from __future__ import annotations

from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.arrays import counted_terms, in_slices
from reviewspark.operators.components import components
from reviewspark.runtime import broadcast_if_small, cut, discard

OUTLIER = -1


def signed_sums(vector: Column, dims: int, scale: int = 1024) -> Column:
    """`dims` whole numbers that keep a vector's place roughly: floor(scale * x) summed under orthogonal signs.

    The i-th component counts in sum j with the sign of the Walsh function j. Null for a
    vector that is null or holds a null or non-finite component.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))

    def total(j: int) -> Column:
        sign = lambda x, i: F.when(F.bit_count(i.bitwiseAND(F.lit(j))) % 2 == 0, x).otherwise(-x)
        return F.aggregate(F.transform(whole, sign), F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(finite, F.array(*[total(j) for j in range(1, dims + 1)]))


def signed_words(words: Column, dims: int, scale: int = 1000) -> Column:
    """`dims` whole numbers that keep a text's place among its words: uses summed under each word's signs.

    The signs are the first hexadecimal digits of the word's md5, 8 and above counting as
    minus, and the sums are scaled to texts of length 1. A text without words has zeros, null
    stays null. Up to 32 numbers.
    """

    @F.arrow_udf("array<bigint>")
    def placed(batch: pa.Array) -> pa.Array:
        done = []
        for lists in in_slices(batch):
            row, term, uses, terms = counted_terms(lists)
            digits = np.array([list(md5(w.encode()).hexdigest()[:dims]) for w in terms.to_pylist()], "U1").reshape(-1, dims)
            signs = np.where(digits < "8", 1, -1)
            length = np.sqrt(np.bincount(row, uses * uses, len(lists)))
            spots = np.zeros((len(lists), dims))
            for j in range(dims):
                total = np.bincount(row, uses * signs[term, j], len(lists))
                spots[:, j] = np.floor(np.divide(total * scale, length, out=np.zeros(len(lists)), where=length > 0))
            ends = pa.array(np.arange(0, spots.size + 1, dims), pa.int32())
            done.append(pa.ListArray.from_arrays(ends, pa.array(spots.ravel().astype(np.int64)), mask=lists.is_null()))
        return pa.concat_arrays(done) if done else pa.nulls(0, pa.list_(pa.int64()))

    return placed(words)


def cell_of(coordinates: Column, side: int) -> Column:
    """The lattice cell of a point: its coordinates in units of `side`, rounded down."""
    return F.transform(coordinates, lambda x: F.floor(x / side))


def _around(cell: Column, dims: int) -> Column:
    """The cell and the 3^dims - 1 cells that touch it."""
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in product((-1, 0, 1), repeat=dims)])
    return F.transform(steps, lambda s: F.zip_with(cell, s, lambda x, y: x + y))


def cell_densities(cells: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """(keys, cell, mass, density) out of (keys, cell, mass)."""
    around = (
        cells.select(*keys, F.explode(_around(F.col("cell"), dims)).alias("cell"), "mass")
        .groupBy(*keys, "cell").agg(F.sum("mass").alias("density"))
    )
    return cells.join(around, [*keys, "cell"])


def branches(cells: DataFrame, keys: list[str], dims: int, least_density: int) -> DataFrame:
    """(keys, level, cell, mass, branch): every dense cell at each of its levels.

    Level l holds the cells of at least least_density * 2^l; a branch is named by its smallest cell.
    """
    level = F.length(F.bin(F.floor(F.col("density") / least_density))) - 1
    dense = cut(cells.filter(F.col("density") >= least_density).select(*keys, "cell", "mass", level.alias("top")))
    near = dense.select(*keys, "cell", F.col("top").alias("_top"), F.explode(_around(F.col("cell"), dims)).alias("_near"))
    other = dense.select(*keys, F.col("cell").alias("_near"), "top")
    met = near.filter(F.col("cell") < F.col("_near")).join(other, [*keys, "_near"])
    met = met.select(*keys, "cell", "_near", F.explode(F.sequence(F.lit(0), F.least("top", "_top"))).alias("level"))
    node = lambda c: F.struct(*keys, "level", F.col(c).alias("cell"))
    found = components(met.select(node("cell").alias("a"), node("_near").alias("b")))
    found = found.select("node.*", F.col("component.cell").alias("branch"))
    nodes = dense.select(*keys, "cell", "mass", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    return nodes.join(found, [*keys, "level", "cell"], "left").select(
        *keys, "level", "cell", "mass", F.coalesce("branch", "cell").alias("branch"))


def condensed(nodes: DataFrame, keys: list[str], least_size: str) -> DataFrame:
    """(keys, level, branch, size, up, head_level, head): branches of at least `least_size` points, by cluster.

    A branch that splits into two or more such branches ends its cluster, and each of them
    heads a new one; a branch that only loses points goes on with its cluster. `head` names
    the branch a cluster starts with, `up` the branch below it, null at the lowest level.
    """
    sizes = nodes.groupBy(*keys, "level", "branch").agg(F.sum("mass").alias("size"), F.max(least_size).alias("_least"))
    sizes = sizes.filter(F.col("size") >= F.col("_least")).drop("_least")
    below = nodes.select(*keys, (F.col("level") + 1).alias("level"), F.col("cell").alias("branch"), F.col("branch").alias("up"))
    tree = sizes.join(below, [*keys, "level", "branch"], "left")
    split = F.count(F.lit(1)).over(Window.partitionBy(*keys, "level", "up")) > 1
    # A way up to the head, followed twice as far each time; levels are few.
    tree = cut(tree.withColumn("_heads", F.col("up").isNull() | split))
    way = cut(tree.select(
        *keys, "level", "branch",
        F.when(F.col("_heads"), F.col("level")).otherwise(F.col("level") - 1).alias("head_level"),
        F.when(F.col("_heads"), F.col("branch")).otherwise(F.col("up")).alias("head")))
    levels = (tree.agg(F.max("level")).first()[0] or 0) + 1
    for _ in range(levels.bit_length()):
        on = way.select(*keys, F.col("level").alias("head_level"), F.col("branch").alias("head"),
                        F.col("head_level").alias("_level"), F.col("head").alias("_head"))
        further = cut(way.join(on, [*keys, "head_level", "head"]).select(
            *keys, "level", "branch", F.col("_level").alias("head_level"), F.col("_head").alias("head")))
        discard(way)
        way = further
    return tree.drop("_heads").join(way, [*keys, "level", "branch"])


def excess_of_mass(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head_level, head) of the clusters that outlast what they split into.

    A cluster's gain is the number of its points added up over its levels. From the top
    down to the lowest level a cluster is kept if its gain is at least that of the best
    choice among the clusters it splits into.
    """
    in_cluster = [*keys, "head_level", "head"]
    gains = cut(tree.groupBy(*in_cluster).agg(F.sum("size").alias("gain")))
    heads = tree.filter((F.col("level") == F.col("head_level")) & (F.col("branch") == F.col("head")))
    below = tree.select(*keys, (F.col("level") + 1).alias("head_level"), F.col("branch").alias("up"),
                        F.col("head_level").alias("from_level"), F.col("head").alias("from"))
    gains = gains.join(heads.select(*in_cluster, "up"), in_cluster).join(below, [*keys, "head_level", "up"], "left").drop("up")
    gains = cut(gains)
    levels = [r[0] for r in gains.select("head_level").distinct().collect()]  # one number a level
    done = None
    for level in sorted(levels, reverse=True):
        here = gains.filter(F.col("head_level") == level)
        if done is not None:
            inside = done.filter(F.col("from").isNotNull()).groupBy(
                *keys, F.col("from_level").alias("head_level"), F.col("from").alias("head")).agg(F.sum("best").alias("inside"))
            here = here.join(inside, in_cluster, "left")
        else:
            here = here.withColumn("inside", F.lit(None).cast("long"))
        inside = F.coalesce("inside", F.lit(0))
        here = here.select(*in_cluster, "from_level", "from", F.greatest("gain", inside).alias("best"), (F.col("gain") >= inside).alias("kept"))
        done = cut(here if done is None else done.unionByName(here))
    return gains.select(*in_cluster).limit(0) if done is None else done.filter("kept").select(*in_cluster)


def density_topics(
    points: DataFrame, key: str, coordinates: str, keys: list[str], dims: int, side: int, least_density: int,
    least_size: Column,
) -> DataFrame:
    """(keys, key, topic): topic 0 is the largest of its keys, 1 the next; -1 are outliers.

    `coordinates` holds `dims` whole numbers, `side` is a cell's width in them. Cells of at
    least `least_density` points around them are dense; clusters are the branches of dense
    cells with `least_size` points or more (an expression of the keys and `n`, the points of the
    keys) that last longest
    (`excess_of_mass`). All other points, those of dissolved branches among them, go to the
    nearest cluster that touches their cell, of equal ones to that of the denser cell, then
    of the smaller name; where none does they are outliers.

    All keys are worked out in the same jobs. Points whose coordinates are null or of another
    number are outliers; a null key is a key of its own. Repeated rows each count. The
    result does not depend on the order of rows.
    """
    at = F.when(F.size(coordinates) == dims, cell_of(F.col(coordinates), side))
    # The keys as one value that is never null, which joins would lose.
    by = ["_group"]
    group = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    # Read twice below; a point is placed once.
    placed = cut(points.select(key, *keys, group.alias("_group"), at.alias("cell")))
    cells = cut(placed.filter("cell is not null").groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("mass")))
    dense = cut(cell_densities(cells, by, dims))
    sized = cells.groupBy(*by).agg(F.sum("mass").alias("n"))
    sized = sized.select(*by, "n", *[F.col(f"_group.{k}").alias(k) for k in keys]).select(*by, least_size.alias("_least"))
    nodes = cut(branches(dense, by, dims, least_density).join(sized, by))
    tree = cut(condensed(nodes, by, "_least"))
    kept = excess_of_mass(tree, by)
    clusters = tree.join(kept, [*by, "head_level", "head"], "left_semi")
    first = F.min(F.struct("head_level", "head")).alias("cluster")
    core = nodes.join(clusters, [*by, "level", "branch"]).groupBy(*by, "cell").agg(first)
    core = cut(core.join(dense, [*by, "cell"]))

    away = dense.join(core, [*by, "cell"], "left_anti").select(*by, "cell", F.explode(_around(F.col("cell"), dims)).alias("_near"))
    far = F.aggregate(F.zip_with("cell", "_near", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    beside = away.join(core.select(*by, F.col("cell").alias("_near"), "cluster", "density"), [*by, "_near"])
    beside = beside.groupBy(*by, "cell").agg(F.min(F.struct(far.alias("far"), (-F.col("density")).alias("thin"), "cluster")).alias("best"))
    labelled = core.select(*by, "cell", "cluster").unionByName(beside.select(*by, "cell", F.col("best.cluster").alias("cluster")))
    labelled = cut(labelled.join(cells, [*by, "cell"]))

    largest = Window.partitionBy(*by).orderBy(F.desc("n"), "cluster")
    numbers = labelled.groupBy(*by, "cluster").agg(F.sum("mass").alias("n")).withColumn("topic", F.row_number().over(largest) - 1)
    side_ = cut(labelled.join(numbers, [*by, "cluster"]).select(*by, "cell", "topic"))
    discard(cells, dense, nodes, tree, core, labelled)
    # A cell costs its coordinates, the keys and the row around them.
    topics = broadcast_if_small(side_, F.lit(8 * dims + 64 * len(keys) + 64))
    return placed.join(topics, [*by, "cell"], "left").select(*keys, key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))


def least_size_by_volume(n: str = "n", large: int = 50_000, of_large: int = 100, of_others: int = 20) -> Column:
    """The least cluster of a product: 100 points above 50,000 rows, else 20."""
    return F.when(F.col(n) > large, F.lit(of_large)).otherwise(F.lit(of_others))
