"""Approximate top-k by inverted lists: vectors lie in the list of their nearest centroid, and a query reads only the nearest lists.

Centroids come from k-means over a bounded sample of unit vectors, the rows of
smallest id hash (``sample_rows``, so a rebuild takes the same ones); every row is
then put into its list.  Lists are partition folders, so a search that joins its
probes to them by equality reads only the folders that some query probes (dynamic
partition pruning).  There are about as many lists as the square root of the rows,
LISTS at most: at a billion vectors a list is then a few hundred MB.

Rows and queries meet as blocks (``nearest``): a query holds a bit for every list,
and a block of one list is multiplied with the queries that probe it, so no row is
made for a pair or a probe.  What is broadcast is bounded: centroids by LISTS,
queries and their bits by passes.  A list that holds a third of all rows is split
while it is written (rebalance) and while it is read (ranges of list and id).

Cases: a null vector, one without length, or one of another dimension than the
centroids matches nothing and is kept in list -1, which no query probes; ties go
to the smaller id; repeated rows are hits of their own; an empty table gives an
index without lists, and searches without hits; other columns are carried along.
With ``probes=None`` all lists are read and the result is exact; ``tune`` finds how many
probes a wanted recall takes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import nearest

LISTS, SAMPLE_ROWS, ITERATIONS, SEED = 4096, 262_144, 12, 42
STEP = 512  # vectors at once against all centroids
NOWHERE = -1


def unit(vector: Column) -> Column:
    """The vector with length one; null where it has none."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size))


def lists_for(rows: int) -> int:
    return max(1, min(LISTS, round(rows**0.5)))


def train(vectors: DataFrame, lists: int | None = None, id_column: str = "id", sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> np.ndarray:
    """Centroids of length one, a row each; no row where no vector has length."""
    usable = vectors.select(id_column, unit(F.col("embedding")).alias("_u")).where("_u IS NOT NULL AND NOT exists(_u, x -> x IS NULL OR isnan(x))")
    size = usable.groupBy(F.size("_u").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return np.zeros((0, 0))
    usable = usable.where(F.size("_u") == size.d)
    wanted = lists or lists_for(size["count"])
    sample = usable.orderBy(F.xxhash64(id_column), id_column).limit(sample_rows).select(array_to_vector("_u").alias("features"))
    model = KMeans(k=wanted, seed=seed, maxIter=ITERATIONS, distanceMeasure="cosine").fit(sample)
    centers = np.array(model.clusterCenters())
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def near(vectors: pd.Series, centroids: np.ndarray, n: int):
    """(places in the batch, their n nearest lists) in steps of some MB; nearest first, of equal ones the lower number."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == centroids.shape[1]] if len(centroids) else []
    for at in range(0, len(good), STEP):
        some = good[at : at + STEP]
        away = -np.round(np.stack([vectors.iloc[i] for i in some]) @ centroids.T, 12)
        yield some, away.argmin(axis=1)[:, None] if n == 1 else np.argsort(away, axis=1, kind="stable")[:, :n]


def nearest_lists(centroids: np.ndarray, n: int):
    """A column function: the n nearest lists of a unit vector, nearest first."""

    @F.pandas_udf("array<int>")
    def find(vectors: pd.Series) -> pd.Series:
        found = np.empty(len(vectors), dtype=object)
        found[:] = [np.zeros(0, dtype=np.int32)] * len(vectors)
        for some, lists in near(vectors, centroids, n):
            for i, row in zip(some, lists.astype(np.int32)):
                found[i] = row
        return pd.Series(found)

    return find


def nearest_bits(centroids: np.ndarray, n: int):
    """A column function: a bit for every list, set for the n nearest ones of a unit vector."""

    @F.pandas_udf("binary")
    def find(vectors: pd.Series) -> pd.Series:
        found = [bytes(max(1, -(-len(centroids) // 8)))] * len(vectors)
        for some, lists in near(vectors, centroids, n):
            marks = np.zeros((len(some), len(centroids)), dtype=np.uint8)
            np.put_along_axis(marks, lists, 1, axis=1)
            for i, row in zip(some, np.packbits(marks, axis=1)):
                found[i] = row.tobytes()
        return pd.Series(found)

    return find


def build(vectors: DataFrame, path: str, lists: int | None = None, id_column: str = "id", **fit) -> None:
    """Writes path/centroids and path/lists; vectors: id_column, embedding array<float>, and anything else."""
    spark = vectors.sparkSession
    centroids = train(vectors, lists, id_column, **fit)
    table = [(i, [float(x) for x in row]) for i, row in enumerate(centroids)]
    spark.createDataFrame(table, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    placed = vectors.withColumn("_unit", unit(F.col("embedding")))
    placed = placed.withColumn("list", F.coalesce(F.try_element_at(nearest_lists(centroids, 1)(F.col("_unit")), F.lit(1)), F.lit(NOWHERE)))
    placed = placed.drop("_unit")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # partition folders of an empty table have none
    placed.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def read(spark: SparkSession, path: str) -> tuple:
    """(lists, centroids) of an index."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/lists"), np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))


def search(index: tuple, queries: DataFrame, k: int, probes: int | None = 8, where: Column | None = None, id_column: str = "id", max_queries: int = 10_000) -> DataFrame:
    """query_id, rank, distance, and the collection's columns of the k nearest rows in the ``probes`` nearest lists of every query.

    queries: query_id, embedding; ``where`` filters the rows before the search.
    """
    held, centroids = index
    rows = held if where is None else held.where(where)
    rest = [c for c in rows.columns if c not in (id_column, "embedding", "list")]
    probes = probes or max(1, len(centroids))
    asked = queries.select("query_id", "embedding", unit(F.col("embedding")).alias("_q"))
    lists = asked.select(F.explode(nearest_lists(centroids, probes)(F.col("_q"))).alias("list")).distinct()
    asked = asked.select("query_id", "embedding", nearest_bits(centroids, probes)(F.col("_q")).alias("_bits"))
    passes = max(1, -(-queries.count() // max_queries))
    order = Window.partitionBy("query_id").orderBy("distance", id_column)
    probed = rows.join(F.broadcast(lists), "list", "left_semi")  # other folders are not read
    probed = probed.select("list", id_column, F.struct(id_column, *rest).alias("_row"), "embedding").repartitionByRange(nearest.tasks(rows), "list", id_column).sortWithinPartitions("list", id_column)
    found = None
    for n in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n)
        pairs = nearest.pairs(nearest.blocks(probed, "_row", group="list"), nearest.blocks(part, "query_id", nearest.QUERY_BYTES, bits="_bits"), k)
        best = pairs.select("query_id", "key.*", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", id_column, "rank", "distance", *rest)


def tune(index: tuple, k: int = 10, target: float = 0.97, sample_queries: int = 64, id_column: str = "id") -> tuple:
    """(probes, recalls): the fewest probes whose recall@k reaches the target, and the recall of 1, 2, ... probes.

    Measured with the ``sample_queries`` rows of smallest id hash as queries, themselves not counted as hits: one exact
    search tells for each of their hits how near its list was to the query.  How many probes a recall takes depends on
    the vectors: few where they form clusters, most of the lists where they spread evenly over all directions.
    """
    held, centroids = index
    usable = held.where(F.col("list") != NOWHERE)
    asked = usable.orderBy(F.xxhash64(F.lit("tune"), id_column), id_column).limit(sample_queries).select(F.col(id_column).alias("query_id"), "embedding").dropDuplicates(["query_id"])
    asked = held.sparkSession.createDataFrame(asked.collect(), asked.schema)
    hits = search(index, asked, k + 1, None, id_column=id_column).where(F.col(id_column) != F.col("query_id")).select("query_id", F.col(id_column).alias("_hit"))
    probed = asked.select("query_id", F.posexplode(nearest_lists(centroids, max(1, len(centroids)))(unit(F.col("embedding")))).alias("place", "list"))
    lists = usable.select(F.col(id_column).alias("_hit"), "list").join(F.broadcast(hits), "_hit")
    counts = {r.place: r["count"] for r in lists.join(F.broadcast(probed), ["query_id", "list"]).groupBy("place").count().collect()}
    shares = np.cumsum([counts.get(i, 0) for i in range(len(centroids))]) / max(1, sum(counts.values()))
    return int(np.searchsorted(shares, target - 1e-12)) + 1 if counts else 1, [round(float(x), 4) for x in shares]


def recall(found: DataFrame, exact: DataFrame, id_column: str = "id") -> float:
    """Share of the exact hits that were found."""
    hits = exact.select("query_id", id_column).join(found.select("query_id", id_column, F.lit(1).alias("hit")).distinct(), ["query_id", id_column], "left")
    return float(hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)
