"""A vector store that grows: an inverted file of cells, appended delta by delta, searched exactly or within the nearest cells.

Files below the store's path:

* ``centres``: one row a cell, by k-means over a bounded sample (the rows of least hash);
* ``data/delta=.../cell=...``: the rows, one folder a delta and cell, so that a search reads only the cells it visits;
* ``cells``: for every delta and cell the number of rows and the greatest distance from the centre. It is written after the delta's rows, so a delta that was not
  finished is not seen.

A search ranks by inner product. For a query ``q`` no row of a cell can reach more than ``q . centre + |q| * radius``. A first round visits the few cells with
the best centres, which gives each query a limit; the second round visits every other cell that can reach it. The result is therefore exact; without the second
round it is approximate.

Cells are compared in blocks: a cell's rows are spread over as many tasks as they need, and queries that visit it are cut likewise. What the driver holds is
one row a cell.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.vectors import l2_normalize
from logspark.operators.ordering import first_rows
from logspark.session import save_and_read, ship

#: Rows that the centres are learned from, at most, and cells, at most.
SAMPLE, CELLS = 100_000, 4096
#: Rows of a cell, about, that one task compares.
BLOCK = 4096
PROBES = 4


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


class VectorStore:
    """Rows ``corpus_id, vector`` with further columns, under ``path``. With ``unit`` vectors are brought to length 1, so that the inner product is the cosine."""

    def __init__(self, spark: SparkSession, path: str, unit: bool = False):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, cells: int | None = None, unit: bool = False, sample: int = SAMPLE, seed: int = 1) -> VectorStore:
        """A new empty store whose cells suit ``rows`` (``corpus_id, vector``); ``cells`` is one for each 64 rows of the sample unless given."""
        store = cls(spark, path, unit)
        few = rows.where("vector is not null").orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(sample).select(store._vector().alias("vector"))
        few = save_and_read(few, "store-sample")
        wanted = min(cells or max(few.count() // 64, 1), CELLS)
        if few.isEmpty():
            raise ValueError("a store needs rows to learn its cells from")
        model = KMeans(k=wanted, seed=seed, maxIter=10, featuresCol="f").fit(few.select(array_to_vector("vector").alias("f"))) if wanted > 1 else None
        centres = model.clusterCenters() if model else [np.mean(_matrix(few.toPandas()["vector"]), axis=0)]
        listed = [(k, [float(x) for x in c]) for k, c in enumerate(centres)]
        spark.createDataFrame(listed, "cell int, centre array<double>").coalesce(1).write.parquet(f"{store.path}/centres")
        return store

    def _vector(self):
        vector = F.col("vector").cast("array<double>")
        return l2_normalize(vector) if self.unit else vector

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def append(self, rows: DataFrame) -> None:
        """Add rows as a new delta; those without a vector are left out. Ids are not checked for repeats."""
        sent = self.spark.sparkContext.broadcast(self._centres())

        @F.pandas_udf("struct<cell: int, far: double>")
        def place(vectors: pd.Series) -> pd.DataFrame:
            x, centres = _matrix(vectors), sent.value
            if not len(x):
                return pd.DataFrame({"cell": [], "far": []})
            squares = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
            best = squares.argmin(1)
            return pd.DataFrame({"cell": best.astype("int32"), "far": np.linalg.norm(x - centres[best], axis=1)})

        ship(self.spark)
        delta = f"d{uuid.uuid4().hex}"
        ready = rows.where("vector is not null").withColumn("vector", self._vector())
        placed = ready.withColumn("_p", place("vector")).select(*ready.columns, "_p.far", F.lit(delta).alias("delta"), "_p.cell")
        spread = placed.hint("rebalance", "cell")
        spread.write.mode("append").partitionBy("delta", "cell").parquet(f"{self.path}/data")
        own = self.spark.read.parquet(f"{self.path}/data").where(F.col("delta") == delta)
        facts = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).withColumn("delta", F.lit(delta))
        facts.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    def cells(self) -> pd.DataFrame:
        """``cell, n, radius`` over all finished deltas: one row a cell."""
        facts = self.spark.read.parquet(f"{self.path}/cells")
        return facts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("cell").toPandas()

    def rows(self) -> DataFrame:
        """All rows of finished deltas, with their ``cell``."""
        done = [r["delta"] for r in self.spark.read.parquet(f"{self.path}/cells").select("delta").distinct().collect()]  # one name a delta
        return self.spark.read.parquet(f"{self.path}/data").where(F.col("delta").isin(done)).drop("delta", "far")

    def compact(self, path: str) -> VectorStore:
        """The same rows and centres as one delta under a new ``path``."""
        out = VectorStore(self.spark, path, self.unit)
        self.spark.read.parquet(f"{self.path}/centres").write.parquet(f"{out.path}/centres")
        out.append(self.rows().drop("cell"))
        return out

    def search(self, queries: DataFrame, k: int = 10, exact: bool = True, probes: int = PROBES, columns: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
        """``query_id, corpus_id, similarity, rank, cells`` and ``columns``: the ``k`` rows with the greatest inner product of each query (``query_id, vector``).

        ``cells`` counts the cells that the query visited. Ties go by ``corpus_id``. Queries without a vector have no result.
        """
        facts = self.cells()
        number, sizes = facts["cell"].to_numpy(), facts["n"].to_numpy()
        sent = self.spark.sparkContext.broadcast((number, self._centres()[number], facts["radius"].to_numpy()))

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            cell, centres, _ = sent.value
            order = np.argsort(-(_matrix(vectors) @ centres.T), axis=1, kind="stable")[:, :probes] if len(vectors) else []
            return pd.Series([cell[o] for o in order])

        @F.pandas_udf("array<int>")
        def others(vectors: pd.Series, limits: pd.Series, seen: pd.Series) -> pd.Series:
            cell, centres, radius = sent.value
            if not len(vectors):
                return pd.Series([])
            x = _matrix(vectors)
            most = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radius[None, :]
            least = limits.fillna(-math.inf).to_numpy()
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            reach = most >= (least - slack)[:, None]
            return pd.Series([np.setdiff1d(cell[r], s) for r, s in zip(reach, seen, strict=True)])

        ship(self.spark)
        asked = queries.where("vector is not null").select("query_id", self._vector().alias("vector"))
        asked = save_and_read(asked.withColumn("seen", nearest("vector")), "store-queries")
        salts = dict(zip(number.tolist(), np.maximum(-(-sizes // block), 1).tolist(), strict=True))
        found = save_and_read(self._compare(asked.select("query_id", "vector", F.explode("seen").alias("cell")), k, salts, block), "store-first")
        visits = asked.select("query_id", F.size("seen").alias("cells"))
        if exact:
            limit = first_rows(found, ["query_id"], [F.desc("similarity"), F.asc("corpus_id")], k).groupBy("query_id")
            limit = limit.agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
            more = asked.join(limit, "query_id", "left").withColumn("more", others("vector", "least", "seen"))
            more = save_and_read(more.select("query_id", "vector", "more", (F.size("seen") + F.size("more")).alias("cells")), "store-more")
            visits = more.select("query_id", "cells")
            found = found.unionByName(self._compare(more.select("query_id", "vector", F.explode("more").alias("cell")), k, salts, block))
        best = first_rows(found, ["query_id"], [F.desc("similarity"), F.asc("corpus_id")], k).join(visits, "query_id")
        if columns:
            best = best.join(self.rows().select("cell", "corpus_id", *columns), ["cell", "corpus_id"])
        return best.select("query_id", "corpus_id", "similarity", "rank", "cells", *columns)

    def _compare(self, visits: DataFrame, k: int, salts: dict[int, int], block: int) -> DataFrame:
        """``query_id, cell, corpus_id, similarity``: the best ``k`` rows for every visit of a query to a part of a cell."""
        wanted = sorted(r["cell"] for r in visits.select("cell").distinct().collect())  # cells, of which there are at most CELLS
        rows = self.rows().where(F.col("cell").isin(wanted)).select("cell", "corpus_id", "vector")
        # Keys of both sides are of one type, bigint: equal numbers of two types go to different tasks.
        zero = F.lit(0).cast("bigint")
        sizes = (x for c in wanted for x in (F.lit(c).cast("int"), F.lit(salts[c]).cast("bigint")))
        parts = F.element_at(F.create_map(*sizes), F.col("cell")) if wanted else zero + 1
        load = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("cuts"))
        left = visits.join(load, "cell").withColumn("cut", F.pmod(F.xxhash64("query_id"), F.col("cuts")))
        left = left.withColumn("salt", F.explode(F.sequence(zero, parts - 1))).select("cell", "salt", "cut", "query_id", "vector")
        right = rows.join(load.toDF("cell", "cuts"), "cell").withColumn("salt", F.pmod(F.xxhash64("corpus_id"), parts))
        right = right.withColumn("cut", F.explode(F.sequence(zero, F.col("cuts") - 1))).select("cell", "salt", "cut", "corpus_id", "vector")

        def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if q.empty or c.empty:
                return pd.DataFrame({name: [] for name in ("query_id", "cell", "corpus_id", "similarity")})
            c = c.sort_values("corpus_id", kind="stable")  # a stable sort by value then breaks ties by id
            found = _matrix(q["vector"]) @ _matrix(c["vector"]).T
            n = min(k, found.shape[1])
            best = np.argsort(-found, axis=1, kind="stable")[:, :n]
            out = {"query_id": q["query_id"].to_numpy().repeat(n), "cell": q["cell"].to_numpy().repeat(n), "corpus_id": c["corpus_id"].to_numpy()[best.ravel()]}
            return pd.DataFrame(out | {"similarity": np.take_along_axis(found, best, 1).ravel()})

        kinds = dict(visits.dtypes) | dict(rows.dtypes)
        by = ["cell", "salt", "cut"]
        schema = f"query_id {kinds['query_id']}, cell int, corpus_id {kinds['corpus_id']}, similarity double"
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(product, schema)
