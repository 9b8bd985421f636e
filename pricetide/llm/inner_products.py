"""Exact top-k search by inner product: blocks by descending length, partial sums of rotated vectors, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import stored

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
STEP = 512
# Blocks go to their queries by the shelf: at most so many shelves, as long as a shelf stays within so many bytes.
SHELVES = 256
SHELF_BYTES = 32 * 2**20
EXACT = 2.0**52


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as long, of the rows that take part.

    Null ids, null vectors and vectors holding null or non-finite components take no part. Of rows that repeat an id
    the one with the smallest vector (in array order) takes part.
    """
    x = F.col(column)
    fine = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(
        x, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    floored = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(fine).select(F.col(id_column).cast("long").alias("id"), floored.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows of integers held in doubles; shorter ones end in zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def rotation(vectors: DataFrame, width: int, rows: int, sample: int = 4096) -> np.ndarray:
    """Right singular vectors of about `sample` of the `rows` vectors. Any rotation gives exact results; this one gives
    tight bounds. One task sums up the products of the sample's components: the driver sees that square matrix alone."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            m = _matrix(list(pdf.v), width)
            total += m.T @ m
        yield pd.DataFrame({"gram": [total.tobytes()]})

    picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // sample))) == 0).select("v").limit(2 * sample)
    found = picked.coalesce(1).mapInPandas(gram, "gram binary").first() if width else None
    return np.linalg.eigh(np.frombuffer(found.gram).reshape(width, width))[1][:, ::-1] if found else np.eye(max(width, 1))


def _blocks(ordered: DataFrame, rows: int, width: int) -> DataFrame:
    """One row per block of at most `rows` consecutive vectors: longest length, ids and components as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                m = _matrix(list(part.v), width)
                yield pd.DataFrame({
                    "longest": [float(np.sqrt((m * m).sum(1).max()))],
                    "ids": [part.id.to_numpy(np.int64).tobytes()],
                    "components": [m.tobytes()],
                })

    return ordered.mapInPandas(pack, "longest double, ids binary, components binary")


class _Search:
    """Best k candidates of each query in one block of candidates, given scores that are known to be reached already."""

    def __init__(self, turn: np.ndarray, k: int):
        self.turn, self.k, self.head = turn, k, max(1, turn.shape[0] // 4)

    def parts(self, m: np.ndarray):
        r = m @ self.turn
        return r[:, : self.head], np.sqrt((r[:, self.head :] ** 2).sum(1)), np.sqrt((r * r).sum(1))

    def best(self, q_ids, q, floor, c_ids, c):
        """Arrays (query row, candidate id, score); `floor`: the score a query needs at least, ties included."""
        floor = floor.copy()
        q_head, q_rest, q_len = self.parts(q)
        c_head, c_rest, c_len = self.parts(c)
        order = np.argsort(-c_len, kind="stable")
        found: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        for at in range(0, len(order), STEP):
            step = order[at : at + STEP]
            longest = c_len[step[0]]
            slack = 1e-9 * (1 + q_len * longest)
            live = np.flatnonzero(q_len * longest + slack >= floor)
            if not len(live):
                break
            bound = q_head[live] @ c_head[step].T + np.outer(q_rest[live], c_rest[step])
            rows, cols = np.nonzero(bound + slack[live, None] >= floor[live, None])
            if not len(rows):
                continue
            score = self.exact(q[live], c[step], rows, cols)
            keep = score >= floor[live[rows]]
            for i, j, s in zip(live[rows[keep]], c_ids[step[cols[keep]]], score[keep], strict=True):
                found[i].append((-s, j))
            for i in np.unique(live[rows[keep]]):
                found[i] = sorted(found[i])[: self.k]
                if len(found[i]) == self.k:
                    floor[i] = max(floor[i], -found[i][-1][0])
        return [(i, j, -s) for i, hits in enumerate(found) for s, j in hits]

    @staticmethod
    def exact(q, c, rows, cols):
        largest = np.sqrt((q * q).sum(1).max() * (c * c).sum(1).max())
        if largest < EXACT:  # integers in doubles, every partial sum is exact
            if len(rows) * 4 > len(q) * len(c):
                return (q @ c.T)[rows, cols]
            return np.einsum("ij,ij->i", q[rows], c[cols])
        return np.array([float(sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True))) for i, j in zip(rows, cols, strict=True)])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest inner product for each query.

    Both frames are (id, v) of `integer_vectors`; a query is no candidate of its own. Ties go to the smaller id. Vectors
    of unequal width are read as if zeros followed; an empty vector scores 0 with everything. Empty tables give nothing.

    Equal vectors are one class, searched once however many rows it has, as a candidate and as a query. The k rows of a
    query, and itself, lie in the k + 1 best classes, by score and smallest id, and are among the k + 1 smallest ids of each.
    """
    by_id = Window.partitionBy("v").orderBy("id")
    few = vectors.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    classes = stored(few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    of_queries = stored(queries.groupBy("v").agg(F.min("id").alias("class")))
    # Stored, vectors are many times smaller than in memory: their files say nothing about what a broadcast would take.
    asked = queries.join(of_queries.hint("merge"), "v").select("id", "class")
    found = _top_classes(classes.select("id", "v"), of_queries.select(F.col("class").alias("id"), "v"), k + 1)
    rows = found.join(classes.select(F.col("id").alias("vec_id"), "ids"), "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("n", F.row_number().over(best("query_id"))).filter(F.col("n") <= k + 1).drop("n")
    rows = rows.withColumnRenamed("query_id", "class").join(asked.withColumnRenamed("id", "query_id"), "class").filter("query_id <> vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _top_classes(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k candidates with the highest inner product for each query, itself included.

    Candidates lie in blocks by descending length. The first block gives every query a score it surely reaches; as
    lengths only fall, the blocks a query still has to see are a prefix, and the rest is never sent to it. Within a
    block, rotated partial sums plus the product of what is left of both lengths bound a score from above, and only
    pairs whose bound reaches the floor are multiplied out. Sums are exact while |q| |c| < 2^52 and done in
    arbitrary-size integers beyond (components themselves fit a long).
    """
    vectors = stored(vectors.withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    shape = vectors.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    spark, width = vectors.sparkSession, shape.width or 0
    result = "query_id long, vec_id long, score long"
    if not shape.n:
        return spark.createDataFrame([], result)
    search = _Search(rotation(vectors, width, shape.n), k)
    parts = -(-shape.n // BLOCK_ROWS)
    ordered = vectors.repartitionByRange(parts, F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id")
    blocks = stored(_blocks(ordered.select("id", "v"), BLOCK_ROWS, max(width, 1)))
    blocks = _numbered(blocks)
    # One number per block of thousands of vectors: the only thing about all vectors that the driver sees.
    lengths = np.array([r.longest for r in blocks.select("block", "longest").orderBy("block").collect()])
    asked = stored(_blocks(queries.select("id", "v"), QUERY_ROWS, max(width, 1)).drop("longest"))

    def unpack(ids, components):
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(components, np.float64).reshape(len(ids), -1)

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, q = unpack(row.q_ids, row.q_components)
                c_ids, c = unpack(row.ids, row.components)
                hits = search.best(q_ids, q, np.full(len(q_ids), -np.inf), c_ids, c)
                floor = np.full(len(q_ids), -np.inf)
                many = np.bincount([i for i, _, _ in hits], minlength=len(q_ids))
                for i, _, s in hits:
                    if many[i] == k:
                        floor[i] = s  # hits of a query come best first, so its last one stays
                q_len = np.sqrt((q * q).sum(1))
                need = np.where(floor > 0, (floor - 1e-9 * (1 + np.abs(floor))) / np.maximum(q_len, 1e-300), -1)
                last = int(np.searchsorted(-lengths, -need.min(), side="right")) - 1
                yield pd.DataFrame({
                    "q_ids": [row.q_ids], "q_components": [row.q_components], "floor": [floor.tobytes()], "last": [last],
                    "hits": [[{"query_id": int(q_ids[i]), "vec_id": int(j), "score": int(s)} for i, j, s in hits]],
                })

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, q = unpack(row.q_ids, row.q_components)
                c_ids, c = unpack(row.ids, row.components)
                hits = search.best(q_ids, q, np.frombuffer(row.floor, np.float64), c_ids, c)
                yield pd.DataFrame({
                    "query_id": [int(q_ids[i]) for i, _, _ in hits], "vec_id": [int(j) for _, j, _ in hits],
                    "score": [int(s) for _, _, s in hits]}).astype("int64")

    renamed = asked.select(F.col("ids").alias("q_ids"), F.col("components").alias("q_components"))
    # Each side of these joins is cut into blocks of bounded size; the head is a single block.
    first = renamed.withColumn("block", F.lit(0)).join(F.broadcast(blocks.filter("block = 0")), "block")
    seeds = stored(first.mapInPandas(
        seeded, f"q_ids binary, q_components binary, floor binary, last int, hits array<struct<{result.replace(' long', ':bigint')}>>"))
    # Queries are copied once per shelf, not per block, and never broadcast: the copies are far more than the stored rows.
    held = _blocks_of_shelf(len(lengths), width)
    shelf = lambda block: F.floor((F.col(block) - 1) / held)
    later = seeds.filter("last >= 1").select(
        "q_ids", "q_components", "floor", "last", F.explode(F.sequence(F.lit(0).cast("long"), shelf("last"))).alias("shelf"))
    shelved = blocks.filter("block >= 1").select("block", "ids", "components", shelf("block").alias("shelf"))
    rest = later.hint("merge").join(shelved, "shelf").filter("block <= last").mapInPandas(searched, result)
    hits = seeds.select(F.explode("hits").alias("h")).select("h.*").unionByName(rest)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def _blocks_of_shelf(blocks: int, width: int) -> int:
    """How many blocks lie on a shelf: a task holds one shelf while the queries go by."""
    return max(1, min(-(-blocks // SHELVES), SHELF_BYTES // (8 * BLOCK_ROWS * max(width, 1))))


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered by descending length; blocks, not vectors, are counted here."""
    order = Window.orderBy(F.desc("longest"), "key")
    keyed = blocks.withColumn("key", F.xxhash64("ids"))
    numbers = keyed.select("key", "longest").withColumn("block", F.row_number().over(order) - 1).drop("longest")
    return stored(keyed.join(F.broadcast(numbers), "key").drop("key"))
