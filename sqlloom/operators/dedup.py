"""Nearest neighbours and greedy semantic de-duplication inside groups.

Within a group every vector is compared with every other one, as the semantics ask for the true nearest. The
comparisons are block by block: a group is cut into blocks of bounded size, each task multiplies one pair
of blocks, and no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 2048
#: Undecided pairs that the driver may scan, and rounds after which the dropped keys are put together.
SCANNED, TOGETHER = 1 << 20, 50


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _blocked(df: DataFrame, group: str, key: str, vector: str, block: int) -> tuple[DataFrame, DataFrame]:
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    rows = rows.select(F.col(group), F.col(key), F.col(vector)).join(sizes, group)
    return rows.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")), sizes


def _pairs(df: DataFrame, group: str, key: str, vector: str, block: int):
    """Left and right sides, dealt to (group, block, block) cells."""
    rows, _ = _blocked(df, group, key, vector, block)
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = rows.select(group, F.col("_block").alias("_i"), others.alias("_j"), key, vector)
    right = rows.select(F.col(group).alias("_g"), others.alias("_x"), F.col("_block").alias("_y"), F.col(key).alias("_k"), F.col(vector).alias("_v"))
    return left.groupBy(group, "_i", "_j"), right.groupBy("_g", "_x", "_y")


def similar_pairs(df: DataFrame, group: str, key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(group, a, b, similarity): pairs with a < b whose cosine is over the threshold."""
    kind = dict(df.dtypes)
    schema = f"`{group}` {kind[group]}, a {kind[key]}, b {kind[key]}, similarity double"

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        sims = _unit(x[vector]) @ _unit(y["_v"]).T if len(x) and len(y) else np.zeros((len(x), len(y)))
        i, j = np.nonzero(sims > threshold)
        out = pd.DataFrame({group: x[group].iloc[0] if len(x) else None, "a": x[key].to_numpy()[i], "b": y["_k"].to_numpy()[j], "similarity": sims[i, j]})
        return out[out["a"] < out["b"]]

    left, right = _pairs(df, group, key, vector, block)
    return left.cogroup(right).applyInPandas(run, schema)


def nearest(df: DataFrame, group: str, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(group, key, neighbour, similarity): each row's nearest other row of its group; ties to the lowest key."""
    kind = dict(df.dtypes)
    schema = f"`{group}` {kind[group]}, `{key}` {kind[key]}, neighbour {kind[key]}, similarity double"

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("_k")
        if not len(x) or not len(y):
            return pd.DataFrame({group: [], key: [], "neighbour": [], "similarity": []})
        sims = np.round(_unit(x[vector]) @ _unit(y["_v"]).T, 12)
        sims[x[key].to_numpy()[:, None] == y["_k"].to_numpy()[None, :]] = -np.inf
        best = sims.argmax(1)
        out = pd.DataFrame({group: x[group].iloc[0], key: x[key].to_numpy(), "neighbour": y["_k"].to_numpy()[best], "similarity": sims[np.arange(len(x)), best]})
        return out[np.isfinite(out["similarity"])]

    left, right = _pairs(df, group, key, vector, block)
    found = left.cogroup(right).applyInPandas(run, schema)
    best = found.groupBy(group, key).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n"))).alias("best"))
    return best.select(group, key, F.col("best.n").alias("neighbour"), (-F.col("best.s")).alias("similarity"))


def _scanned(pairs: DataFrame) -> DataFrame:
    """(k): the keys that a scan of the pairs, by their larger keys, drops."""
    dropped = {}
    for r in pairs.orderBy("b").collect():  # at most SCANNED
        if r["a"] not in dropped:
            dropped[r["b"]] = True
    return pairs.sparkSession.createDataFrame([(k,) for k in dropped], f"k {dict(pairs.dtypes)['b']}")


def greedy_keep(pairs: DataFrame, keys: DataFrame, key: str, rounds: int = 1000) -> DataFrame:
    """The keys that a scan in key order keeps, which drops a key similar to one kept before it.

    The scan's outcome is the lexicographically first maximal independent set of the pairs' graph. It is
    found in rounds, without scanning: a key with no undecided smaller neighbour is kept, and its larger
    neighbours are dropped. Each round is two joins; the number of rounds is the longest chain of decisions.
    After ``rounds`` of them the driver scans the pairs that are left, once these are at most SCANNED; until
    then rounds go on. All pairs are decided in the end.
    """
    if not pairs.where("a >= b").isEmpty():
        raise ValueError("pairs must have a < b")
    open_pairs = pairs.select("a", "b").distinct().checkpoint() if pairs.sparkSession.sparkContext.getCheckpointDir() else pairs.select("a", "b").distinct().persist()
    dropped: DataFrame | None = None
    for turn in count():
        if open_pairs.isEmpty():
            break
        if turn >= rounds and open_pairs.limit(SCANNED + 1).count() <= SCANNED:
            gone = _scanned(open_pairs)
            dropped = gone if dropped is None else dropped.union(gone)
            break
        safe = open_pairs.select(F.col("a").alias("k")).distinct().join(open_pairs.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        gone = open_pairs.join(safe.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        gone = gone.checkpoint() if gone.sparkSession.sparkContext.getCheckpointDir() else gone.persist()
        dropped = gone if dropped is None else dropped.union(gone)
        if turn % TOGETHER == TOGETHER - 1:
            dropped = dropped.checkpoint() if dropped.sparkSession.sparkContext.getCheckpointDir() else dropped.localCheckpoint()
        left = open_pairs.join(gone.withColumnRenamed("k", "b"), "b", "left_anti").join(gone.withColumnRenamed("k", "a"), "a", "left_anti").select("a", "b")
        open_pairs = left.checkpoint() if left.sparkSession.sparkContext.getCheckpointDir() else left.persist()
    return keys if dropped is None else keys.join(dropped.withColumnRenamed("k", key), key, "left_anti")


def semantic_dedup(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.90, block: int = BLOCK) -> DataFrame:
    """Rows that stay when rows too similar to a kept, earlier row of their group go; rows without a group or vector go too."""
    usable = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    return greedy_keep(similar_pairs(df, group, key, vector, threshold, block), usable, key)


def hashed_ngrams(texts: DataFrame, text: str = "text", name: str = "embedding", size: int = 64, n: int = 3) -> DataFrame:
    """A deterministic stand-in for a sentence encoder: signed counts of hashed character n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                v = np.zeros(size, np.float32)
                padded = f"  {(t or '').lower()} "
                for i in range(len(padded) - n + 1):
                    h = zlib.crc32(padded[i : i + n].encode())
                    v[h % size] += 1 if h & (1 << 20) else -1
                out.append(v.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, name])

    from sqlloom.session import ship_package

    ship_package(texts.sparkSession)
    return texts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + f", `{name}` array<float>")
