"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it
also starts, word for word, in a document with a smaller id. Windows are judged on the input.

Levels: first the half-length windows, of which each full window names one, its smallest by hash (so
equal windows name equal ones, and about one position in thirteen is named). Only half windows that
two documents name survive. If all their documents agree on the full windows around a half window, that
settles them; else those windows are extended to twice the length and compared themselves. A document
is never compared with another one: each level is one aggregation by hash.

Defined results: a null or empty text has no words and loses none; a row with a null id is left whole;
rows repeated under one id are treated alike and don't remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import textkit as tk
from sqlloom.llm.staging import broadcast_if, in_arrow, stage

#: Ids of documents to look at again are sent to all executors up to this many (8 bytes each), else joined.
BROADCAST_IDS = 1 << 20


def _named(words: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the full windows, hashes of the half windows that they name, their own hashes)."""
    n, half = len(words), (window + 1) // 2
    if n < window:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    at = np.arange(n - half + 1)
    least = tk.mix(words.windows(at, at + half))
    span, width = window - half + 1, 1
    whole = least
    while width * 2 <= span:
        whole = np.minimum(whole[: len(whole) - width], whole[width:])
        width *= 2
    rest = span - width
    least = np.minimum(whole[: len(whole) - rest], whole[rest:]) if rest else whole
    starts = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    return starts, least[starts], words.windows(starts, starts + window)


def _sha(data: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(data.tobytes().split())).hexdigest()


def _first_level(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("half", pa.list_(pa.int64())), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets)
                starts, named, full = _named(words, window)
                docs = words.doc[starts]
                if len(starts):
                    new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (docs[1:] != docs[:-1])])
                    docs, named, around = docs[new], named[new], np.add.reduceat(tk.mix(full), new)
                    order = np.lexsort((named, docs))
                    docs, named, around = docs[order], named[order], around[order]
                    new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (docs[1:] != docs[:-1])])
                    docs, named, around = docs[new], named[new], np.add.reduceat(around, new)
                else:
                    around = named
                at = pa.array(np.searchsorted(docs, np.arange(len(offsets))).astype(np.int32))
                shas = [_sha(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").cast(pa.int64()), pa.array(words.counts.astype(np.int64)), pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(at, pa.array(tk.signed(named))), pa.ListArray.from_arrays(at, pa.array(tk.signed(around))),
                ], schema=schema)

    return run


def _flat(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column's values; null lists have none."""
    column = rows.column(name)
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _member(docs: np.ndarray, values: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(tk.mix(values ^ (docs.astype(np.uint64) * salt)), tk.mix(of[1] ^ (of[0].astype(np.uint64) * salt)))


def _second_level(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("half", pa.int64()), ("full", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets)
                starts, named, full = _named(words, window)
                docs = words.doc[starts]
                on = _member(docs, named, _flat(rows, "open"))
                docs, named, full = docs[on], named[on], full[on]
                key = tk.mix(full ^ tk.mix(named) ^ (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                once = np.unique(key, return_index=True)[1]
                ids = rows.column("doc_id").cast(pa.int64()).take(pa.array(docs[once]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(tk.signed(named[once])), pa.array(tk.signed(full[once]))], schema=schema)

    return run


def _removal(window: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets)
                starts, named, full = _named(words, window)
                docs = words.doc[starts]
                hit = _member(docs, named, _flat(rows, "settled")) | _member(docs, full ^ tk.mix(named), _flat(rows, "hits"))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts[hit], 1)
                np.add.at(cover, starts[hit] + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = np.bincount(words.doc[gone], minlength=words.n_docs)
                keep = data.copy()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, words.start[gone], 1)
                np.add.at(edge, words.end[gone], -1)
                keep[np.cumsum(edge[:-1]) > 0] = 32
                kept = [b" ".join(keep[a:b].tobytes().split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                out = [
                    rows.column("doc_id").cast(pa.int64()), pa.array([_sha(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                    pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out + [pa.array([x.decode() for x in kept], pa.string())] * with_text, schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stage(docs.transform(in_arrow, _first_level(window), "doc_id long, n_words long, sha string, half array<long>, around array<long>"), "halves")
    named = first.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("half", "around")).alias("x")).select("doc_id", "x.half", "x.around")
    repeated = (
        named.groupBy("half")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("around") != F.max("around")).alias("open"))
        .where("least < most")
        .select("half", "least", "open")
    )
    again = stage(
        named.select("doc_id", "half")
        .join(repeated, "half")
        .where("open or doc_id > least")
        .groupBy("doc_id")
        .agg(F.collect_list(F.expr("if(open, half, null)")).alias("open"), F.collect_list(F.expr("if(open, null, half)")).alias("settled")),
        "again",
    )
    ids = broadcast_if(again.select("doc_id"), BROADCAST_IDS)
    texts = docs.join(ids, "doc_id", "left_semi")
    full = stage(texts.join(again.where("size(open) > 0").select("doc_id", "open"), "doc_id").transform(in_arrow, _second_level(window), "doc_id long, half long, full long"), "full")
    twice = full.groupBy("half", "full").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("half", "full", "least")
    hits = (
        full.join(twice, ["half", "full"])
        .where("doc_id > least")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("half", "full")).alias("pairs"))
        .select("doc_id", F.col("pairs.half").alias("hit_half"), F.col("pairs.full").alias("hit_full"))
    )
    todo = again.select("doc_id", "settled").join(hits, "doc_id", "left").where("size(settled) > 0 or hit_full is not null")
    extra = ", kept_text string" if with_text else ""
    removed = (
        texts.join(todo, "doc_id")
        .transform(in_arrow, _with_hits(_removal(window, with_text)), f"doc_id long, sha string, n_removed long, kept_sha256 string{extra}")
        .dropDuplicates(["doc_id", "sha"])
    )
    out = first.select("doc_id", "n_words", "sha").join(removed, ["doc_id", "sha"], "left")
    if with_text:
        plain = docs.select("doc_id", "text")
        out = out.dropDuplicates(["doc_id", "sha"]).join(plain, "doc_id").withColumn("kept_text", F.coalesce("kept_text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept_text"] if with_text else [])
    )


def _with_hits(removal):
    """Give ``removal`` one hash for each pair of hit_half and hit_full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                half, full = _flat(batch, "hit_half")[1], _flat(batch, "hit_full")[1]
                lengths = [0 if x is None else x for x in batch.column("hit_full").value_lengths().to_pylist()]
                at = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                hits = pa.ListArray.from_arrays(at, pa.array(tk.signed(full ^ tk.mix(half))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("settled"), hits], ["doc_id", "text", "settled", "hits"])

        yield from removal(paired(batches))

    return run
