"""Toxicity by compression distance to two zstandard dictionaries.

Two dictionaries are trained by zstandard's own trainer, one on toxic and one on ordinary labelled texts. Texts of both
classes are mostly alike, and a trainer that sees all of them finds only that; so each is trained on the passages of
its class that tell the classes apart: a word with its neighbours, for words that stand in one class in many different
contexts (copies of a text thus count once) and in the other in comparatively few. Each is raw content, followed by a
part in common, trained on windows of all ordinary texts; it lies at the same distance in both, so ordinary words cost
the same under either.

A text is cut into windows of ``WINDOW`` words (all of it, each word once). A window's distance is its
compressed length under the ordinary dictionary less that under the toxic one. A text's distances give a
few numbers, and a logistic threshold on these, calibrated on labelled texts that neither dictionary was
trained on, gives the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.staging import broadcast_if, in_arrow, stage

#: Labelled texts that are learned from, all of each: at most this many, those with the smallest hash of doc_id.
LABELLED_ROWS = 6_000
#: Windows of ordinary texts that the common part is trained on: those with the smallest hash of doc_id and window.
COMMON_WINDOWS = 40_000
#: Words of a window; words on each side of a telling one; bytes of a dictionary's own and common parts.
WINDOW, AROUND, OWN_BYTES, COMMON_BYTES = 12, 1, 2 << 10, 16 << 10
#: Passages that a dictionary's own part is trained on: those with the smallest hash.
PASSAGES = 200_000
#: A word belongs to a class from so many contexts there, and this many times as often as in the other.
CONTEXTS, TIMES = 6, 8
#: Remainder of crc32(doc_id) modulo 5 that is held out, and the one that calibrates.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 4

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EDGE = b".,;:!?|*#$%&\"()<>"


def fold(doc_id: int | None) -> int:
    """crc32 of the id as decimal text, modulo FOLDS; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def _windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _add_contexts(words: list[bytes], seen: set[int], counts: Counter[bytes]) -> None:
    """Count, for each word, its pairs of neighbours that were not seen before."""
    bare = [b"", *(w.strip(_EDGE) for w in words), b""]
    for around in zip(bare, bare[1:], bare[2:]):
        if (key := hash(around)) not in seen:
            seen.add(key)
            counts[around[1]] += 1


def _telling(mine: Counter[bytes], other: Counter[bytes]) -> frozenset[bytes]:
    """The words that stand in many contexts of a class, and in comparatively few of the other one."""
    mine_all, other_all = max(1, sum(mine.values())), max(1, sum(other.values()))
    return frozenset(w for w, n in mine.items() if n >= CONTEXTS and len(w) > 3 and n / mine_all > TIMES * (other[w] + 0.5) / other_all)


def _passages(words: list[bytes], telling: frozenset[bytes], seed: int) -> Iterator[tuple[int, bytes]]:
    """(hash, passage) around each telling word of a text."""
    bare = [w.strip(_EDGE) for w in words]
    for i, w in enumerate(bare):
        if w in telling:
            yield zlib.crc32(str(i).encode(), seed), b" " + b" ".join(bare[max(0, i - AROUND) : i + AROUND + 1]) + b" "


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """A dictionary of ``size`` bytes, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """The dictionaries and the calibrated threshold; plain data, so it can be sent to executors."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @cached_property
    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            one = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(
                window_log=16, hash_log=15, chain_log=16, search_log=4, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            one.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=one))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def distances(self, text: str) -> np.ndarray:
        ordinary, toxic = (c.compress for c in self._compressors)
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in _windows(_words(text))], np.float64)

    def numbers(self, text: str) -> np.ndarray:
        d = self.distances(text)
        if not len(d):
            return np.zeros(6)
        up = np.sort(np.maximum(d, 0))[::-1]
        return np.array([d.mean(), up[0], up[:3].sum(), np.log1p(up.sum()), (d >= 3).mean(), np.log1p((d >= 3).sum())])

    def score(self, text: str) -> float:
        z = float(((self.numbers(text) - self.mean) / self.scale) @ self.weights[1:] + self.weights[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the constant first) by ridge-regularised Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(read: Callable[[], Iterable[tuple[int, str, int]]]) -> Model:
    """The dictionaries, not calibrated, from rows of doc_id, text, toxic, which are read twice, one text at a time."""
    seen: list[set[int]] = [set(), set()]
    by_class: list[Counter[bytes]] = [Counter(), Counter()]
    chosen: list[tuple[int, bytes]] = []
    for d, t, y in read():
        words = _words(t)
        _add_contexts(words, seen[y], by_class[y])
        if not y:
            of_id = zlib.crc32(str(d).encode())
            chosen += [(zlib.crc32(x, of_id), x) for x in _windows(words)]
            if len(chosen) > 4 * COMMON_WINDOWS:
                chosen = sorted(chosen)[:COMMON_WINDOWS]
    common = _trained(COMMON_BYTES, [x for _, x in sorted(chosen)[:COMMON_WINDOWS]], 30)
    telling = [_telling(by_class[y], by_class[1 - y]) for y in (0, 1)]
    passages: list[list[tuple[int, bytes]]] = [[], []]
    for d, t, y in read():
        passages[y] += _passages(_words(t), telling[y], zlib.crc32(str(d).encode()))
        if len(passages[y]) > 4 * PASSAGES:
            passages[y] = sorted(passages[y])[:PASSAGES]
    ordinary, toxic = (_trained(OWN_BYTES, [x for _, x in sorted(p)[:PASSAGES]], 24).rjust(OWN_BYTES, b"\0") + common for p in passages)
    return Model(toxic, ordinary, np.zeros(6), np.ones(6), np.zeros(7))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> None:
    """Fit the threshold to whole texts' numbers; where these are of one class, to the share of toxic rows."""
    if len(set(y)) < 2:
        share = np.clip(share, 0.001, 0.999)
        model.weights[0] = np.log(share / (1 - share))
        return
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels``: doc_id, toxic. A null text counts as empty; an empty text has no window and gets the score
    of zero distances. A row with a null id is scored too; rows repeated under one id give one row each and
    are learned from once where their texts are equal. Without labels every score is that of the classes' share, or 0.001.
    """
    from pyspark.sql.types import LongType

    docs = docs.select(F.col("doc_id").cast(LongType()).alias("doc_id"), "text")
    remainder = F.expr(f"crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % {FOLDS}")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(remainder != HELD_OUT)
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id", "toxic").limit(LABELLED_ROWS)
    sample = docs.join(broadcast_if(chosen, LABELLED_ROWS), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    sample = stage(sample.distinct(), "labelled")
    context = docs.sparkSession.sparkContext
    taught = sample.where(remainder != CALIBRATES).orderBy("doc_id", "text", "toxic")
    learned = learn(lambda: ((r["doc_id"], r["text"], r["toxic"]) for r in taught.toLocalIterator()))
    dictionaries = context.broadcast(learned)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = dictionaries.value
        for batch in batches:
            numbers = [use.numbers(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(numbers, pa.list_(pa.float64()))], ["doc_id", "toxic", "numbers"])

    checks = sample.where(remainder == CALIBRATES).repartition(context.defaultParallelism).transform(in_arrow, measured, "doc_id long, toxic int, numbers array<double>")
    found = sorted((r["doc_id"], r["toxic"], r["numbers"]) for r in checks.collect())  # six numbers a row of the sample
    calibrate(learned, np.array([n for *_, n in found]), np.array([y for _, y, _ in found], np.float64), sample.agg(F.avg("toxic")).first()[0] or 0)
    model = context.broadcast(learned)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            scores = [use.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([fold(d) == HELD_OUT for d in ids]), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=schema
            )

    return docs.transform(in_arrow, run, "doc_id long, held_out boolean, score double, predicted int")
