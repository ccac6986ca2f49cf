"""Packing token sequences along a space-filling curve.

A document's hashed word vector is projected to three dimensions, and its place on a Hilbert curve through
them is its key: documents with near keys have similar words. Documents are sorted by ranges of the key,
and the tokens of neighbours are laid end to end and cut every ``length`` tokens. A range is packed by one
task, and only its last sequence is short, so padding is under ``length`` tokens a range. Documents with
equal keys are told apart by a hash of the id, so copies of one text spread over ranges.

Tokens come from a byte-level BPE vocabulary in a ``tokenizers`` JSON file. Texts are split into
pre-tokens for many documents at once, and the ids of each distinct one are looked up or computed once;
texts with characters beyond ``SIMPLE``, or with a special token of the file in them, go through the tokenizers
library as the file sets it up. Both give equal ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import textkit as tk
from sqlloom.llm.staging import in_arrow, stage

#: Tokens of a sequence, and the id that ends each document.
LENGTH, END = 2048, 1
#: Bytes of text in a range, so of a task: the ranges are in proportion to the input.
RANGE_BYTES = 24 << 20
#: Cells of the curve into which keys are counted to find the ranges' edges, a power of two.
CELLS = 1 << 20
#: Code points below it are split here, others by the tokenizers library.
SIMPLE = 0x250
#: Distinct pre-tokens kept by a worker.
KEPT = 300_000
_DIMENSIONS, _BITS = 3, 10
_BEYOND = re.compile(f"[^\0-{chr(SIMPLE - 1)}]")
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows; each coordinate of ``bits`` bits)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the curve's turns, from the largest cubes to the smallest
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A document's key: its place on the curve, then 32 bits of its id's hash."""
    words = tk.Words(data, offsets, lower=True)
    bits = tk.mix(words.hash ^ np.uint64(0xC0FFEE))
    n = np.sqrt(np.maximum(words.counts, 1))
    sums = [np.bincount(words.doc, np.where((bits >> np.uint64(8 * d)) & np.uint64(1), 1.0, -1.0), words.n_docs) / n for d in range(_DIMENSIONS)]
    cells = np.stack([np.minimum((1 << _BITS) - 1, (1 << _BITS) / (1 + np.exp(-np.clip(s, -20, 20)))) for s in sums], 1).astype(np.int64)
    return (hilbert(cells, _BITS) << 32) | (tk.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str):
    return Encoder(path)


class Encoder:
    """Token ids by the vocabulary of a byte-level BPE JSON file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, self.special = file["model"]["vocab"], [t["content"] for t in file.get("added_tokens", [])]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in self.special}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece  # of a pre-token's bytes, without the pattern
        self.whole = Tokenizer.from_file(path)
        self.type = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.kept: dict[bytes, bytes] = {}
        kinds = np.full(SIMPLE, _OTHER, np.uint8)
        for c in range(SIMPLE):
            category = unicodedata.category(chr(c))
            kinds[c] = _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _OTHER
        kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
        self.kinds = kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, in the joined code points of non-empty texts; ``first``: where texts do."""
        kinds = self.kinds[points]
        n = len(points)
        begins = np.zeros(n + 1, bool)
        begins[first] = begins[n] = True
        new = begins.copy()
        new[1:n] |= kinds[1:] != kinds[:-1]
        run = np.flatnonzero(new)  # runs of one kind, then n
        at, kind, length, last = run[:-1], kinds[run[:-1]], np.diff(run), run[1:] - 1
        before_more = ~begins[run[1:]]  # the text goes on after the run
        start = np.zeros(n, bool)
        start[at] = True
        # The last blank before other characters stands alone, or leads their pre-token if it is a space.
        blank = (kind == _SPACE) & before_more
        start[last[blank]] = True
        leads = blank & (points[last] == 32)
        start[last[leads] + 1] = False
        # An apostrophe that starts a pre-token and an ending after it are one pre-token.
        led = np.r_[False, leads[:-1]]
        quote = np.flatnonzero((kind == _OTHER) & (length == 1) & (points[at] == 39) & before_more & ~led)
        if len(quote):
            quote = quote[kind[quote + 1] == _LETTER]
            one = at[quote] + 1
            c, room = points[one], length[quote + 1]
            d = np.where(room > 1, points[np.minimum(one + 1, n - 1)], 0)
            two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
            single = np.isin(c, [ord(x) for x in "stmd"])
            size = np.where(single, 1, np.where(two, 2, 0))
            hit = size > 0
            start[one[hit]] = False
            more = hit & (room > size)
            start[one[more] + size[more]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, none added, as unsigned numbers of 16 bits, or 32 for larger vocabularies."""
        out: list[np.ndarray | None] = [None] * len(texts)
        simple = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, self.type)
            elif (text.isascii() or not _BEYOND.search(text)) and not any(t in text for t in self.special):
                simple.append(i)
            else:
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type)
        if simple:
            joined = "".join(texts[i] for i in simple)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(texts[i]) for i in simple])
            first = np.r_[0, ends[:-1]]
            starts = self._starts(points, first)
            bounds = np.r_[starts, len(points)]
            hashes = tk.mix(tk.span_hashes(tk.mix(points.astype(np.uint64) + np.uint64(7)), bounds[:-1], bounds[1:], 0x9E3779B97F4A7C15))
            _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.kept) > KEPT:
                self.kept.clear()
            pieces, kept, width = [], self.kept, np.dtype(self.type).itemsize
            code, raw = "H" if width == 2 else "I", joined.encode()
            at = bounds + np.r_[0, np.cumsum(points >= 0x80, dtype=np.int32)][bounds]  # in bytes: simple characters have one or two
            for low, high in zip(at[where].tolist(), at[where + 1].tolist()):
                piece = raw[low:high]
                ids = kept.get(piece)
                if ids is None:
                    ids = kept[piece] = array(code, self.piece(piece)).tobytes()
                pieces.append(ids)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
            table, base = np.frombuffer(b"".join(pieces), self.type), np.cumsum(sizes) - sizes
            each = sizes[back]
            ahead = np.cumsum(each) - each
            ids = table[np.repeat(base[back] - ahead, each) + np.arange(int(each.sum()))]
            cuts = np.r_[ahead, len(ids)][np.searchsorted(starts, np.r_[first, len(points)])]
            for i, a, b in zip(simple, cuts[:-1], cuts[1:]):
                out[i] = ids[a:b]
        return out


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tk.slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(_ids(rows), data, offsets)), pa.array(np.diff(offsets))], ["key", "size"])


def _tokens(path: str, edges: list[int]):
    schema = pa.schema([("bucket", pa.int32()), ("width", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, upper = _encoder(path), np.array(edges, np.int64)
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                keys = curve_keys(_ids(rows), data, offsets)
                ids = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
                end = np.array([END], encoder.type).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(upper, keys, "right").astype(np.int32)), pa.array(np.full(len(keys), encoder.type(0).itemsize, np.int32)), pa.array(keys), rows.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() + end for x in ids], pa.binary()),
                ], schema=schema)

    return run


def _pack(length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0  # tokens laid so far in this range
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for b, width, doc_id, raw in zip(batch.column("bucket").to_pylist(), batch.column("width").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if b != bucket:
                    bucket, at = b, 0
                ids = np.frombuffer(raw.as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4")
                start = 0
                while start < len(ids):
                    size = min(length - at % length, len(ids) - start)
                    piece = (doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), (b << 40) | at // length, at % length)
                    for column, value in zip(out, piece):
                        column.append(value)
                    start += size
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def range_edges(keys: DataFrame) -> list[int]:
    """The first keys of all ranges but the first, from keys and sizes: ranges hold about RANGE_BYTES each.

    Bytes are counted by cells of the curve, at most CELLS, and those of cells over half a range by the keys' next bits, level by level;
    the last bits are a hash of the id, so copies of one text are split as well.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if total <= RANGE_BYTES:
        return []
    shift, step, cells = 62, CELLS.bit_length() - 1, []
    open_cells = None
    while shift > 0:
        below = max(0, shift - step)
        inside = keys if open_cells is None else keys.join(F.broadcast(open_cells), F.expr(f"shiftrightunsigned(key, {shift})") == F.col("parent"), "left_semi")
        counted = inside.groupBy(F.expr(f"shiftrightunsigned(key, {below})").alias("cell")).agg(F.sum("size").alias("bytes"))
        rows = counted.collect()  # at most CELLS of the curve, and as many of each large cell
        large = [r["cell"] for r in rows if r["bytes"] > RANGE_BYTES // 2]
        cells += [(r["cell"] << below, r["bytes"]) for r in rows if r["bytes"] <= RANGE_BYTES // 2 or not below]
        if not large or not below:
            break
        open_cells, shift, step = keys.sparkSession.createDataFrame([(c,) for c in large], "parent long"), below, 6
    edges, held = [], 0
    for key, size in sorted(cells):
        if held and held + size > RANGE_BYTES:
            edges.append(key)
            held = 0
        held += size
    return edges


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: path of the JSON file, the same on all executors. A null or empty text is the end id
    alone. A row with a null id is packed like the others; rows repeated under one id are packed each.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stage(docs.transform(in_arrow, _keys, "key long, size long"), "keys")
    edges = range_edges(keys)
    laid = docs.transform(in_arrow, _tokens(tokenizer, edges), "bucket int, width int, key long, doc_id long, ids binary")
    laid = laid.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("bucket", "key", "doc_id")
    return laid.transform(in_arrow, _pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
