"""Personal data, and information-theoretic sanitisation of the terms that give it away.

Four kinds of protected entities are found by fixed patterns: email, ip, card, phone. A term (a word,
A-Z lower-cased) reveals them if it tells much of what there is to know about whether an entity is near:
with p(near) the share of all words within ``REACH`` words of an entity, and p(near | t) that share among
the term's occurrences, its disclosure is log(p(near | t) / p(near)) / -log(p(near)), the pointwise mutual
information as a part of the entities' information content: 1 for a term that stands next to entities
only. Terms of at least ``DISCLOSES`` that stand near ``VALUES`` different entities are marked too (kind
term); in a sanitised text they are generalised as the entities are, to the name of their kind.

All counts are over all words of all texts. A copied text shows the same entity, so copies alone do not
make a term reveal anything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import textkit as tk
from sqlloom.llm.staging import cut, in_arrow, stage

#: Words around an entity that count as near; disclosure and number of different entities that mark a term.
REACH, DISCLOSES, VALUES = 3, 0.8, 5
#: Terms that executors hold at a time (8 bytes each); more are counted and marked in several passes.
TERMS = 1 << 21

KINDS = ("email", "ip", "card", "phone")
#: The patterns after the sign by which each is found.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, int]  # kind, start, end


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(_LUHN[d] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The entities of ``text``, by kind, then start; code points, end exclusive."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _shown(spans: list[Span]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def _byte_offsets(data: np.ndarray) -> np.ndarray:
    """For each code point of a text's bytes, where it starts; then their number."""
    return np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]


def _near(words: tk.Words, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word is near an entity, word indices that are near, hash of the entity) for a slice."""
    near = np.zeros(len(words), bool)
    inside = np.zeros(len(words), bool)
    at: list[np.ndarray] = []
    value: list[np.ndarray] = []
    for i, text in enumerate(texts):
        spans = base_spans(text) if text else []
        if not spans:
            continue
        data = words.data[offsets[i] : offsets[i + 1]]
        place = _byte_offsets(data)
        low, high = words.first[i], words.first[i + 1]
        ranges = []
        for _, a, b in spans:
            first = np.searchsorted(words.end[low:high], offsets[i] + place[a], "right") + low
            last = np.searchsorted(words.start[low:high], offsets[i] + place[b], "left") + low
            inside[first:last] = True
            ranges.append((first, last, hashlib.blake2b(text[a:b].encode(), digest_size=8).digest()))
        for first, last, key in ranges:
            around = np.r_[max(low, first - REACH) : first, last : min(high, last + REACH)]
            near[around] = True
            at.append(around)
            value.append(np.full(len(around), int.from_bytes(key, "little"), np.uint64))
    if not at:
        return near, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, values = np.concatenate(at).astype(np.int64), np.concatenate(value)
    keep = ~inside[places]
    near &= ~inside
    return near, places[keep], values[keep]


def _nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, value): terms near entities and hashes of these; and under term null, the numbers of words and of near ones."""
    schema = pa.schema([("term", pa.int64()), ("value", pa.int64()), ("n", pa.int64()), ("near", pa.int64())])
    for batch in batches:
        for rows, data, offsets in tk.slices(batch):
            words = tk.Words(data, offsets, lower=True)
            near, places, values = _near(words, offsets, rows.column("text").to_pylist())
            terms = tk.signed(words.hash[places])
            n = len(places)
            yield pa.RecordBatch.from_arrays([
                pa.array([*terms.tolist(), None], pa.int64()), pa.array([*tk.signed(values).tolist(), None], pa.int64()),
                pa.array([0] * n + [len(words)], pa.int64()), pa.array([0] * n + [int(near.sum())], pa.int64()),
            ], schema=schema)


def _chunks(terms: DataFrame) -> Iterator[np.ndarray]:
    """All of a table of terms, in sorted arrays of at most about TERMS."""
    n = -(-terms.count() // TERMS)
    for i in range(n):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else terms
        yield np.sort(np.array([r[0] for r in part.select("term").toLocalIterator()], np.int64))


def _totals(held):
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("near", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        n, near_n = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets, lower=True)
                near, _, _ = _near(words, offsets, rows.column("text").to_pylist())
                terms = tk.signed(words.hash)
                i = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                on = wanted[i] == terms
                n += np.bincount(i[on], minlength=len(wanted))
                near_n += np.bincount(i[on & near], minlength=len(wanted))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(n[some]), pa.array(near_n[some])], schema=schema)

    return run


def revealing_terms(docs: DataFrame) -> DataFrame:
    """(term, disclosure) of the terms that reveal entities; term: the hash of the word."""
    seen = stage(docs.transform(in_arrow, _nearby, "term long, value long, n long, near long"), "nearby")
    all_words = seen.where("term is null").agg(F.sum("n"), F.sum("near")).first()
    words, near = (int(x or 0) for x in all_words)
    pairs = seen.where("term is not null").select("term", "value").distinct()
    candidates = cut(pairs.groupBy("term").agg(F.count("*").alias("values")).where(F.col("values") >= VALUES).select("term"))
    found = None
    for terms in _chunks(candidates) if 0 < near < words else ():
        held = docs.sparkSession.sparkContext.broadcast(terms)
        counted = docs.transform(in_arrow, _totals(held), "term long, n long, near long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
        found = cut(counted if found is None else found.union(counted))
    if found is None:
        return candidates.where("false").select("term", F.lit(0.0).alias("disclosure"))
    share = near / words
    disclosure = F.log(F.col("near") / F.col("n") / F.lit(share)) / F.lit(-np.log(share))
    return found.where("near > 0").select("term", disclosure.alias("disclosure")).where(F.col("disclosure") >= DISCLOSES)


def _term_spans(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, list[int]]:
    """For each text with such words, their starts and ends in code points."""
    words = tk.Words(data, offsets, lower=True)
    hit = np.flatnonzero(np.isin(tk.signed(words.hash), wanted))
    found: dict[int, list[int]] = {}
    if len(hit):
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        base = points[offsets[words.doc[hit]]]
        for d, a, b in zip(words.doc[hit].tolist(), (points[words.start[hit]] - base).tolist(), (points[words.end[hit]] - base).tolist()):
            found.setdefault(d, []).extend([a, b])
    return found


def _marks(held, column: str):
    """Add the spans of the held terms to the lists in ``column``, the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                found = _term_spans(data, offsets, held.value)
                lists = [[*(x or ()), *found.get(i, ())] for i, x in enumerate(rows.column(column).to_pylist())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(lists, rows.schema.field(column).type)], schema=rows.schema)

    return run


def _all_spans(text: str, terms: list[int] | None) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    covered = [(a, b) for _, a, b in base]
    extra = sorted({(4, a, b) for a, b in zip((terms or [])[::2], (terms or [])[1::2]) if not any(a < y and x < b for x, y in covered)})
    return base, base + extra


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for doc_id, text, terms in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "terms"))):
            base, spans = _all_spans(text or "", terms)
            kinds = [k for k, *_ in base]
            row = (doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans))
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)


def sanitised(text: str | None, terms: list[int] | None) -> str | None:
    """``text`` with every span generalised to the name of its kind; overlapping spans become one, of the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(_all_spans(text, terms)[1], key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{(*KINDS, 'term')[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a last column of the revealing terms' starts and ends, and that column's name."""
    column = "terms"
    while column in docs.columns:
        column += "_"
    marked = docs.withColumn(column, F.expr("cast(array() as array<bigint>)"))
    for i, terms in enumerate(_chunks(cut(revealing_terms(docs.select("text"))))):
        held = docs.sparkSession.sparkContext.broadcast(terms)
        marked = stage(marked, "marked") if i else marked
        marked = marked.transform(in_arrow, _marks(held, column), marked.schema)
    return marked, column


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty and has no spans. A row with a null id is searched like the others; rows
    repeated under one id give one row each. A term inside an entity is no span of its own.
    """
    marked, _ = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return marked.transform(in_arrow, _report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each text sanitised; n_chars, if there, follows. Null texts stay null; other columns stay."""
    marked, column = _marked(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sanitised(t, spans) for t, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist())]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = marked.transform(in_arrow, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
