"""Benchmark decontamination by SimHash fingerprints of item-sized windows, with DataFrame functions only.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``. A benchmark item of n words is compared with
windows of n words of a document, at every start; a text of fewer words is one window, all of it. A window's
fingerprint is the 64-bit SimHash of its words. Fingerprints are cut into ``RADIUS + 1`` blocks: two within
``RADIUS`` bits agree in one block at least, so an equality join on (size, block number, block) finds all of
them. Candidates are then compared exactly: the weighted Jaccard similarity of their 5-word shingles (each
weighs its number of occurrences) must reach ``percent``.

A window's similarity to any item of its size is bounded by how many of its shingles occur in such items at
all, so only windows that hold enough of these are fingerprinted: at every start, whatever the order or
place of the shingles. The bound loses nothing: other windows cannot reach ``percent``. About a fifth of an
item's length of starts pass around a passage that holds it, so the cost of a found passage is quadratic in
the item's length; items of up to some thousands of words are meant.

Where an item has fewer than 5 words, its shingle is all of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.staging import broadcast_if, stage

#: Words of a shingle, bits within which fingerprints are found, and the similarity in percent.
SHINGLE, RADIUS, PERCENT = 5, 15, 80
#: The items' shingles and blocks are broadcast up to this many rows (under 64 bytes each), lists of windows up to so many bytes; else joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 18, 16 << 20

#: Fixed value: the words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), 0)


def _shingles(words: str, size: int) -> str:
    """SQL: the hash of each window of ``size`` words, in order."""
    return f"if(size({words}) < {size}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {size}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(size))})))"


def _shingles_by(short: str, words: str) -> Column:
    """The shingles of as many words as column ``short`` says."""
    return F.expr(f"case {short} " + " ".join(f"when {k} then {_shingles(words, k)}" for k in range(1, SHINGLE + 1)) + " end")


def _lanes(words: str, width: int) -> str:
    """SQL: SimHash of fewer than 2 ** (width - 1) words, counted in lanes of ``width`` bits of ``width`` longs."""
    ones = sum(1 << (width * j) for j in range(64 // width))
    names = [f"s{k}" for k in range(width)]
    zero = "named_struct(" + ", ".join(f"'{n}', 0L" for n in names) + ")"
    step = "named_struct(" + ", ".join(f"'{n}', a.{n} + (shiftrightunsigned(h, {k}) & {ones}L)" for k, n in enumerate(names)) + ")"
    # Lane j of s_k counts bit width j + k; it is set where the count is over half of the words.
    bits = " | ".join(f"if((shiftrightunsigned(a.s{k}, {width * j}) & {(1 << width) - 1}L) > size({words}) div 2, shiftleft(1L, {width * j + k}), 0L)" for k in range(width) for j in range(64 // width))
    return f"aggregate(transform({words}, w -> xxhash64(w, 'simhash')), {zero}, (a, h) -> {step}, a -> {bits})"


def _fingerprint(words: str) -> Column:
    """SimHash of an array of words: bit b is set where most words' hashes have it."""
    return F.expr(f"if(size({words}) < 32768, {_lanes(words, 16)}, {_lanes(words, 32)})")


def _blocks(fingerprint: str) -> Column:
    """(number, value) of the RADIUS + 1 blocks of 64 bits."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.expr("array(" + ", ".join(f"named_struct('number', {i}, 'value', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + ")")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, version, words, n, short, shingles) of the items that have words; version tells texts of one id apart."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    items = items.withColumn("version", F.xxhash64("words")).withColumn("n", F.size("words")).withColumn("short", F.least("n", F.lit(SHINGLE)))
    return items.withColumn("shingles", _shingles_by("short", "words"))


def _starts(percent: int) -> Column:
    """Of sorted ``places`` of shingles that occur in items of ``n`` words: the starts of all windows that hold enough of them; -1: a whole text of fewer words.

    With m shingles in a window and an item each, the similarity reaches percent only if ``need`` of them are common.
    """
    m = "(n - short + 1)"
    need = f"(({2 * percent} * {m} + {99 + percent}) div {100 + percent})"
    spans = f"transform(sequence(0, size(places) - {need}), i -> if(places[i + {need} - 1] - places[i] < {m}, sequence(greatest(0, places[i + {need} - 1] - {m} + 1), places[i]), cast(array() as array<int>)))"
    whole = f"if(least_length < n and 100 * size(places) >= {percent} * {m}, array(-1), cast(array() as array<int>))"
    return F.expr(f"array_distinct(concat(if(size(places) < {need}, cast(array() as array<int>), flatten({spans})), {whole}))")


def windows_of(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, short, starts): for each document and item size, the windows to look at."""
    sizes = [r["short"] for r in items.select("short").distinct().collect()]  # at most SHINGLE values
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words"))
    found = None
    for size in sorted(sizes):
        wanted = broadcast_if(items.where(F.col("short") == size).select("n", F.explode("shingles").alias("shingle")).distinct(), BROADCAST_ROWS)
        placed = keyed.select("doc_id", F.size("words").alias("length"), F.posexplode(F.expr(_shingles("words", size))).alias("place", "shingle"))
        placed = placed.join(wanted, "shingle").select("doc_id", "n", F.lit(size).alias("short"), "length", "place")
        found = placed if found is None else found.union(placed)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, n int, short int, starts array<int>")
    by_document = found.groupBy("doc_id", "n", "short").agg(F.min("length").alias("least_length"), F.sort_array(F.collect_set("place")).alias("places"))
    return by_document.select("doc_id", "n", "short", _starts(percent).alias("starts")).where("size(starts) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, start, similarity): each document and item that it holds, with its best window.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. ``start`` is the window's first word, counted
    from 0 (the first of equally similar ones). Null, empty and wordless texts hold nothing, and such
    items are nowhere held; rows with a null id are left out; rows repeated under one id count as one
    document, rows repeated under one item_id as one item that any of them stands for.
    """
    items = items_of(benchmark)
    listed = stage(windows_of(docs, items, percent), "windows")
    size = listed.agg(F.sum(F.expr("32 + 4 * size(starts)"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, "doc_id")
    # Cut out in one projection and written, so that no filter that Catalyst moves or infers splits the texts again.
    of_start = "if(s < 0, if(size(words) < n and size(words) >= short, words, null), if(s + n <= size(words), slice(words, s + 1, n), null))"
    cut_out = texts.select("doc_id", "n", "short", "starts", _words(F.col("text")).alias("words"))
    cut_out = stage(cut_out.select("doc_id", "n", "short", F.expr(f"filter(transform(starts, s -> named_struct('start', greatest(s, 0), 'words', {of_start})), w -> w.words is not null)").alias("cut")), "cut")
    windows = cut_out.select("doc_id", "n", "short", F.explode("cut").alias("w")).select("doc_id", "n", "short", "w.start", "w.words")
    in_blocks = windows.withColumn("print", _fingerprint("words")).withColumn("content", F.xxhash64("words")).select("*", F.explode(_blocks("print")).alias("block"))
    prints = items.withColumn("item_print", _fingerprint("words")).select("item_id", "version", "n", "item_print", F.explode(_blocks("item_print")).alias("block"))
    near = in_blocks.join(broadcast_if(prints, BROADCAST_ROWS), ["n", "block"]).where(f"bit_count(print ^ item_print) <= {RADIUS}")
    key = ["doc_id", "start", "content", "item_id", "version"]
    near = stage(near.groupBy(*key).agg(F.first("n").alias("n"), F.first("short").alias("short"), F.first("words").alias("words")), "near")
    # Exact: over the shingles of both, the smaller number of occurrences.
    mine = near.select(*key, F.explode(_shingles_by("short", "words")).alias("shingle")).groupBy(*key, "shingle").agg(F.count("*").alias("here"))
    theirs = items.select("item_id", "version", F.explode("shingles").alias("shingle")).groupBy("item_id", "version", "shingle").agg(F.count("*").alias("there"))
    common = mine.join(broadcast_if(theirs, BROADCAST_ROWS), ["item_id", "version", "shingle"]).groupBy(*key).agg(F.sum(F.least("here", "there")).alias("common"))
    likeness = near.select(*key, F.expr("n + size(words) - 2 * short + 2").alias("both")).join(common, key)
    likeness = likeness.where(f"100 * common >= {percent} * (both - common)").withColumn("similarity", F.expr("cast(common as double) / (both - common)"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best")
    return likeness.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.start").alias("start"), (-F.col("best.s")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay, as they can't be named."""
    held = stage(contaminated(docs, benchmark, percent).select("doc_id").distinct(), "held")
    return docs.join(broadcast_if(held, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
