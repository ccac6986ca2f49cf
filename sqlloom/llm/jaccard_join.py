"""Self-join of documents on the Jaccard similarity of their shingle sets, by PartEnum signatures.

Two sets link when ``100 * intersection >= percent * union``. Sizes fall into bands; a set belongs to its
own band's tag and, if it is within reach of the next band, to that one's tag too, so two sets that link
share a tag. With ``k`` the largest difference (in elements) of two linking sets of a tag, the shingle
domain is split by hash into ``k div 2 + 1`` first-level groups, of which one has at most one difference,
each group into three parts, and a signature is the content of two of a group's parts: linking sets share
one. Parts without elements agree in any two sets, so each tag has spare groups, and only a set with more groups
with empty parts than spare ones gives signatures for these too.

Sets that share a signature are candidates; the links among them are found without making all pairs. Of a
signature with few sets all pairs are compared. Of others one set, the pivot, is compared with the rest:
the one that shares most with most, so in a group of near copies the one that they are copies of. Let D(x)
be the elements in which x and the pivot differ: x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|. So if
they link, D(x) and D(y) overlap by at least half of |D(x)| + |D(y)| less the difference allowed, and in any
common order of elements their prefixes of suitable lengths meet (see ``_lengths``). The order is rarest
first, among the sets compared with that pivot: what single copies changed comes first and meets nothing.
Sets that did not link with the pivot are dealt out again by their prefixes, together with the linked ones,
and these smaller groups are searched in the same way, until none holds two components, or until so few sets are left
in them that comparing all of a group, block with block, sends few texts (see ``_blockwise``): that ends the search. The
similarity is always the exact one of the two texts. Equal sets are one node, named by the hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import textkit as tk
from sqlloom.llm.components import components
from sqlloom.llm.staging import broadcast_if, drop, in_arrow, release, shuffles_cleaned, stage
from sqlloom.llm.url_filter import KEYS_PER_BLOCK, LONGS, _bits, bloom_blocks

#: Rows of ids, or of pairs to compare, that are sent to all executors (under 64 bytes each); beyond, joins are shuffled, of the texts that a Bloom filter of as many rows passes.
BROADCAST_ROWS = 1 << 18
#: Upper end over lower end of a size band.
BAND = 1.25
#: Groups in which one side has at most so many sets are compared pair by pair; sets compared with a pivot by one task.
SMALL, CHUNK = 4, 256
#: Sets of a group that are compared with as many others at once, and texts a node that may be sent for that at first (four times as many each round).
BLOCK, TEXTS = 128, 1
#: Of the texts sent to be compared, with pivots or in blocks, how many a node are shuffled at once, which bounds the shuffle's files.
AT_ONCE = 0.5
#: So few texts to be compared with pivots go at once anyway.
FEW_TEXTS = 1 << 14
#: Elements a node in which sets differ from their pivots, and how many anyway, that are dealt again at once.
ELEMENTS, FEW_ELEMENTS = 24, 1 << 20
#: Parts that the signatures are shuffled in; texts are signed once for each.
PASSES = 3
#: The parts of a group that make a signature.
_SUBSETS = ((0, 1), (0, 2), (1, 2))


@lru_cache(maxsize=8)
def _tags(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends of the bands, largest differences, numbers of groups), up to a band that holds ``largest``."""
    low, high = [1], [1]
    while high[-1] < largest:
        low.append(high[-1] + 1)
        high.append(max(int(low[-1] * BAND), low[-1] * 100 // percent))
    differences = [h * 2 * (100 - percent) // (100 + percent) for h in high]
    groups = [k // 2 + 1 + _spare(k // 2 + 1, n * percent / 100) if k else 1 for n, k in zip(low, differences)]
    return np.array(low), np.array(differences), np.array(groups)


def _spare(needed: int, least: float) -> int:
    """Groups to add, so that a set of ``least`` elements hardly has more groups with an empty pair of parts than these."""
    for deviations in (1.5, 0.75, 0):
        for spare in range(1, needed + 1):
            empty = 3 * (needed + spare) * np.exp(-2 * least / (3 * (needed + spare)))
            if spare >= empty + deviations * np.sqrt(empty):
                return spare
    return 1  # small sets: those with more empty groups give signatures for these as well


def distinct_shingles(words: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each text's set of shingles, in that order."""
    docs, shingles = words.shingles(size)
    order = np.lexsort((shingles, docs))
    docs, shingles = docs[order], shingles[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (shingles[1:] != shingles[:-1])] if len(docs) else np.zeros(0, bool)
    return docs[new], shingles[new]


def set_names(docs: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's set, from two sums over its elements."""
    a = tk.group_sum64(docs, tk.mix(shingles ^ np.uint64(0xA5A5)), n)
    b = tk.group_sum64(docs, tk.mix(shingles + np.uint64(0x5A5A5A)), n)
    return tk.mix(a ^ tk.mix(b))


def _signatures(docs: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, signature) of all texts' signatures."""
    low, most, all_groups = _tags(percent, 1 << max(8, int(sizes.max(initial=1)).bit_length() + 2))
    band = np.searchsorted(low, sizes, "right") - 1
    out_docs, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    hashes = tk.mix(shingles + np.uint64(0x632BE59BD9B4E019))
    contents = tk.mix(hashes ^ np.uint64(0x1234567))
    for up in (0, 1):  # own band, then sets that may link with one of the next band
        tag = band + up
        mine = (sizes > 0) & (sizes * 100 >= percent * low[tag])
        k, spare = most[tag], all_groups[tag] - most[tag] // 2 - 1
        groups = np.where(mine, all_groups[tag], 0)
        base = np.cumsum(3 * groups) - 3 * groups
        total = int(3 * groups.sum())
        on = np.flatnonzero(mine[docs])
        d = docs[on]
        cell = base[d] + (((hashes[on] >> np.uint64(32)) * (3 * groups[d]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = tk.group_sum64(cell, contents[on], total).reshape(-1, 3)
        counts = np.bincount(cell, minlength=total).reshape(-1, 3)
        owner = np.repeat(np.arange(len(sizes)), groups)
        group = np.arange(len(owner)) - np.repeat(base // 3, groups)
        equal_only = (k == 0)[owner]  # sets that link are equal: one signature of everything
        empty = np.zeros(len(owner), bool)
        for s in _SUBSETS:
            empty |= counts[:, s].sum(1) == 0
        with_empty = np.bincount(owner[empty], minlength=len(sizes)) > spare
        for j, s in enumerate(_SUBSETS):
            content = np.where(equal_only, sums.sum(1, dtype=np.uint64), sums[:, s].sum(1, dtype=np.uint64))
            full = np.where(equal_only, j == 0, (counts[:, s].sum(1) > 0) | with_empty[owner])
            o, g = owner[full], group[full]
            place = tk.mix((tag[o].astype(np.uint64) << np.uint64(34)) + (g.astype(np.uint64) << np.uint64(2)) + np.uint64(j))
            out_docs.append(o)
            out.append(tk.mix(content[full] ^ place))
    return np.concatenate(out_docs), np.concatenate(out)


def _describe(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets, lower=True)
                docs, shingles = distinct_shingles(words, size)
                n = words.n_docs
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_hash"), pa.array(np.bincount(docs, minlength=n).astype(np.int64)), pa.array(tk.signed(set_names(docs, shingles, n)))], schema=schema
                )

    return run


def _sign(size: int, percent: int, part: int):
    """(signature, node) of the signatures of one of PASSES parts."""
    schema = pa.schema([("signature", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tk.slices(batch):
                words = tk.Words(data, offsets, lower=True)
                docs, shingles = distinct_shingles(words, size)
                owner, signature = _signatures(docs, shingles, np.bincount(docs, minlength=words.n_docs), percent)
                mine = signature % np.uint64(PASSES) == part
                node = tk.signed(set_names(docs, shingles, words.n_docs)[owner[mine]])
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(signature[mine])), pa.array(node, pa.int64())], schema=schema)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by signature and node: those of signatures that several nodes have, each once."""
    last, told = np.zeros((2, 0), np.int64), False  # the row before this batch's, and whether it was passed on
    for batch in batches:
        rows = np.concatenate([last, [batch.column(c).to_numpy() for c in ("signature", "node")]], 1)
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)][: rows.shape[1]]]
        same = rows[0, 1:] == rows[0, :-1]
        keep = np.r_[same, False] | np.r_[False, same]
        last, told, first = rows[:, -1:], bool(keep[-1:].any()) or (told and rows.shape[1] == 1), told
        keep[:1] &= not first
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, keep[: rows.shape[1]]]], ["signature", "node"])


def differences(sizes: np.ndarray, docs: np.ndarray, shingles: np.ndarray, pivot: np.ndarray, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Each set's number of elements in common with the pivot's, whether it is far, its number of own elements, and (set, element).

    ``docs`` and ``shingles``: the sets' elements, sorted; ``pivot``: its elements, sorted. A set is far if its own elements, which
    the pivot lacks, are enough for a prefix of it (see ``_dealt_again``): then only those are given. Else, first its own, then those that
    it lacks. Only wanted sets have any.
    """
    m = len(sizes)
    at = np.minimum(np.searchsorted(pivot, shingles), len(pivot) - 1)
    hit = pivot[at] == shingles
    common = np.bincount(docs[hit], minlength=m)
    own_docs, own = docs[~hit], shingles[~hit]
    n_own = np.bincount(own_docs, minlength=m)
    reach = sizes + 1 - (percent * sizes + 99) // 100
    far = n_own >= reach
    rank = np.arange(len(own)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
    n_own = np.where(wanted, np.minimum(n_own, reach), 0)
    keep = rank < n_own[own_docs]
    near = np.flatnonzero(wanted & ~far)
    missing = np.zeros((m, 0), bool) if not len(near) else np.repeat((wanted & ~far)[:, None], len(pivot), 1)
    if len(near):
        missing[docs[hit], at[hit]] = False
    which, where = np.nonzero(missing)
    owner, element = np.r_[own_docs[keep], which], np.r_[own[keep], pivot[where]]
    order = np.argsort(owner, kind="stable")
    return common, far, n_own, owner[order], element[order]


def _compare(size: int, percent: int):
    """Rows come sorted: a pivot, then the sets that are compared with it."""
    names = ["a", "b", "size_a", "size_b", "n_own"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("far", pa.bool_()), ("linked", pa.bool_()), ("apart", pa.list_(pa.int64()))])
    room = 1 << 22  # cells of a table of sets by the pivot's elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = np.zeros(0, np.uint64), None
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                docs, shingles = distinct_shingles(tk.Words(data, offsets, lower=True), size)
                n = rows.num_rows
                at = np.searchsorted(docs, np.arange(n + 1))
                a, b, salt = (rows.column(c).to_numpy() for c in ("a", "node", "salt"))
                compared, deal = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("compared", "deal"))
                low = 0
                while low < n:
                    if not compared[low]:
                        held = shingles[at[low] : at[low + 1]]
                        low += 1
                        continue
                    stop = low + 1
                    while stop < n and compared[stop] and (stop - low + 1) * len(held) <= room:
                        stop += 1
                    mine = docs[at[low] : at[stop]] - low
                    sizes = np.diff(at[low : stop + 1])
                    common, far, n_own, owner, element = differences(sizes, mine, shingles[at[low] : at[stop]], held, deal[low:stop], percent)
                    linked = (common > 0) & (100 * common >= percent * (sizes + len(held) - common))
                    key = [*zip(a[low:stop].tolist(), salt[low:stop].tolist(), b[low:stop].tolist())]
                    new = np.array([x != y for x, y in zip(key, [before, *key])], bool)  # a row that repeats a document comes once more
                    before = key[-1]
                    ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=stop - low))].astype(np.int32))
                    out = [a[low:stop], b[low:stop], np.full(stop - low, len(held)), sizes.astype(np.int64), n_own.astype(np.int64)]
                    lists = pa.ListArray.from_arrays(ends, pa.array(tk.signed(element)))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(far), pa.array(linked), lists], schema=schema).filter(pa.array(new))
                    low = stop

    return run


def _filtered(docs: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """``docs`` with ``passed``, false only for rows that none of the ``n`` rows of ``keys`` meets; see ``url_filter``."""
    n_blocks = -(-n // KEYS_PER_BLOCK)
    blocks = bloom_blocks(keys.select(F.struct(*on).alias("key")), n_blocks)
    tested = docs.withColumn("key", F.struct(*on)).withColumn("block", F.expr(f"pmod(xxhash64(key), {n_blocks})")).join(F.broadcast(blocks), "block", "left")
    passed = reduce(lambda x, y: x & y, (bits.bitwiseAND(F.col(f"w{i}")) == bits for i, bits in enumerate(_bits("key"))))
    return tested.withColumn("passed", F.coalesce(passed, F.lit(False))).drop("key", "block", *[f"w{i}" for i in range(LONGS)])


def _joined_texts(docs: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``docs`` joined with the staged table ``keys``, of which no text is shuffled that cannot meet a key (how: inner or left_anti)."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(keys), on, how)
    if n > KEYS_PER_BLOCK * BROADCAST_ROWS:
        return docs.join(keys, on, how)
    tested = _filtered(docs, keys, on, n)
    met = tested.where("passed").drop("passed").join(keys, on, how)
    return met if how == "inner" else met.unionByName(tested.where("not passed").drop("passed"))


def compare(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Staged parts (a, b, size_a, size_b, n_own, far, linked, apart) of pairs (a, b, deal); where ``deal`` holds, see ``differences``.

    A pivot's pairs are dealt to as many tasks as CHUNK asks for; its text goes to each, the others' texts to one each. Each part
    has whole tasks, of about AT_ONCE texts a node (or FEW_TEXTS) together.
    """
    many = pairs.groupBy("a").agg(F.expr(f"(count(*) + {CHUNK - 1}) div {CHUNK}").alias("chunks"))
    salted = pairs.join(many, "a").select("a", F.col("b").alias("node"), F.expr("pmod(xxhash64(b), chunks)").alias("salt"), F.lit(True).alias("compared"), "deal")
    pivots = salted.select("a", F.col("a").alias("node"), "salt", F.lit(False).alias("compared"), F.lit(False).alias("deal")).distinct()
    wanted = stage(salted.union(pivots).join(nodes.select("node", "doc_id", "text_hash"), "node"), "wanted")
    at_once = min(int(AT_ONCE * nodes.count()), KEYS_PER_BLOCK * BROADCAST_ROWS // 2)
    parts, out = max(1, -(-wanted.count() // max(FEW_TEXTS, at_once))), []
    for part in range(parts):
        release(docs.sparkSession, 1)  # a part's shuffle files go before the next part's are written
        mine = wanted.where(F.pmod(F.xxhash64("a", "salt"), F.lit(parts)) == part)
        texts = _joined_texts(docs, mine, ["doc_id", "text_hash"]).select("a", "salt", "compared", "node", "deal", "text")
        dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "compared", "node")
        out.append(stage(dealt.transform(in_arrow, _compare(size, percent), "a long, b long, size_a long, size_b long, n_own long, far boolean, linked boolean, apart array<long>"), "compared"))
        del mine, texts, dealt
    drop(wanted)
    release(docs.sparkSession, 1)
    return out


def block_links(docs: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, sides: np.ndarray, components: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of links, by index, that join the components of some sets: as those of all pairs do, but at most one less than there are sets.

    Pairs are those of a set of side 0 and one of side 1; where all are of side 0, all pairs.
    """
    labels = np.unique(components, return_inverse=True)[1]
    x, y = [], []
    if labels.max(initial=0) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, element = np.unique(shingles, return_inverse=True)
    ends, mark = np.r_[0, np.cumsum(sizes)], np.zeros(len(names), bool)
    low = int((sides == 0).sum()) % len(sides)  # the sets that each of side 0 is compared with begin here
    others, starts = element[ends[low] :], ends[low:-1] - ends[low]
    for i in range(low or len(sides)):
        own = element[ends[i] : ends[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[others], starts, dtype=np.int64)
        mark[own] = False
        linked = low + np.flatnonzero((common > 0) & (100 * common >= percent * (sizes[i] + sizes[low:] - common)))
        for label in np.unique(labels[linked]):
            if label != labels[i]:
                x.append(i)
                y.append(linked[labels[linked] == label][0])
                labels[labels == label] = labels[i]
    return np.array(x, np.int64), np.array(y, np.int64)


def _compare_blocks(size: int, percent: int):
    """Rows come sorted by signature, one and other block, side and node: all of two blocks are held at once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(sets: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        nodes, sides, components = (np.array([s[i] for s in sets], np.int64) for i in range(3))
        sizes = np.array([len(s[3]) for s in sets])
        x, y = block_links(np.repeat(np.arange(len(sets)), sizes), np.concatenate([s[3] for s in sets]), sizes, sides, components, percent)
        return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for batch in batches:
            for rows, data, offsets in tk.slices(batch):
                docs, shingles = distinct_shingles(tk.Words(data, offsets, lower=True), size)
                at = np.searchsorted(docs, np.arange(rows.num_rows + 1))
                keys = [*zip(*(rows.column(c).to_pylist() for c in ("signature", "one", "other")))]
                for i, (now, node, side, component) in enumerate(zip(keys, *(rows.column(c).to_pylist() for c in ("node", "side", "component")))):
                    if now != key and sets:
                        yield links(sets)
                        sets = []
                    key = now
                    if not sets or sets[-1][:2] != (node, side):  # a row that repeats a document comes once more
                        sets.append((node, side, component, shingles[at[i] : at[i + 1]].copy()))
        if sets:
            yield links(sets)

    return run


def _in_blocks(groups: DataFrame) -> DataFrame:
    """(signature, node, component, one, other, side): the texts to send, of ``groups`` (signature, node, component, n: the group's sets).

    A group's sets are dealt to blocks of about BLOCK, and each two blocks, or one with itself, to a task. No pairs are made.
    """
    blocks = f"((n + {BLOCK - 1}) div {BLOCK})"
    dealt = groups.select("signature", "node", "component", F.expr(f"pmod(xxhash64(node, signature), {blocks})").alias("own"), F.explode(F.expr(f"sequence(0, {blocks} - 1)")).alias("with"))
    return dealt.select("signature", "node", "component", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), F.expr("int(own > with)").alias("side"))


def _blockwise(docs: DataFrame, nodes: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), staged: links that join the components of all sets that link in the tasks of ``dealt``; see ``_in_blocks``."""
    wanted = stage(dealt.join(nodes.select("node", "doc_id", "text_hash"), "node"), "wanted")
    keys = ["signature", "one", "other"]
    texts = _joined_texts(docs, wanted, ["doc_id", "text_hash"]).select(*keys, "side", "node", "component", "text")
    links = stage(texts.repartition(*keys).sortWithinPartitions(*keys, "side", "node").transform(in_arrow, _compare_blocks(size, percent), "a long, b long"), "blocks")
    drop(wanted)
    return links


def _lengths(percent: int) -> tuple[str, str, str]:
    """SQL for the lengths of prefixes of D(x), of ``d`` elements: linked sets', and the short and long ones of the others.

    Linking sets of s elements together differ in at most s (100 - percent) div (100 + percent), and a set of n
    in at most K = n (100 - percent) div percent from any. If the overlap of D(x) and D(y) is at least o, their
    prefixes of |D(x)| - o + 1 and |D(y)| - o + 1 elements meet. A set that did not link has |D(x)| over the
    difference allowed to it and the pivot, so a linked one overlaps it by (|D(y)| + 1 - g) / 2, g being how much
    more may be allowed to y than to the pivot because it is larger. Of two that did not link, the one with the
    smaller D overlaps the other by |D(x)| - K div 2 (short prefix); any by |D(x)| - K and by (|D(x)| + 1 - K) / 2
    (long prefix). Each pair has a linked or short prefix on one side, and a long one on the other.
    """
    less, plus = 100 - percent, 100 + percent
    g = f"((greatest(size_b - size_a, 0) * {less} + {plus - 1}) div {plus})"
    k = f"((size_b * {less}) div {percent})"
    linked = f"d - greatest(1, (d + 2 - {g}) div 2) + 1"
    short = f"least(d, {k} div 2 + 1)"
    long = f"greatest({short}, d - greatest(1, d - {k}, (d + 2 - {k}) div 2) + 1)"
    return linked, short, long


def _several(apart: DataFrame, part: int, parts: int) -> DataFrame:
    """(a, e, n): elements in which several sets near a pivot differ from it; one of so many parts of them."""
    elements = apart.where("not far").select("a", F.explode("apart").alias("e")).where(F.pmod(F.xxhash64("e"), F.lit(parts)) == part)
    return elements.groupBy("a", "e").agg(F.count("*").alias("n")).where("n > 1")


def _dealt_again(apart: DataFrame, shared: DataFrame, percent: int, part: int, parts: int) -> DataFrame:
    """(signature, node, component, small, large) by prefixes, of rows of ``compare`` with components; one of so many parts.

    Sets near the pivot are dealt out by the prefixes of their differences D; ``shared``: see ``_several``. A set x that links with another shares an element
    with it among the first |x| + 1 - percent |x| / 100 of each, in any common order; let the elements that the pivot lacks come first.
    A far set's prefix has only such elements, so it meets another set, far or near, in one of those. A part has whole sets near pivots, and
    whole signatures of the others.
    """
    near = apart.where("not far").where(F.pmod(F.xxhash64("b"), F.lit(parts)) == part)
    elements = near.select("a", "b", F.explode("apart").alias("e"))
    # Elements that no other set has come first in a prefix and meet nothing, so they are only counted.
    ranked = elements.join(shared, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("held"))
    linked, short, long = (F.expr(x) for x in _lengths(percent))
    lengths = near.withColumn("d", F.size("apart")).select("a", "b", "linked", F.col("of_b").alias("component"), "d", F.when(F.col("linked"), linked).otherwise(short).alias("one"), F.when(F.col("linked"), 0).otherwise(long).alias("other"))
    placed = lengths.join(ranked, ["a", "b"]).select("a", "b", "component", "one", "other", F.expr("d - size(held)").alias("alone"), F.posexplode("held").alias("place", "x"))
    placed = placed.withColumn("rank", F.expr("alone + place + 1")).where("rank <= greatest(one, other)")
    by_difference = placed.select(F.xxhash64("a", F.col("x.e")).alias("signature"), F.col("b").alias("node"), "component", F.expr("rank <= one").alias("small"), F.expr("rank <= other").alias("large"))
    with_far = apart.where("far").select("a").distinct()
    own = apart.join(with_far, "a", "left_semi").select("a", "b", "of_b", "far", F.explode(F.expr("slice(apart, 1, cast(n_own as int))")).alias("e"))
    own = own.select(F.xxhash64("a", "e", F.lit("far")).alias("signature"), F.col("b").alias("node"), F.col("of_b").alias("component"), F.lit(True).alias("small"), F.col("far").alias("large"))
    own = own.where(F.pmod("signature", F.lit(parts)) == part)
    met = own.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    return by_difference.union(own.join(met, "signature", "left_semi").select(*by_difference.columns))


def _link_components(docs: DataFrame, signed_docs: DataFrame, nodes: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that link; ``known``: a staged table of links (a, b) to start from."""
    # The signatures of all documents are far more than the shared ones: a part of them is shuffled at once, and its files go before the next part's come.
    parts = []
    for part in range(PASSES):
        release(docs.sparkSession, 1)
        signed = signed_docs.transform(in_arrow, _sign(size, percent, part), "signature long, node long").repartition("signature").sortWithinPartitions("signature", "node")
        parts.append(stage(signed.transform(in_arrow, _shared, "signature long, node long"), "signed"))
        del signed
    release(docs.sparkSession, 1)
    rows = stage(reduce(DataFrame.union, parts).select("signature", "node", F.col("node").alias("component"), F.lit(True).alias("small"), F.lit(True).alias("large")), "rows")
    drop(*parts)
    made = [rows]
    number = nodes.count()
    found, texts = components(known), TEXTS * number
    drop(known)
    while True:
        sides = rows.groupBy("signature").agg(
            F.count_if("small").alias("small_n"), F.count_if("large").alias("large_n"), F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"),
            F.min("node").alias("first"), F.bit_xor(F.xxhash64("node", "small", "large")).alias("sets"),
        ).where("least < most and small_n > 0 and large_n > 0")
        # Of signatures with the same sets one is enough.
        sides = sides.groupBy("n", "small_n", "large_n", "first", "sets").agg(F.min("signature").alias("signature")).select("signature", "n", F.expr(f"least(small_n, large_n) <= {SMALL}").alias("few"))
        held = stage(rows.join(sides, "signature"), "held")
        drop(*made)
        if held.isEmpty():
            drop(held)
            return found
        few, many = held.where("few"), held.where("not few")
        left = few.where("small").select("signature", F.col("node").alias("a"), F.col("component").alias("of_a"))
        right = few.where("large").select("signature", F.col("node").alias("b"), F.col("component").alias("of_b"))
        sent = many.agg(F.sum(F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))).first()[0] or 0
        direct = left.join(right, "signature").where("of_a <> of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("deal"))
        if sent <= texts:  # the pairs of small groups, and blocks of the others: all is compared then
            pairs = stage(direct.distinct(), "pairs")
            compared = compare(docs, nodes, pairs, size, percent)
            links = [stage(reduce(DataFrame.union, compared).where("linked").select("a", "b"), "links")]
            drop(pairs, *compared)
            parts = -(-sent // max(1, min(int(AT_ONCE * number), KEYS_PER_BLOCK * BROADCAST_ROWS // 2)))
            for part in range(parts):  # by two blocks: one group may have most of the texts
                dealt = _in_blocks(many).where(F.pmod(F.xxhash64("signature", "one", "other"), F.lit(parts)) == part)
                links.append(_blockwise(docs, nodes, dealt, size, percent))
                release(docs.sparkSession, 1)  # a part's shuffle files go before the next part's are written
            found = _joined(found, reduce(DataFrame.union, links))
            drop(held, *links)
            return found
        weight = many.groupBy("node").agg(F.sum("n").alias("weight"))
        first = many.join(weight, "node").groupBy("signature").agg(F.max(F.struct("weight", "node")).alias("best")).select("signature", F.col("best.node").alias("a"))
        central = many.join(first, "signature").where("node <> a").select("a", F.col("node").alias("b"), F.lit(True).alias("deal"))
        pairs = stage(direct.union(central).groupBy("a", "b").agg(F.max("deal").alias("deal")), "pairs")
        drop(held)
        compared = compare(docs, nodes, pairs, size, percent)
        drop(pairs)
        found = _joined(found, reduce(DataFrame.union, compared).where("linked").select("a", "b"))
        # Where all sets that were compared with a pivot are of one component with each other, nothing is left to find.
        differing = _with_component(reduce(DataFrame.union, compared).where("size(apart) > 0").select("a", "b"), found)
        mixed = stage(differing.groupBy("a").agg(F.min("of_b").alias("least"), F.max("of_b").alias("most")).where("least < most").select("a"), "mixed")
        of_mixed, staged = broadcast_if(mixed, BROADCAST_ROWS), []
        for part in compared:  # these rows are read several times over, so they are made once
            staged.append(stage(_with_component(part.where("size(apart) > 0").join(of_mixed, "a", "left_semi"), found), "apart"))
            drop(part)
        drop(mixed)
        apart = reduce(DataFrame.union, staged)
        parts = max(1, -(-(apart.agg(F.sum(F.size("apart"))).first()[0] or 0) // max(FEW_ELEMENTS, ELEMENTS * number)))
        several = [stage(_several(apart, part, parts), "several") for part in range(parts)]
        made = [stage(_dealt_again(apart, reduce(DataFrame.union, several), percent, part, parts), "rows") for part in range(parts)]
        rows = reduce(DataFrame.union, made)
        drop(*several, *staged)
        texts *= 4


def _with_component(pairs: DataFrame, found: DataFrame, end: str = "b") -> DataFrame:
    """``pairs`` with of_b (or of_a), the component of b (or a); a node that has no link is one of its own."""
    of = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    return pairs.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component; staged) after more links: those between components join whole components."""
    between = stage(_with_component(_with_component(links, found), found, "a").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "between")
    if between.isEmpty():
        drop(between)
        return found
    joined = components(between)
    moved = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    out = stage(moved.union(joined.join(found, "node", "left_anti").select("node", "component")), "found")
    drop(between, joined, found)
    return out


def components_of(docs: DataFrame, size: int, percent: int, by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """See ``_components_of``; shuffle files go with each staged table."""
    with shuffles_cleaned(docs.sparkSession):
        return _components_of(docs, size, percent, by_id)


def _components_of(docs: DataFrame, size: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Staged tables of all rows (doc_id, text_hash, n_shingles, node), and of nodes (node, component_id, doc_id, text_hash).

    A node is a set of shingles; ``doc_id`` and ``text_hash`` are those of its first row. Rows with a null id give no node.
    ``by_id``: whether different texts of one id are in one component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    rows = stage(docs.transform(in_arrow, _describe(size), "doc_id long, text_hash long, n_shingles long, node long"), "rows")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = stage(usable.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("node", "first.*"), "nodes")
    # Only documents that give nodes are signed: ids all of whose texts are copies go.
    copies = usable.select("doc_id").distinct().join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    named = docs.where("doc_id is not null")
    own = _joined_texts(named, stage(copies, "copies"), ["doc_id"], "left_anti")
    several = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    same = usable.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    found = _link_components(named, own, nodes, stage(same.distinct() if by_id else same.where("false"), "same"), size, percent)
    ids = found.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_nodes = nodes.join(found.join(ids, "component"), "node", "left")
    out = stage(named_nodes.select("node", F.coalesce("component_id", "doc_id").alias("component_id"), "doc_id", "text_hash"), "components")
    drop(nodes, found)
    return rows, out


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links).

    Words are lower-cased (A-Z). A text of fewer words than ``size`` is one shingle; a null text, an empty
    one and one without words has no shingle and links with nothing. A row with a null id links with nothing
    and has a null component. Rows repeated under one id give one row each, all in one component, also where
    their texts differ: then each text links for itself.
    """
    rows, nodes = components_of(docs, size, percent)
    out = rows.join(nodes.select("node", "component_id"), "node", "left").withColumn("component_id", F.expr("if(doc_id is null, null, if(n_shingles > 0, component_id, doc_id))"))
    return out.select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of linked ones: that of the least id, then of the least text hash.

    A row with a null id takes part under an id of its own, from its text's hash, larger than others. Rows that
    repeat an id and a text are one; texts without words link with nothing and stay.
    """
    own, mark = "doc_id_", "text_hash_"
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.expr("9223372036854775807 - shiftrightunsigned(xxhash64(text), 2)"))).withColumn(mark, F.xxhash64("text"))
    rows, nodes = components_of(keyed.select(F.col(own).alias("doc_id"), "text"), size, percent, by_id=False)
    first = nodes.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    gone = stage(rows.where("n_shingles > 0").select("doc_id", "text_hash").distinct().join(first, ["doc_id", "text_hash"], "left_anti").toDF(own, mark), "gone")
    kept = _joined_texts(keyed, gone, [own, mark], "left_anti")
    repeated = stage(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash").toDF(own, mark), "repeated")
    if not repeated.isEmpty():
        again = broadcast_if(repeated, BROADCAST_ROWS)
        once = kept.join(again, [own, mark], "left_semi").select(*keyed.columns).dropDuplicates([own, mark])
        kept = kept.join(again, [own, mark], "left_anti").select(*keyed.columns).union(once)
    return kept.select(*docs.columns)
