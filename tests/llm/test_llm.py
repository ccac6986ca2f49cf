"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sqlloom.llm import decontaminate, html_extract, jaccard_join, lm_score, packing, pii, quality_rules, substring_dedup, textkit, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, signature string, n long"


def words(text):
    return WORD.findall(text or "")


def some_docs(seed=5, n=60):
    """Random texts, copies, near copies, shared passages; null, empty and blank texts, a long one, a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(k))
    docs = [text(rng.randint(3, 250)) for _ in range(n)]
    passage = text(70)
    for i in range(0, n, 7):
        docs[i] = docs[i] + passage + text(20)
    for i in range(3, n, 9):
        w = docs[i - 1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        docs[i] = " ".join(w)
    docs += [docs[2], docs[2].upper(), None, "", " \n\t ", "one", "One two", "one two", "x" * 5000, text(6000), passage * 4]
    rows = [(i * 3 + 1, t) for i, t in enumerate(docs)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 7) for i, t in rows], SCHEMA).repartition(3)


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_and_hashes():
    rows = [t or "" for _, t in some_docs()]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in rows])].astype(np.int64)
    got = textkit.Words(data, offsets)
    flat = [(i, w) for i, t in enumerate(rows) for w in words(t)]
    assert [(d, bytes(data[a:b]).decode()) for d, a, b in zip(got.doc, got.start, got.end)] == flat
    assert len(set(got.hash.tolist())) == len({w for _, w in flat})
    docs, shingles = got.shingles(3)
    want = [(i, tuple(w[k : k + 3])) for i, t in enumerate(rows) if (w := words(t)) for k in range(max(1, len(w) - 2))]
    assert Counter(docs.tolist()) == Counter(i for i, _ in want) and len(set(shingles.tolist())) == len({s for _, s in want})


def brute_dedup(rows, window):
    starts = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            starts[tuple(w[k : k + window])].add(i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if min(starts[tuple(w[k : k + window])]) < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(spark, window):
    rows = some_docs()
    got = collected(substring_dedup.substring_dedup(frame(spark, rows), window, with_text=True))
    want = brute_dedup(rows, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for i, r in got.items()} == want
    assert any(r["n_removed"] for r in got.values())


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (9, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (9, 80)]
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def brute_components(rows, size, percent):
    """Rows with a null id left out; rows repeated under one id are one document with several sets."""
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = [x.translate(LOWER) for x in words(t)]
        if i is not None:
            sets[n] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {rows[n][0]: rows[n][0] for n in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(sets)
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                i, j = root(rows[a][0]), root(rows[b][0])
                label[max(i, j)] = min(i, j)
    return {rows[n][0]: (len(sets[n]), root(rows[n][0])) for n in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, percent):
    rows = some_docs(8)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    for k in range(60):  # a group of near copies, of which many do not link with each other
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(5)}"
        rows.append((1000 + k, " ".join(w[rng.randint(0, 2) :])))
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in collected(jaccard_join.jaccard_components(frame(spark, rows), size, percent)).items()}
    assert got == brute_components(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_hot_group(spark, size, percent, monkeypatch):
    """One large group of near copies: a third of all rows, some linked only through others, some with each other but not the base."""
    rng = random.Random(31)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    base = [f"b{i}" for i in range(130)]
    rows = [(i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(5, 90)))) for i in range(300)]
    for k in range(220):
        w = list(base)
        if k % 3 == 0:
            w[20:45] = [f"v{k % 4}_{i}" for i in range(25)]  # a variant, itself with near copies
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(900)], [w[at], "more%d" % rng.randrange(40)]])
        rows.append((1000 + k, " ".join(w)))
    rng.shuffle(rows)
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in collected(jaccard_join.jaccard_components(frame(spark, rows), size, percent)).items()}
    want = brute_components(rows, size, percent)
    assert got == want and len({c for i, (_, c) in want.items() if i >= 1000}) > 5


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_rounds(spark, size, percent, monkeypatch):
    """Groups of texts that share most of a passage without linking, whose differences meet again and again, take few rounds."""
    rng = random.Random(17)
    base, rows, calls = [f"b{i}" for i in range(60)], [], []
    for i in range(400):
        w = [x for k, x in enumerate(base) if k % 12 or rng.random() < 0.5]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w)), f"n{rng.randrange(3)}")
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 64, raising=False)
    monkeypatch.setattr(jaccard_join, "compare", lambda *a, compare=jaccard_join.compare: calls.append(1) or compare(*a))
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in collected(jaccard_join.jaccard_components(frame(spark, [*rows, rows[0], rows[9]]), size, percent)).items()}
    want = brute_components(rows, size, percent)
    assert got == want and len({c for _, c in want.values()}) > 5
    assert len(calls) <= 5


def test_jaccard_parts(spark, monkeypatch):
    """Groups that are compared block with block go through in parts, each of about AT_ONCE texts a node, and give the same components."""
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = [f"g{group}_{i}" for i in range(40)]
        for i in range(12):
            at = rng.randrange(30)
            rows.append((100 * group + i, " ".join(base[:at] + [f"n{rng.randrange(2)}"] * rng.randint(0, 2) + base[at + rng.randint(0, 2) :])))
    sent = []
    monkeypatch.setattr(jaccard_join, "TEXTS", 1000)  # the first round ends the search
    monkeypatch.setattr(jaccard_join, "_blockwise", lambda d, n, groups, *a, f=jaccard_join._blockwise: sent.append(groups.count()) or f(d, n, groups, *a))
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in collected(jaccard_join.jaccard_components(frame(spark, rows))).items()}
    assert got == brute_components(rows, 3, 90)
    assert len(sent) > 1 and max(sent) <= 2 * jaccard_join.AT_ONCE * len(rows)


def test_jaccard_compared_in_parts(spark, monkeypatch):
    """Texts go to their pivots in parts of about AT_ONCE texts a node, and all pairs are compared once."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"g{i % 3}_{k}" for k in range(60) if k != 7 * (i // 3)) + f" n{rng.randrange(9)}") for i in range(60)]
    pairs = [(i % 3, i, True) for i in range(3, 60)] + [(i, i + 1, False) for i in range(20)]
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    monkeypatch.setattr(jaccard_join, "FEW_TEXTS", 1, raising=False)
    docs = frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) text_hash")
    nodes = docs.selectExpr("doc_id node", "doc_id", "text_hash")
    parts = jaccard_join.compare(docs, nodes, spark.createDataFrame(pairs, "a long, b long, deal boolean"), 3, 90)
    got = sorted((r["a"], r["b"], r["linked"]) for part in parts for r in part.collect())
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    assert got == sorted((a, b, 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])) for a, b, _ in pairs)
    assert len(parts) > 1 and max(p.count() for p in parts) <= 2 * jaccard_join.AT_ONCE * len(rows)


def test_jaccard_one_group_in_parts(spark):
    """The blocks of a single large group spread over parts, and differences dealt again in parts are those dealt at once."""
    n = 600
    dealt = jaccard_join._in_blocks(spark.range(n).selectExpr("7L signature", "id node", "id component", f"{n}L n"))
    got = Counter(r["part"] for r in dealt.selectExpr("pmod(xxhash64(signature, one, other), 4) part").collect())
    assert sum(got.values()) == 5 * n and max(got.values()) < 3 * n
    rng = random.Random(9)
    rows = [(a, b, 50, 50, 3, b % 5 == 0, b % 2 == 0, rng.sample(range(40), 8), b) for a in (1, 2) for b in range(10, 40)]
    apart = spark.createDataFrame(rows, "a long, b long, size_a long, size_b long, n_own long, far boolean, linked boolean, apart array<long>, of_b long")
    whole, parted = (
        sorted(tuple(r) for p in range(parts) for r in jaccard_join._dealt_again(apart, several, 80, p, parts).collect())
        for parts in (1, 3)
        for several in [spark.createDataFrame([r for p in range(parts) for r in jaccard_join._several(apart, p, parts).collect()], "a long, e long, n long")]
    )
    assert whole == parted and whole


def test_jaccard_filter(spark, monkeypatch):
    """Beyond BROADCAST_ROWS keys, texts that meet none are not shuffled, and both joins give what plain ones do."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 20)
    docs = frame(spark, [(i if i % 7 else None, f"t{i}") for i in range(3000)]).select("doc_id", "text")
    keys = jaccard_join.stage(spark.range(0, 3000, 11).selectExpr("id doc_id"), "keys")
    for how in ("inner", "left_anti"):
        got, want = (sorted(tuple(r) for r in df.select("text").collect()) for df in (jaccard_join._joined_texts(docs, keys, ["doc_id"], how), docs.join(keys, ["doc_id"], how)))
        assert got == want
    passed = jaccard_join._filtered(docs, keys, ["doc_id"], keys.count()).where("passed").count()
    assert 230 <= passed <= 300


def test_jaccard_shuffles_go(spark, monkeypatch):
    """A table's shuffle files go when it is written, without the help of any collector."""
    import time

    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    left = []

    def staged(df, name="t", stage=jaccard_join.stage):
        before = shuffles()
        out, until = stage(df, name), time.time() + 3
        while name == "signed" and shuffles() > before and time.time() < until:
            time.sleep(0.1)
        left.append((name, shuffles() - before))
        return out

    monkeypatch.setattr(jaccard_join, "stage", staged)
    monkeypatch.setattr(jaccard_join, "release", lambda *a: None)
    jaccard_join.jaccard_components(frame(spark, [(i, f"a{i} b{i} c{i} d{i}") for i in range(9)])).count()
    assert [n for name, n in left if name == "signed" and n > 0] == []


def test_jaccard_releases_signatures(spark, monkeypatch):
    """What was shuffled for the last part of the signatures goes before more tables are written."""
    names = []
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name="t", stage=jaccard_join.stage: names.append(name) or stage(df, name))
    monkeypatch.setattr(jaccard_join, "release", lambda *a, release=jaccard_join.release: names.append("release") or release(*a))
    jaccard_join.jaccard_components(frame(spark, [(i, f"a{i} b{i} c{i} d{i}") for i in range(9)])).count()
    last = len(names) - 1 - names[::-1].index("signed")
    assert names.count("signed") == jaccard_join.PASSES and "release" in names[last : names.index("rows", last)]


def test_shared_signatures():
    """Signatures of several nodes, each row once, wherever batches end; all parts together sign what there is."""
    rng = np.random.default_rng(4)
    rows = np.sort(rng.integers(0, 150, 300) * 4 + rng.integers(0, 3, 300))
    want = sorted({(int(r) // 4, int(r) % 4) for r in rows if len(set(rows[rows // 4 == r // 4].tolist())) > 1})
    for cut in (1, 2, 7, 300):
        batches = [pa.record_batch({"signature": pa.array(rows[i : i + cut] // 4), "node": pa.array(rows[i : i + cut] % 4)}) for i in range(0, 300, cut)]
        out = [(r["signature"], r["node"]) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
        assert out == want, cut
    text = pa.record_batch({"text": pa.array([" ".join(f"w{x}" for x in rng.integers(0, 90, n)) for n in (0, 2, 50, 400)])})
    parts = [{r["signature"] for b in jaccard_join._sign(3, 90, part)(iter([text])) for r in b.to_pylist()} for part in range(jaccard_join.PASSES)]
    assert len(parts) > 1 and all(parts) and not set.intersection(*parts)


def test_block_links():
    """Links of two blocks, or of one with itself, join the components that all pairs join, and are links."""
    rng = np.random.default_rng(3)
    for n, sides in ((60, np.zeros(60, int)), (60, np.r_[np.zeros(25, int), np.ones(35, int)]), (1, np.zeros(1, int))):
        sets = [np.unique(rng.permutation(30)[: rng.integers(20, 30)]).astype(np.uint64) for _ in range(n)]
        sizes, known = np.array([len(s) for s in sets]), rng.integers(0, 50, n)
        x, y = jaccard_join.block_links(np.repeat(np.arange(n), sizes), np.concatenate(sets), sizes, sides, known, 80)
        assert len(x) < n
        links = {(i, j) for i in range(n) for j in range(n) if (sides.max() == 0 or sides[i] < sides[j]) and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
        assert set(zip(x.tolist(), y.tolist())) <= links

        def joined(pairs):
            label = known.copy()
            for i, j in pairs:
                label[label == label[j]] = label[i]
            return {frozenset(np.flatnonzero(label == c).tolist()) for c in label}

        assert joined(zip(x, y)) == joined(links)


def test_prefixes_meet():
    """Any two sets that link meet in a linked or short prefix of one and a long prefix of the other."""
    from pyspark.sql import functions  # noqa: F401  the lengths are SQL; here the same integers in Python

    rng = random.Random(8)
    met = 0
    for percent in (80, 90):
        lengths = [x.replace(" div ", " // ").replace("greatest", "max").replace("least", "min") for x in jaccard_join._lengths(percent)]
        for _ in range(4000):
            n = rng.randint(8, 70)
            pivot = set(range(n))
            change = lambda s, m: (s - set(rng.sample(sorted(s), min(len(s) - 1, rng.randint(0, m))))) | {rng.randrange(1000, 1040) for _ in range(rng.randint(0, m))}
            x = change(pivot, n // 3)
            y = change(x if rng.random() < 0.7 else pivot, n // 8)
            links = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
            if x == y or x == pivot or y == pivot or not links(x, y) or links(x, pivot) and links(y, pivot):
                continue
            order = {e: rng.random() for e in x | y | pivot}
            prefixes = []
            for s in (x, y):
                apart = sorted(s ^ pivot, key=order.get)
                one, short, long = (eval(e, {"max": max, "min": min}, {"d": len(apart), "size_a": n, "size_b": len(s)}) for e in lengths)
                prefixes.append((set(apart[: one if links(s, pivot) else short]), set() if links(s, pivot) else set(apart[:long])))
            assert prefixes[0][0] & prefixes[1][1] or prefixes[0][1] & prefixes[1][0], (percent, n)
            met += 1
    assert met > 300


def test_jaccard_repeated_ids(spark):
    text = [f"w{i}" for i in range(80)]
    near, other = " ".join([*text[:-1], "changed"]), " ".join(f"z{i}" for i in range(30))
    rows = [(1, other), (1, " ".join(text)), (7, near), (0, other), (9, "alone"), (None, near), (5, ""), (5, "alone")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, 78, None), (0, 28, 0), (1, 28, 0), (1, 78, 0), (5, 0, 5), (5, 1, 5), (7, 78, 0), (9, 1, 5)]
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in jaccard_join.first_of_groups(frame(spark, [*rows, rows[0], (None, "new text")]), 3, 90).collect())
    assert kept == sorted([(0, other), (1, " ".join(text)), (5, ""), (5, "alone"), (-1, "new text")])


def test_jaccard_edges(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A b C d"), (8, None)]
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect() if True)
    assert got == [(-1, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 0, 8)]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_signatures_meet():
    """Sets at the limit of similarity share a signature, at every size."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in [*range(1, 60), 120, 333, 900]:
            for _ in range(4):
                size = int(rng.integers(max(1, -(-n * percent // 100)), n + 1))
                common = next(c for c in range(size, 0, -1) if c == size or True)
                least = -(-percent * (n + size) // (100 + percent))
                if least > size:
                    continue
                common = least
                pool = rng.integers(0, 2**63, n + size, dtype=np.uint64)
                a, b = pool[:n], np.r_[pool[:common], pool[n : n + size - common]]
                docs = np.r_[np.zeros(n, np.int64), np.ones(size, np.int64)]
                owner, got = jaccard_join._signatures(docs, np.r_[a, b], np.array([n, size]), percent)
                assert set(got[owner == 0].tolist()) & set(got[owner == 1].tolist()), (percent, n, size)


def brute_statistics(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_rules(spark):
    rng = random.Random(1)
    rows = some_docs(3, 120) + [(5000 + i, " ".join(rng.choice(["ab#", "c$", "de%%", "f"]) for _ in range(90))) for i in range(60)] + [(6000, "a b c " * 100), (6001, "x\nx\ny\n \n\nx " + "q w e r t " * 20)]
    labels = spark.createDataFrame([(i, int(not 5000 <= i < 6000)) for i, _ in rows if i % 2] + [(None, 1), (77777, 0)], "doc_id long, quality int")
    got = collected(quality_rules.quality_rules(frame(spark, rows), labels))
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_statistics(t), i
        assert not (r["kept"] and r["base_failed"])
    junk = [got[5000 + i] for i in range(60)]
    assert sum(not r["kept"] and r["rule"] > 0 for r in junk) >= 57
    clean = [r for i, r in got.items() if i < 5000 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.95 * len(clean)


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(None, "a " * 60), (1, None), (1, None)]
    got = quality_rules.quality_rules(frame(spark, rows), labels).collect()
    assert len(got) == 3 and all(r["base_failed"] and not r["kept"] and r["rule"] == 0 for r in got)
    assert quality_rules.quality_rules(frame(spark, []), labels).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["grumblax", "fozzwick", "snarkle", "vilebog"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "a b")]
    df = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = df.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] < 0.01 for r in toxicity.toxicity(frame(spark, rows[:2]), none).collect()] == [True, True]


def test_toxicity_by_brute_force(spark):
    """Scores are those of compression lengths under the two dictionaries; repeated rows and ties score alike, and an empty table gives none."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    text = lambda bad: " ".join(rng.choice(["grumblax", "fozzwick"] if bad and rng.random() < 0.2 else plain) for _ in range(80))
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(150)]
    model = toxicity.learn(lambda: iter(rows))
    assert b"grumblax" in model.toxic[: toxicity.OWN_BYTES] and b"grumblax" not in model.ordinary and len(model.toxic) == len(model.ordinary)
    import zstandard

    for _, t, _ in rows[:20]:
        w = t.encode().split()
        windows = [b" " + b" ".join(w[i : i + toxicity.WINDOW]) + b" " for i in range(0, len(w), toxicity.WINDOW)]
        lengths = []
        for content, compressor in zip((model.ordinary, model.toxic), model._compressors):
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            packed = [compressor.compress(x) for x in windows]
            assert [back.decompress(p, max_output_size=len(x)) for p, x in zip(packed, windows)] == windows
            lengths.append([len(p) for p in packed])
        assert model.distances(t).tolist() == [a - b for a, b in zip(*lengths)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, [(i, t) for i, t, _ in rows] + [(7, rows[7][1])] * 2), labels).collect()
    assert len(got) == 152 and len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_toxicity_late_in_texts(spark):
    """Passages after more than 20,000 characters are learned, calibrated and found."""
    rng = random.Random(16)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["grumblax", "fozzwick", "snarkle", "vilebog"]
    rows = []
    for i in range(120):
        w = [rng.choice(plain) for _ in range(3600)]
        rows.append((i, " ".join(w + [rng.choice(bad if i % 2 and rng.random() < 0.5 else plain) for _ in range(60)])))
    assert min(len(" ".join(t.split()[:3600])) for _, t in rows) > 20_000
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity(frame(spark, rows), labels).collect() if r["held_out"]]
    assert len(held) > 10 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)


def test_hilbert_curve_is_one():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    from sqlloom.llm.queries import tokenizer_path

    rows = some_docs() + [(9001, "It's we'll they're I'd ' s 'x <|endoftext|> a  b\n\n c \u00a0 d 12,3½ – 你好 🙂"), (9002, "don't  can't\n've 'twas x' 'll'ld")]
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    got = packing.pack(frame(spark, rows), tokenizer_path(), 256).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    assert packing._encoder(tokenizer_path()).encode(["a <|endoftext|> b"])[0].tolist() == whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        fills.append(at)
    assert sum(f < 256 for f in fills) <= 2 * sum(len(t or "") for _, t in rows) / 10_000
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
    assert [(r["doc_id"], r["length"]) for r in packing.pack(frame(spark, [(None, None), (2, ""), (2, "")]), tokenizer_path()).orderBy("doc_id").collect()] == [(None, 1), (2, 1), (2, 1)]


def test_pieces_from_bytes():
    """A pre-token's bytes go to the merges as they are, without a search for a pattern in its text."""
    from tokenizers import Tokenizer

    from sqlloom.llm.queries import tokenizer_path

    whole, encoder = Tokenizer.from_file(tokenizer_path()), packing._encoder(tokenizer_path())
    for piece in ("word", " zyxwvqk", "\n\n", "'ll", " Größenänderung", "\u024f", "0123456789", "<|", "!?%" * 40):
        assert list(encoder.piece(piece.encode())) == whole.encode(piece, add_special_tokens=False).ids
    for text in ("ab \u024f cd", "ab \u0250 cd", "\u0250"):  # the last simple character, and the first other one
        assert encoder.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_range_edges(spark, monkeypatch):
    """One cell of the curve holds a third of all bytes; every range stays near its size."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 3_000)
    monkeypatch.setattr(packing, "CELLS", 1 << 6)
    rng = random.Random(2)
    keys = [((rng.getrandbits(30) if i % 3 else 77) << 32) | rng.getrandbits(32) for i in range(3000)]
    edges = packing.range_edges(spark.createDataFrame([(k, 10) for k in keys], "key long, size long"))
    held = np.bincount(np.searchsorted(np.array(edges), np.array(keys), "right")) * 10
    assert edges == sorted(set(edges)) and held.max() <= 3_000 and len(held) <= 21


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)] + [(90, "tiny item"), (91, None), (92, "  "), (None, text(20))]
    rows, want = [(i, text(rng.randint(30, 200))) for i in range(40)], set()
    for i in range(0, 40, 3):
        k = rng.randrange(12)
        rows[i] = (i, rows[i][1] + "\n " + items[k][1].upper() + "  " + text(10))
        want.add((i, k))
    rows += [(200, "z " + items[1][1] + "!!"), (201, None), (202, ""), (203, "we say Tiny Item here"), (204, items[2][1].replace(" ", " q ")), (None, items[3][1]), (205, items[4][1]), (205, items[4][1])]
    want |= {(200, 1), (203, 90), (205, 4)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["similarity"] == 1 for r in got if r["doc_id"] < 200)
    clean = decontaminate.decontaminate(frame(spark, rows), benchmark)
    assert clean.columns == ["doc_id", "text", "signature", "n"]
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {a for a, _ in want}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, rows), empty).count() == 0 and decontaminate.contaminated(frame(spark, []), benchmark).count() == 0


def test_decontamination_at_edges(spark):
    """Items lacking a word, at both edges of documents and as whole documents."""
    rng = random.Random(21)
    text = lambda k, v: [f"{v}{rng.randrange(900)}" for _ in range(k)]
    items = [(i, text(30, "v")) for i in range(4)]
    rows, want = [], set()
    for i, w in items:
        for k, lacking in enumerate([w[1:], w[:-1], w[:2] + w[3:], w[:-3] + w[-2:]]):
            for j, t in enumerate([lacking + text(50, "x"), text(50, "x") + lacking, lacking]):
                rows.append((100 * i + 10 * k + j, " ".join(t)))
                if k < 2:  # of 26 shingles one is lost, and windows of 30 words have one of another text
                    want.add((100 * i + 10 * k + j, i))
        rows.append((900 + i, " ".join(w[:24])))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect()}
    brute = {}
    for d, t in rows:
        for i, w in items:
            have, n = t.split(), min(len(w), len(t.split()))
            grams = lambda x: Counter(tuple(x[a : a + 5]) for a in range(len(x) - 4))
            for s in range(len(have) - n + 1):
                a, b = grams(have[s : s + n]), grams(w)
                likeness = (a & b).total() / (a | b).total()
                if likeness >= 0.8 and likeness > brute.get((d, i), (0, 0))[1]:
                    brute[d, i] = (s, likeness)
    assert set(got) == set(brute) and want <= set(got)
    assert all(abs(got[k][1] - brute[k][1]) < 1e-9 for k in brute)


def test_decontamination_recall(spark):
    """Against brute force over all windows: reordered, repeated and changed items, in longer texts, with ties and repeated rows."""
    rng = random.Random(44)
    text = lambda k, v="v": [f"{v}{rng.randrange(700)}" for _ in range(k)]
    items = [(i, text(rng.choice([3, 5, 12, 25, 40, 40, 90]))) for i in range(14)] + [(20, text(6, "r") * 5), (21, [f"w{k}" for k in range(40)])]
    rows = [(500, [f"w{k}" for k in range(20, 40)] + [f"w{k}" for k in range(20)]), (501, text(30) + [f"w{k}" for k in range(20, 40)] + [f"w{k}" for k in range(20)] + text(9)), (502, text(2) + items[0][1] * 3)]
    for d in range(120):
        w = list(items[d % 16][1])
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["changed"], [], [w[at], "more"]])
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w = w[at:] + w[:at]
        rows.append((d, text(rng.randint(0, 60)) + w + text(rng.randint(0, 60))))
    rows.append(rows[5])
    benchmark = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.contaminated(frame(spark, [(i, "\n".join(w)) for i, w in rows]), benchmark).collect()}
    brute = {}
    for d, have in rows:
        for i, w in items:
            n, k = min(len(w), len(have)), min(5, len(w))
            grams = lambda x: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))  # noqa: E731, B023
            for s in range(len(have) - n + 1):
                a, b = grams(have[s : s + n]), grams(w)
                if b and 100 * (a & b).total() >= 80 * (a | b).total() and (a & b).total() / (a | b).total() > brute.get((d, i), (0, 0))[1]:
                    brute[d, i] = (s, (a & b).total() / (a | b).total())
    assert (500, 21) in got and (501, 21) in got
    assert set(got) <= set(brute) and all(abs(got[x][1] - brute[x][1]) < 1e-9 and got[x][0] == brute[x][0] for x in got)
    assert len(got) == len(brute) > 60, len(got) / len(brute)
    long = text(900)
    assert decontaminate.contaminated(frame(spark, [(1, " ".join(text(50) + long)), (2, " ".join(text(40_000)))]), spark.createDataFrame([(7, " ".join(long))], "item_id long, text string")).collect()[0][:3] == (1, 7, 50)
    same = spark.createDataFrame([(" ".join(long),)], "t string").select(decontaminate._words(decontaminate.F.col("t")).alias("w")).select(decontaminate._fingerprint("w"), decontaminate.F.expr(decontaminate._lanes("w", 32))).first()
    assert same[0] == same[1] != 0


def test_html(spark):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["sun", "moon", "star", "of", "the", "light", "caf&eacute;"]) for _ in range(k))
    pages, want = [], {}
    for i in range(60):
        title, paragraphs = text(5), [text(rng.randint(20, 60)) for _ in range(4)]
        pages.append((i, f"http://x/{i}", f'<html><head><title>{title}</title><script>if (a < b) "</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">{text(8)}</div><article><h1>{title}</h1>' + "".join(f"<p><b>{p}\n  end<br>" for p in paragraphs) + f"</article><div class=comments><p>{text(15)}</p></div><footer>&copy; us</footer></body></html>"))
        want[i] = " ".join(x.replace("&eacute;", "é") for x in [title, *(p + " end" for p in paragraphs)])
    pages += [(100, "u", None), (101, None, ""), (102, "u", "<p"), (None, "u", "plain <b>text")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in want} == want
    assert {r["text"] for r in got if r["page_id"] in (100, 101)} == {""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_forgiving(spark):
    keep = lambda t: (page := html_extract.Page(t)).text(np.ones(len(page.tag)))
    assert keep("<article><p>one</p><button>Go<p>two three four</p></article>") == "one two three four"
    assert keep("<div><select><option>a<option>b</div><p>rest") == "rest" and keep("<p>a<svg><path d='x'/>q</svg>b") == "ab"
    assert keep("<p title='5 > 4'>x</p><p title=it's>y</p>1 < 2 <b") == "x y 1 < 2 <b"
    import time

    for piece in ("<a ", "<a '", "<p title=\"", "<", "<!--", "<script>"):
        took = []
        for n in (20_000, 80_000):
            start = time.process_time()
            html_extract.Page(piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 0.5, (piece, took)


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://B.Example.NET/en/1?q#f", "http://example.com/de/", "http://example.com/dex", "http://www.example.com/de/a", "http://notexample.com/de/x", "http://x.org/fr/y", "http://org/fr/", "http://net", "net/x", None, "", "a://b://net/", "http://user@x.net:80/", "http://x.net/\nq", "http://x.net?y"]
    rules = url_filter.RULES

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0].translate(LOWER)
            path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/")], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_verdicts(df, url_filter.contract_rules(spark)).collect()}
    assert {i: got[i] for i in range(len(urls))} == {i: judge(u) for i, u in enumerate(urls)} and got[None][3] == "block"
    many = spark.createDataFrame([(f"h{i}.example", "/p/", "block") for i in range(500)] + [("h1.example", "/p/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    asked = spark.createDataFrame([(i, f"http://w.h{i}.example/p/{i}") for i in range(1000)], "page_id long, url string")
    assert {r["page_id"] for r in url_filter.url_verdicts(asked, many).where("verdict = 'block'").collect()} == set(range(500))
    assert url_filter.url_verdicts(asked.limit(0), many).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(asked, many.limit(0)).collect()} == {"allow"}


def brute_spans(t):
    digits = lambda x: [int(c) for c in x if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789.@ -+()aéZ%0123") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("7" * 200_000 + "a" * 200_000) == []


def test_pii(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(rng.choice(plain) for _ in range(k))
    rows = []
    for i in range(80):
        t = text(30)
        if i % 4 == 0:
            t += f" Telefon: +49 (0) 123 45{i:03d} " + text(5)
        if i % 8 == 1:
            t += f" é{i}x@mail.example.org {text(4)} 10.0.0.{i} {text(4)} 4111 1111 1111 1111"
        rows.append((i, t))
    rows += [(500, None), (501, ""), (None, "call +1 234 567 8901 now")]
    got = collected(pii.find_pii(frame(spark, rows)))
    for i, t in rows:
        base = brute_spans(t or "")
        shown = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and r["spans"].startswith(shown)
        terms = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"]
        assert terms == (["Telefon:"] if i is not None and i < 80 and i % 4 == 0 else [])
    clean = collected(pii.sanitise(frame(spark, rows)))
    assert clean[0]["text"].count("<PHONE>") == 1 and "<TERM> <PHONE>" in clean[0]["text"] and clean[2]["text"] == dict(rows)[2]
    assert clean[500]["text"] is None and clean[0]["signature"] == "s"
    assert pii.find_pii(frame(spark, [])).count() == 0
    assert pii.sanitised("a@b.cd 1.2.3.4", []) == "<EMAIL> <IP>"


def test_lm_scores(spark, monkeypatch):
    rows = some_docs(7)
    got = collected(lm_score.lm_scores(frame(spark, rows)))
    monkeypatch.setattr(lm_score, "VOCABULARY", 30)
    again = collected(lm_score.lm_scores(frame(spark, rows)))
    monkeypatch.setattr(lm_score, "HELD_WORDS", 20)  # all other words are joined
    joined = collected(lm_score.lm_scores(frame(spark, rows)))
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([x.translate(LOWER) for x in words(t)])
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*(x.translate(LOWER) for x in words(t)), None]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        for r in (got[i], again[i], joined[i]):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), total, zlib.crc32(str(i).encode()) % 7 == 2)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    bits = [-got[i]["score"] / math.log10(2) / len(t.encode()) for i, t in rows if t]
    assert np.median(bits) < 4


def lm_model(seed=1, n=40):
    rng = np.random.default_rng(seed)
    tree = lm_score.Tree(np.sort(rng.integers(-(2**62), 2**62, n)), rng.integers(1, 90, n), 20, 5)
    slots = lm_score.LEAST_SLOTS
    tables = [(rng.normal(size=slots).astype(np.float32), rng.integers(0, 4, slots).astype(np.uint8)) for _ in range(2)]
    return lm_score.Model(tree, tables, (rng.normal(size=(lm_score._GATES, lm_score._MODELS + 1)) / 3).astype(np.float32))


def lm_tokens(model, texts):
    joined = "".join(texts).encode()
    return lm_score.Tokens(model.tree, textkit.Words(np.frombuffer(joined, np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64), lower=True))


def with_words(model, names):
    """The model, its leaves renamed to these words."""
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    model.tree.words = np.sort(textkit.signed(textkit.Words(data, np.array([0, len(data)]), lower=True).hash))
    return model


def test_lm_probabilities_add_up():
    """After some words, the probabilities of all tokens that may follow sum to one."""
    names = [f"t{i}" for i in range(40)]
    model = with_words(lm_model(), names)

    def probability(text, at):
        tokens = lm_tokens(model, [text])
        z = lm_score.mixed(model.weights, *lm_score.inputs(tokens, model), tokens.bits, tokens.edges).astype(np.float64)
        ends = np.cumsum(model.tree.length[tokens.symbol])
        return np.exp(-np.logaddexp(0, np.where(tokens.bits, -z, z))[ends[at] - model.tree.length[tokens.symbol[at]] : ends[at]].sum())

    head = "t1 T2 t1 t39"
    assert abs(sum(probability(f"{head} {w}", 4) for w in names) + probability(f"{head} unseen", 4) + probability(head, 4) - 1) < 1e-4


def test_lm_mixing_by_brute_force():
    """The recursion, bit by bit in plain Python: local counts, gates and the refined weights of each text."""
    rng = random.Random(5)
    names = [f"t{i}" for i in range(40)]
    model = with_words(lm_model(3), names)
    texts = [" ".join(rng.choice(names) for _ in range(k)) for k in (3, 400, 90, 0)]
    tokens = lm_tokens(model, texts)
    x, gate = lm_score.inputs(tokens, model)
    got = lm_score.mixed(model.weights, x, gate, tokens.bits, tokens.edges)
    for low, high in zip(tokens.edges, tokens.edges[1:]):
        w, seen = model.weights.astype(np.float64), defaultdict(lambda: [0, 0])
        ends = [lm_score.FIRST_BLOCK << i for i in range(20) if lm_score.FIRST_BLOCK << i <= lm_score.LAST_BLOCK]
        stops = {low + e for e in [*ends, *range(2 * lm_score.LAST_BLOCK, 10**6, lm_score.LAST_BLOCK)]}
        pending = defaultdict(list)
        for i in range(low, high):
            if i in stops:
                for g, rows in pending.items():
                    curve = sum(p * (1 - p) * (v @ v) for v, p, _ in rows) + lm_score.HOLD
                    w[g] = w[g] + sum((b - p) * v for v, p, b in rows) / curve
                pending.clear()
            zeros, ones = seen[tokens.node[i]]
            v = x[i].astype(np.float64)
            assert abs(v[3] - math.log((ones + 0.4) / (zeros + 0.4))) < 1e-4
            z = float(w[gate[i]] @ v)
            assert abs(z - got[i]) < 2e-3 * max(1, abs(z)), (i - low, z, got[i])
            pending[gate[i]].append((v, 1 / (1 + math.exp(-z)), int(tokens.bits[i])))
            seen[tokens.node[i]][tokens.bits[i]] += 1


def test_lm_learns_late_and_grows():
    """What stands late in long texts shapes counts and weights; a text's scores don't depend on those beside it."""
    names = [f"t{i}" for i in range(40)]
    model = with_words(lm_model(7), names)
    rng = random.Random(9)
    head = " ".join(rng.choice(names) for _ in range(3000))
    learned = []
    for tail in ("t1 t2 " * 400, "t3 t4 " * 400):
        counts, learner = lm_score.Counts(lm_score.LEAST_SLOTS), lm_score.Learner()
        for text in (head, head + " " + tail, tail):
            tokens = lm_tokens(model, [text])
            learner.learn(*lm_score.inputs(tokens, counts), tokens.bits)
            counts.add(tokens)
        assert sum(int(t.sum()) for t in counts.tables) == 2 * sum(len(lm_tokens(model, [t]).bits) for t in (head, head + " " + tail, tail))
        learned.append(lm_score.together([(learner.weights, learner.curve)]))
    assert np.abs(learned[0] - learned[1]).max() > 1e-3
    texts = ["t1 t5 t5", head, "", "t9 " * 50]
    score = lambda some: model.scores(textkit.Words(np.frombuffer("".join(some).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in some])].astype(np.int64), lower=True))
    assert np.allclose(score(texts), [score([t])[0] for t in texts], rtol=1e-4)


def test_lm_counts_beyond_held_tables(spark, monkeypatch):
    """Where executors cannot hold the tables, scores are those of tables with room for everything, not of full ones."""
    rows = [*some_docs(7), (None, "a b a"), (9001, None), (9001, None)]
    monkeypatch.setattr(lm_score, "TOKENS_PER_SLOT", 0.02)
    monkeypatch.setattr(lm_score, "VOCABULARY", 30)
    score = lambda: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_score.lm_scores(frame(spark, rows)).collect()))
    held = score()
    monkeypatch.setattr(lm_score, "LEAST_SLOTS", 8)
    monkeypatch.setattr(lm_score, "SLOTS", 8)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 5_000, raising=False)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 3_000, raising=False)
    dealt = score()
    assert len(held) == len(dealt) == len(rows)
    for a, b in zip(held, dealt):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(a[4])) and abs(a[5] - b[5]) < 0.02 * max(1, abs(a[5])), (a, b)


def test_lm_path_counts():
    """Counts along paths, against adding up one token at a time."""
    rng, tree = np.random.default_rng(2), lm_model().tree
    keys = np.unique(rng.integers(0, 30, 400).astype(np.uint64) << tree.width | rng.integers(0, len(tree.length), 400).astype(np.uint64))
    n = rng.integers(0, 5, len(keys))
    seen, paths = defaultdict(lambda: [0, 0]), []
    for key, times in zip(keys.tolist(), n.tolist()):
        leaf = int(tree.leaves(np.array([key], np.uint64))[0])
        path = tree.places[tree.start[leaf] : tree.start[leaf] + tree.length[leaf]]
        paths.append([(key >> int(tree.width), int(p) >> 3) for p in path])
        for at, p in zip(paths[-1], path):
            seen[at][int(p) & 1] += times
    zeros, ones = lm_score.path_counts(tree, keys, n)
    assert [*zip(zeros.tolist(), ones.tolist())] == [tuple(seen[at]) for path in paths for at in path]
    assert len(lm_score.path_counts(tree, keys[:0], n[:0])[0]) == 0


def test_lm_edges(spark):
    got = lm_score.lm_scores(frame(spark, [(None, None), (3, ""), (4, "a b a"), (4, "a b a")])).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 4, 4] and len({r["base_score"] for r in got if r["doc_id"] == 4}) == 1
    assert lm_score.lm_scores(frame(spark, [])).count() == 0
