"""The pipeline's stages against brute force, each on its own input, and the whole of it."""

import random
from collections import defaultdict

import numpy as np
import pytest
from test_llm import brute_components, brute_spans, brute_statistics, words

import corpus_pipeline
from sqlloom.llm import pii
from sqlloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(30)) for i in range(5)]
    docs, bad = [], set()
    for i in range(160):
        t = text(rng.randint(60, 150))
        if i % 10 == 3:
            t, bad = " ".join(w + rng.choice(["###", "%%", "$$$"]) for w in t.split()), bad | {i}
        if i % 16 == 5:
            t += " " + items[i % 5][1] + " " + text(8)
        if i % 8 == 6:
            t += f" é{i}@mail.example.com {text(3)} +1 (555) 010-{i:04d} {text(4)}"
        docs.append((i, t))
    docs += [(500, docs[0][1]), (501, docs[1][1] + " tail"), (502, None), (503, ""), (504, "short text")]
    folder = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs], SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bad, items


def test_stages(spark, tables):
    folder, docs, bad, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = dict(docs)
    results = []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, df, folder)
        if name != "packing":
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            out = out.checkpoint()
        results.append(out)
        df = out
    kept = {r["doc_id"]: r["text"] for r in results[0].collect()}
    base = {i for i, t in docs if not brute_statistics(t)[5]}
    assert set(kept) <= base and len(set(kept) & bad) <= 1 and len(base - bad - set(kept)) <= 2
    first = {r["doc_id"]: r["text"] for r in results[1].collect()}
    assert set(first) == {i for i, (_, c) in brute_components(list(kept.items()), 5, 80).items() if i == c} and 500 not in first and 501 not in first
    clean = {r["doc_id"]: r["text"] for r in results[2].collect()}
    held = {i for i, t in first.items() if any(" ".join(words(x)) in " ".join(words(t)) for _, x in items)}
    assert set(clean) == set(first) - held and held
    sane = {r["doc_id"]: r for r in results[3].collect()}
    assert set(sane) == set(clean)
    for i, r in sane.items():
        assert r["text"] == pii.sanitised(clean[i], []) and r["n_chars"] == len(r["text"]) and not brute_spans(r["text"])
        assert (r["text"] != rows[i]) == bool(brute_spans(rows[i]))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    lengths = defaultdict(int)
    for r in results[4].collect():
        lengths[r["doc_id"]] += r["length"]
    assert dict(lengths) == {i: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in sane.items()}


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    fills = {r["sequence_id"]: r["n"] for r in got.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert max(fills.values()) <= 2048 and np.sum(np.array(list(fills.values())) < 2048) == 1
