"""The pipeline's stages, one after another, against brute force."""

import collections
import zlib

import numpy as np
from conftest_llm import words
from test_corpus_operators import groups, tokens

import corpus_pipeline
from siltstone.llm import mixing
from siltstone.llm.shared import documents, tokenizer_path, written


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark, sf_dir)
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        rows = out.collect()
        if name == "token_output":
            want = collections.Counter((d, len(t := tokens(tokenizer, before[d])), zlib.crc32(np.array(t, "<u4").tobytes())) for d in [r["doc_id"] for r in docs.collect()])
            assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
            break
        assert out.columns == columns
        ids = [r["doc_id"] for r in rows]
        assert all(before[r["doc_id"]] == r["text"] for r in rows)
        if name == "language_id":
            assert set(ids) == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            assert set(ids) == {d for d, found in groups(docs).items() if any(c == d for _, c in found)}
        elif name == "decontamination":
            assert set(ids) == {r["doc_id"] for r in docs.collect() if not any(b in r["text"] for b in bench)}
        elif name == "mixing":
            sizes = collections.Counter()
            for r in docs.collect():
                sizes[r["source"]] += len(words(r["text"]))
            goal, got = mixing.targets(dict(sizes)), collections.Counter()
            for r in rows:
                got[r["source"]] += len(words(r["text"]))
            assert max(collections.Counter(ids).values()) <= 3
            assert sum(abs(goal[s] - got[s]) for s in goal) <= 0.02 * sum(goal.values())
        docs = out


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert rows and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, sf_dir, clashing, empty):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""
    rows = clashing.select("doc_id", "text").collect()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
        out = stage(spark, clashing, sf_dir)
        got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) if name != "token_output" else None
        if name == "token_output":
            assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r["doc_id"] for r in rows)
            continue
        assert out.columns == clashing.columns, name
        if name == "language_id":
            assert got == collections.Counter(map(tuple, (r for r in rows if any(c.isalpha() for c in r["text"] or ""))))
        elif name == "near_dedup":
            first = groups(clashing)
            want = {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and any(c == r["doc_id"] for _, c in first[r["doc_id"]])}
            assert got == collections.Counter([*want, *((None, r["text"]) for r in rows if r["doc_id"] is None)])
        elif name == "decontamination":
            assert got == collections.Counter(map(tuple, rows))
        else:
            assert set(got) <= set(map(tuple, rows)) and all(n <= 3 * sum(tuple(r) == k for r in rows) for k, n in got.items())
            assert got == collections.Counter((r["doc_id"], r["text"]) for r in mixing.mixed(clashing.repartition(3)).collect())
