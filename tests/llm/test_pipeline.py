"""The corpus pipeline: each stage on its own input, against brute force where there is one."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm.common import durable, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents").withColumn("probabilities", F.lit(1)).withColumn("row", F.lit("x"))]
    for name, stage in cp.STAGES:
        docs.append(durable(stage(spark, docs[-1], sf_dir), f"test-{name}"))
    return docs


def test_stages_keep_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.count() > 0


def test_toxicity_drops_toxic_rows_only(spark, sf_dir, steps):
    labels = table(spark, sf_dir, "labels")
    kept = {r.doc_id for r in steps[1].collect()}
    clean = {r.doc_id for r in steps[0].join(labels.filter("toxic = 0"), "doc_id").collect()}
    assert len(clean - kept) <= 1
    before = {r.doc_id: r.asDict() for r in steps[0].collect()}
    assert all(before[r.doc_id] == r.asDict() for r in steps[1].collect())


def test_texts_take_little_disk_between_stages(spark, sf_dir, steps, monkeypatch):
    """Toxicity writes no copy of its own, and tables are written with a codec that makes texts small."""
    files = steps[2].inputFiles()
    assert files and {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f.removeprefix("file://")).num_row_groups} == {"ZSTD"}
    monkeypatch.setattr(cp, "durable", None)
    assert cp.toxicity(spark, steps[0], sf_dir).count() == steps[1].count()


def test_exact_dedup_keeps_the_largest_id(steps):
    best = {}
    for r in steps[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(best.values())


def test_near_dedup_keeps_one_of_each_group(steps):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = sorted((r.doc_id, shingles(r.text)) for r in steps[2].collect())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({find(i) for i in root})


def test_mixing_takes_whole_words_of_its_documents(steps):
    texts = {r.doc_id: WORD.findall(r.text or "") for r in steps[3].collect()}
    taken = {}
    for r in steps[4].collect():
        words = WORD.findall(r.text)
        assert set(words) <= set(texts[r.doc_id])
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words)
    assert all(n <= 3 * len(texts[i]) for i, n in taken.items())
    assert abs(sum(taken.values()) / sum(map(len, texts.values())) - 1) < 0.1


def test_packing_packs_every_row(steps):
    pieces = steps[5].collect()
    whole = sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(r.length for r in pieces) == whole and sum(r.start == 0 for r in pieces) == steps[4].count()


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in cp.STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"empty-{name}")
        assert docs.count() == 0


def test_odd_documents(spark, sf_dir):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", None, 1), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (4, "x " * 200_000, "en", "s", 5)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in cp.STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"odd-{name}")
    assert docs.filter("doc_id = 4").count() >= 1
