"""The queries without SQL on whole tables, against brute force."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import sketch
from tessera.llm.html_text import blocks_of
from tessera.llm.packing import tokenizer
from tessera.llm.queries_html import op10_html_text
from tessera.llm.queries_packing import op2_packing, tokenizer_path
from tessera.llm.queries_sketch import edited, op8_fingerprints
from tessera.llm.queries_toxicity import THRESHOLD, chain_of, op4_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf_dir, name, by):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(by).collect()]


def test_op2(spark, sf_dir):
    tok = tokenizer(tokenizer_path()).tokenizer
    texts = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows_of(spark, sf_dir, "documents", "doc_id")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op2_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(texts[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, ids in texts.items():
        ends = [0, *[r.start + r.length for r in sorted(pieces[i], key=lambda r: r.start)]]
        assert [r.start for r in sorted(pieces[i], key=lambda r: r.start)] == ends[:-1] and ends[-1] == len(ids)
    padded = 0
    for own in sequences.values():
        lengths = [r.length for r in sorted(own, key=lambda r: r.offset)]
        assert [r.offset for r in sorted(own, key=lambda r: r.offset)] == [sum(lengths[:k]) for k in range(len(lengths))]
        total = sum(lengths)
        assert total <= 4096
        padded += 0 if total & (total - 1) == 0 else 4096 - total
    assert padded <= 4096 + 0.01 * sum(map(len, texts.values()))


def test_op4(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = chain_of(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(spark, sf_dir, "documents", "doc_id")}
    from tessera.llm.toxicity import features

    said = {r["doc_id"]: r["toxic"] for r in rows_of(spark, sf_dir, "labels", "doc_id")}
    got = {r.doc_id: r for r in op4_toxicity(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        at, before = [chain.vocabulary[f] for f in features(text) if f in chain.vocabulary], []
        for model in chain.models:
            z = sum(model.weights[k] for k in at) + sum(w * p for w, p in zip(model.chain, before, strict=True)) + model.bias
            before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert np.allclose([got[i].p_junk, got[i].p_toxic], before, atol=1e-6)
        assert got[i].toxic == (got[i].p_toxic >= THRESHOLD) != got[i].kept
    right = [got[i].toxic == bool(y) for i, y in said.items() if i in got and y is not None]
    assert np.mean(right) > 0.95
    # The same rows give the same model, whatever their order.
    again = chain_of(docs.repartition(7), labels.repartition(3))
    assert again.vocabulary == chain.vocabulary and all(np.array_equal(a.weights, b.weights) for a, b in zip(again.models, chain.models, strict=True))


def test_op8(spark, sf_dir):
    texts = [r["text"] or "" for r in rows_of(spark, sf_dir, "documents", "doc_id")]

    def whole(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def near(a, b):
        return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))

    rows = sorted(op8_fingerprints(spark, sf_dir).collect())
    assert len(rows) == len(texts)
    prints, misses = {}, []
    for k, r in enumerate(rows):
        following = texts[(k + 1) % len(texts)]
        change = edited(texts[k], following)
        assert r.fingerprint == sketch.written(sketch.sketch(texts[k])) and r.edited_fingerprint == sketch.written(sketch.sketch(change)) and r.n_chars == len(texts[k])
        assert prints.setdefault(r.fingerprint, whole(texts[k])) == whole(texts[k])
        for said, other in ((r.near_edited, change), (r.near_next, following)):
            x, y = whole(texts[k]), whole(other)
            assert 0 <= said <= 1 and (x & y or said == (x == y))
            if min(len(x), len(y)) >= 100:
                misses.append(said - near(x, y))
    assert len(misses) > 50 and abs(np.mean(misses)) < 0.03 and np.sqrt(np.mean(np.square(misses))) < 0.12


BLOCK = re.compile(r"</?(?:address|article|blockquote|div|dl|dt|dd|figure|h[1-6]|hr|li|ol|p|pre|section|table|tr|td|th|ul)\b[^>]*>")


def test_op10(spark, sf_dir):
    """Each page has one article here; an independent cut of it gives its text."""
    got = {r.page_id: r for r in op10_html_text(spark, sf_dir).collect()}
    pages = rows_of(spark, sf_dir, "pages", "page_id")
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in BLOCK.split(inner)]
        want = "\n\n".join(b for b in blocks if b)
        r = got[p["page_id"]]
        assert (r.text, r.n_chars, r.url) == (want, len(want), p["url"])


def test_html_keeps_what_an_article_owns():
    kept = lambda h: [t for r, t in blocks_of(h) if r == 1]
    assert kept('<article><p data-id="share">a</p><section id="related">b</section><p class="comment-free">c</p><p title=don\'t>d</p><p title="x>y">e</p></article>') == list("abcde")
    assert kept('<article><p>a</p><div class="x ads">no</div><aside>no</aside><section id=comments>no</section></article><div class="related">no</div>') == ["a"]


@pytest.mark.parametrize("hostile", ["<x " * 300_000 + '"', "<b>" * 100_000 + "</i>" * 100_000, "<div>" + "<b>" * 100_000 + "</p>" * 100_000, '<a href="' * 100_000, "<a b= '" * 100_000, "<script>" * 100_000, "<!--" * 100_000, "<" * 500_000])
def test_hostile_markup_takes_linear_time(hostile):
    import time

    began = time.process_time()
    blocks_of(hostile)
    assert time.process_time() - began < 10
