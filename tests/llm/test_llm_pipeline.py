"""The stages of the pipeline against plain Python loops, each on its own input."""

import itertools
import math
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from dealgrain.llm import quality_classifier, simhash_dedup, source_mixing
from dealgrain.llm.textvec import pieces

WORD = rb"[0-9A-Za-z\x80-\xff]+"


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def unit(i):
    low = i % 2147483647
    return (low * 2654435761 + (low >> 7) * 40503) % 4294967296 / 4294967296


def test_quality(spark, sf, rows):
    """Features by name and not by bucket, weights in dictionaries; documents at the threshold may fall either way."""
    q = quality_classifier
    bad = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        bad[r.doc_id] = max(bad.get(r.doc_id, 0), int(r.quality == 0 or r.toxic == 1))
    feats = {}
    for r in rows:
        t = re.findall(WORD + rb"|[!-/:-@\[-`{-~]+", (r.text or "").encode())
        feats[r.doc_id] = {*t, *((a, b) if a != b else "same" for a, b in itertools.pairwise(t))}
    z, n = {}, {}

    def weight(f):
        if f == "bias":
            return -z.get(f, 0) / ((q.BETA + n.get(f, 0) ** 0.5) / q.ALPHA + q.L2)
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= q.L1 else -(v - math.copysign(q.L1, v)) / ((q.BETA + n[f] ** 0.5) / q.ALPHA + q.L2)

    p = lambda x: 1 / (1 + math.exp(-min(35, max(-35, sum(map(weight, x)) + weight("bias")))))
    for _ in range(q.EPOCHS):
        for i in sorted((i for i in bad if i in feats), key=lambda i: (unit(i), len(feats[i]))):
            w = {f: weight(f) for f in (*feats[i], "bias")}
            g = p(feats[i]) - bad[i]
            for f, v in w.items():
                before = n.get(f, 0.0)
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (n[f] ** 0.5 - before**0.5) / q.ALPHA * v
    score = {i: p(x) for i, x in feats.items()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    clear = {i for i, s in score.items() if abs(s - q.THRESHOLD) > 0.05}
    assert kept & clear == {i for i in clear if score[i] < q.THRESHOLD} and len(clear) > 0.9 * len(score) and len(kept) < len(score)


def test_lines(spark, sf, rows):
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        kept = []
        for x in r.text.split("\n"):
            key = x.strip(" \t\r")
            if not key or key not in seen:
                kept.append(x)
            seen.add(key)
        if kept:
            want[r.doc_id] = ("\n".join(kept), len("\n".join(kept)), r.lang, r.source)
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("after_lines", [False, True])
def test_near_copies(spark, sf, after_lines):
    """All pairs of codes and sets; bands may miss pairs, the plan being 0.99 and 0.97 of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    if after_lines:
        docs = corpus_pipeline.lines(spark, docs, sf)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    col = pa.array([r.text for r in rows])
    codes = np.concatenate([simhash_dedup.codes(d, o) for _, d, o in pieces(col)])
    words = [[w.lower() for w in re.findall(WORD, r.text.encode())] for r in rows]
    shingles = [set(zip(w, w[1:], w[2:])) for w in words]
    sets = [set(w) for w in words]
    long = [{w for w in s if len(w) >= 4} or s for s in sets]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    root, pairs = list(range(len(rows))), []
    for a in range(len(rows)):
        far = np.bitwise_count(codes[a] ^ codes[a + 1 :]).sum(1)
        few = [b for b in range(a + 1, len(rows)) if min(len(long[a]), len(long[b])) < simhash_dedup.FEW and 0 < len(long[a]) < 2 * simhash_dedup.FEW and 0 < len(long[b]) < 2 * simhash_dedup.FEW and alike(sets[a], sets[b]) >= simhash_dedup.SHORT]
        near = [a + 1 + int(k) for k in np.flatnonzero(far <= simhash_dedup.WIDE) if far[k] <= simhash_dedup.RADIUS or alike(shingles[a], shingles[a + 1 + int(k)]) >= simhash_dedup.SIMILAR]
        pairs += [(a, b) for b in {*few, *near}]
    for a, b in sorted(pairs):
        x, y = sorted((root[a], root[b]))
        if x != y:
            root = [x if r == y else r for r in root]
    want = {rows[i].doc_id for i in range(len(rows)) if root[i] == i}
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()}
    assert want <= got and len(got - want) <= 0.03 * (len(rows) - len(want)) and len(rows) - len(want) > 50


def topic(t):
    n = len(t or "")
    lines = (t or "").count("\n") + 1
    if not n:
        return "empty"
    if sum(c in "0123456789" for c in t) / n > 0.05:
        return "records"
    if t.count("|") / n > 0.02:
        return "tables"
    return "lists" if lines > 3 and n / lines < 80 else "short" if n < 1000 else "article" if n < 10000 else "long"


def test_mixing(spark, sf, rows):
    m = source_mixing
    cell = {r.doc_id: (r.source or "?", r.lang or "?", topic(r.text)) for r in rows}
    tokens = {}
    for r in rows:
        tokens[cell[r.doc_id]] = tokens.get(cell[r.doc_id], 0) + math.ceil(len(r.text or "") / 4)
    tokens = {k: v for k, v in tokens.items() if v}
    aims = []
    for j in range(3):
        aim = {}
        for k, v in tokens.items():
            aim[k[j]] = aim.get(k[j], 0) + v
        total = sum(v**m.TEMPER for v in aim.values())
        aims.append({k: v**m.TEMPER / total for k, v in aim.items()})
    w = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    for _ in range(m.ROUNDS):
        for j, aim in enumerate(aims):
            held = {}
            for k, v in w.items():
                held[k[j]] = held.get(k[j], 0) + v
            w = {k: v * aim[k[j]] / held[k[j]] for k, v in w.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * w[k] / t) * t for k, t in tokens.items()) < m.BUDGET * sum(tokens.values()) else (low, c)
    chance = {k: min(1, high * w[k] / t) for k, t in tokens.items()}
    want = {i for i, k in cell.items() if unit(i) < chance.get(k, m.BUDGET)}
    out = corpus_pipeline.mixing(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want) and 0 < len(want) < len(rows)


def test_pieces(spark, sf, rows):
    import sentencepiece
    from dealgrain.llm.queries import SENTENCEPIECE_MODEL

    theirs = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    out = {r.doc_id: r for r in corpus_pipeline.pieces(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert all(out[r.doc_id].pieces == theirs.encode(r.text) and out[r.doc_id].round_trip for r in rows) and len(out) == len(rows)
