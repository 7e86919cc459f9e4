"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from dealgrain.llm import hilbert_sharding, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, source_mixing, suffix_dedup, topk_hamming, url_rules
from dealgrain.llm.queries import SENTENCEPIECE_MODEL
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(120_000))
ROWS = [
    (1, "one line\nsecond line here", "en", "a", 24), (2, "one line\nsecond line here", "en", "a", 24), (2, "one line\nsecond line here", "en", "a", 24),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, "", "de", None, 0), (None, "a row without an id", "en", "a", 19), (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)), (7, LONG, "fr", "b", len(LONG)), (8, "\n\n \n", "en", "a", 4), (9, "ÉTÉ été 漢字 ▁ \x00 🙂", "xx", "c", -5), (10, "tie", "en", "a", 3), (10, "other tie", "en", "a", 9),
]
CLASH = {"hash": 1, "doc": 2, "row": 3, "id": 4, "t": 5, "p": 6, "w": 7, "l": 8, "n": 9, "__gone": 10, "__id": 11, "group": 12, "topic": "z", "tokens": 13, "bad": 14, "keep": True, "level": 15, "__hilbert": 16, "at": 17, "pieces": 18, "name": 19, "spans": 20}


def clash(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (3, None, None), (None, 0, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "op2": lambda d, x: simhash_dedup.simhash_dedup(d), "op4": quality_classifier.quality_classifier, "op5": lambda d, x: sentencepiece_codec.sentencepiece_encode(d, SENTENCEPIECE_MODEL),
    "op6": lambda d, x: line_dedup.line_dedup(d), "op7": lambda d, x: source_mixing.source_mixing(d), "op8": lambda d, x: hilbert_sharding.hilbert_sharding(d),
    "op9": lambda d, x: suffix_dedup.suffix_dedup(d), "op10": lambda d, x: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, labels, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = sorted(map(repr, OPERATORS[name](docs, labels).collect()))
    assert plain == sorted(map(repr, OPERATORS[name](clash(docs), labels).collect()))
    if name == "op9":
        assert {r[r.index("doc_id=") :].split(",")[0] for r in plain} == {"doc_id=6", "doc_id=7"}
    else:
        assert len(plain) == (len(ROWS) - 2 if name == "op6" else len(ROWS)) + (1 if name == "op6" else 0)  # equal rows count once in op6
    empty = OPERATORS[name](docs.limit(0), labels)
    assert empty.columns == OPERATORS[name](docs, labels).columns and empty.count() == 0


def test_classifier_values(spark, labels):
    out = [(r.doc_id, round(r.p_bad, 6), r.keep) for r in quality_classifier.quality_classifier(spark.createDataFrame(ROWS, SCHEMA), labels).collect()]
    p = {}
    for i, v, keep in out:
        p.setdefault(i, set()).add(v)
        assert keep == (v < quality_classifier.THRESHOLD)
    blank = p[3] | p[4] | p[5] | p[8]  # null, empty and blank texts have the bias alone
    assert len(blank) == 1 and blank <= p[None] and p[1] == p[2] and p[6] == p[7] and len(p[6]) == 1 and len(out) == len(ROWS)


def test_codec_values(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    out = sentencepiece_codec.sentencepiece_encode(spark.createDataFrame(ROWS, SCHEMA), SENTENCEPIECE_MODEL).collect()
    text = {}
    for i, t, *_ in ROWS:
        text.setdefault(i, []).append(t)
    for r in out:
        want = [(None, -1, None) if t is None else (theirs.encode(t), len(theirs.encode(t)), theirs.decode(theirs.encode(t)) == t) for t in text[r.doc_id]]
        assert (r.pieces, r.n_pieces, r.round_trip) in want
    assert len(out) == len(ROWS)


def test_line_values(spark):
    out = line_dedup.line_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_kept, r.keep_bitmap) for r in out), key=repr)
    want = [(False, 1, 2, 2, "2"), (False, 2, 2, 0, "0,2"), (False, 3, 0, 0, ""), (False, 4, 1, 1, "1"), (False, 5, 1, 1, "1"), (False, 6, 1, 1, "1"), (False, 7, 1, 0, "0,1"), (False, 8, 4, 4, "4"), (False, 9, 1, 1, "1"), (False, 10, 1, 1, "1"), (False, 10, 1, 1, "1"), (True, 0, 0, 0, ""), (True, 0, 1, 1, "1")]
    assert got == sorted(want, key=repr)


def test_group_values(spark):
    out = simhash_dedup.simhash_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = sorted(((r.doc_id or 0, r.group_id or 0, r.keep) for r in out), key=repr)
    # a null text is alone, an empty one equals another; of rows equal in id and text each has the result
    want = [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True), (10, 10, True), (10, 10, True)]
    assert got == sorted(want, key=repr)


def test_span_values(spark):
    out = {r.doc_id: ([tuple(s) for s in r.spans], r.repeated_words) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert out == {6: ([(0, 120_000)], 120_000), 7: ([(0, 120_000)], 120_000)}


@pytest.mark.parametrize("name", ["op7", "op8", "op10"])
def test_values_by_sql(spark, tmp_path, name):
    """Nulls, empty and very long texts, ties and repeated rows by the operator's SQL; a null id counts as 0 for op7's sample, which SQL doesn't say."""
    from compare import compare
    from dealgrain.llm.queries import ORACLES, QUERIES

    query = next(q for q in QUERIES if q.startswith(name + "_"))
    rows = [r for r in ROWS if name != "op7" or r[0] is not None]
    if name == "op8":  # a negative length counts as 0 in both
        rows = [*rows, (11, "x", "en", "a", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(QUERIES[query](spark, str(tmp_path)), ORACLES[query], str(tmp_path)) == ""


def test_classifier_without_labels(spark, labels):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r.p_bad, r.keep) for r in quality_classifier.quality_classifier(docs, labels.limit(0), threshold=0.6).collect()} == {(0.5, True)}


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, sf, stage):
    name, f = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = f(spark, docs, sf)
    again = f(spark, clash(docs), sf)
    if name == "pieces":
        assert out.columns == ["doc_id", "pieces", "n_pieces", "round_trip"] and out.count() == len(ROWS)
    else:
        assert out.schema == docs.schema and again.columns == clash(docs).columns
        assert sorted(map(repr, out.collect())) == sorted(map(repr, again.select(*docs.columns).collect()))
    assert f(spark, docs.limit(0), sf).count() == 0


def test_lines_stage(spark, sf):
    out = corpus_pipeline.lines(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    rows = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=repr)
    assert (1, "one line\nsecond line here") in rows and not any(i == 2 for i, _ in rows) and (3, None) in rows and (4, "") in rows and (8, "\n\n \n") in rows and not any(i == 7 for i, _ in rows)


def test_near_copies_stage(spark, sf):
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    ids = sorted((r.doc_id or 0, r.text is None) for r in out.collect())
    assert ids == [(0, False), (0, True), (1, False), (3, True), (4, False), (6, False), (8, False), (9, False), (10, False), (10, False)]


def test_vectors(spark):
    rows = [(1, [1.0, -1.0, 1.0]), (2, [1.0, -1.0, 1.0]), (3, None), (None, [1.0, 1.0, 1.0]), (4, [1.0, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0]), (8, [])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = topk_hamming.topk_hamming(v, k=2, dimensions=3)
    want = [(1, 1, 2, 0), (1, 2, 6, 1), (2, 1, 1, 0), (2, 2, 6, 1), (6, 1, 1, 1), (6, 2, 2, 1)]
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, topk_hamming.topk_hamming(clash(v), k=2, dimensions=3).collect())) == want
    assert topk_hamming.topk_hamming(v.limit(0)).count() == 0


def test_urls(spark, labels):
    rows = [(1, "https://a.example/en/1?x=1#top"), (2, None), (3, ""), (3, ""), (None, "not a url"), (5, "http://b.example/" + "p/" * 20000 + "2"), (6, "https://a.example/99999999999999999999999")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    out = url_rules.url_filter(pages, labels)
    assert out.count() == len(rows) and out.where("keep").count() == len(rows)
    assert url_rules.url_filter(clash(pages), labels).columns == out.columns
    assert url_rules.url_filter(pages.limit(0), labels).count() == 0
    assert url_rules.url_filter(pages, labels.limit(0)).where("not keep").count() == 0
