"""Operators on small tables made by hand, and against plain Python."""

import io
import itertools
import json
import zipfile

import pytest
from dealgrain.functions import text_ops as t
from dealgrain.operators import classify, integrity, redact, rollup, similarity, versions
from dealgrain.plans import playbook
from dealgrain.plans.base import checkpoint
from dealgrain.sources import clauses, files, text
from dealgrain.streaming import verdict_log
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value,f,want", [
    ("The Élan, of  Œuvre!", t.normalize, "the élan of œuvre"), ("The cat and the Cat", t.words, ["cat"]), ("The cat and the Cat", t.all_words, ["the", "cat", "and"]), ("Based on Law", t.heading_words, ["based", "on", "law"]),
    ("Hello, World!", t.slug, "hello-world"), ("...", t.slug, "item"), (None, t.snippet, ""), ("\n  short one\nx", t.snippet, "short one"), ("v10a", t.natural_key, "v000000000010a"), ("a​b", t.strip_invisible, "ab"),
    ("liability_cap", t.title, "Liability Cap"), ("v12", t.version_number, 12), ("final", t.version_number, None), ("Deal SIGNED v2", t.looks_signed, True), ("not signed", t.looks_signed, False), ("unsigned", t.looks_signed, False),
])
def test_text(spark, value, f, want):
    assert one(spark, value, f) == want


def test_snippet_is_cut_at_a_blank(spark):
    s = one(spark, "word " * 40, t.snippet)
    assert len(s) <= 100 and s.endswith("word") and one(spark, "x" * 150, t.snippet) == "x" * 100


def test_party_side(spark):
    assert [one(spark, a, lambda c: t.party_side(c, ["Acme"])) for a in ("Jo at Acme", "Bob", "", None)] == ["us", "counterparty", "unknown", "unknown"]


OBS = "taxonomy_id string, document_id string, version int, clause_path string, full_text string, deviation string, direction string, magnitude string, provenance string, outcome string, basis string, ord bigint"


def observe(spark, *rows):
    """(taxonomy, direction, provenance, outcome, deviation, basis)"""
    return spark.createDataFrame([(x[0], f"d{i}", 1, "1", f"text {i}", x[4], x[1], "minor", x[2], x[3], x[5], i) for i, x in enumerate(rows)], OBS)


@pytest.mark.parametrize("rows,position,stance", [
    ([("neutral", "our_paper", "signed", "none", "judge")] * 2, "standard", "consistently_held"),
    ([("neutral", "our_paper", "signed", "substantive", "judge")] * 2, "acceptable_variants_exist", "usually_held"),
    ([("worse", "our_paper", "signed", "substantive", "judge"), ("neutral", "our_paper", "signed", "none", "judge")], "negotiable", "usually_conceded"),
    ([("worse", "our_paper", "signed", "substantive", "judge"), ("worse", "our_paper", "proposed_then_reversed", "substantive", "judge")], "negotiable", "mixed"),
    ([("worse", "our_paper", "proposed_then_reversed", "substantive", "judge"), ("neutral", "our_paper", "signed", "none", "judge")], "hold_firm", "consistently_held"),
    ([("neutral", "our_paper", "signed", "none", "judge")], "negotiable", "no_signal"), ([("neutral", "our_paper", "signed", "none", "stub")] * 2, "negotiable", "no_signal"),
    ([("neutral", "counterparty_paper", "signed", "none", "judge")] * 3, "negotiable", "no_signal"),
])
def test_cascade(spark, rows, position, stance):
    r = rollup.rollup(observe(spark, *[("x", *x) for x in rows], ("x", "worse", "our_paper", "unsigned", "none", "judge"), (None, "worse", "our_paper", "signed", "none", "judge"))).collect()
    assert [(x.position, x.historical_stance) for x in r] == [(position, stance)]


def test_score_rounds_half_to_even(spark):
    r = rollup.rollup(observe(spark, *[("x", "neutral", p, "signed", "none", "judge") for p in ["our_paper"] * 5 + ["counterparty_paper"] * 3])).first()
    assert r.score == 0.812 and (r.held, r["of"], r.detail_basis) == (5, 5, "our_paper")


def test_without_a_standard(spark):
    obs = observe(spark, *[("x", "neutral", "our_paper", "signed", "none", "judge")] * 3)
    none = spark.createDataFrame([], "taxonomy_id string, our_standard string")
    r = rollup.rollup(obs, none).first()
    assert (r.position, r.historical_stance) == ("negotiable", "no_signal")


def test_greedy_matching_takes_the_best_edges(spark):
    import random

    rng = random.Random(1)
    edges = [(g, i, j, rng.choice([0.8, 0.9, 0.95, 1.0])) for g in range(6) for i in range(6) for j in range(6) if rng.random() < 0.5]
    got = {tuple(r) for r in similarity.greedy_matching(spark.createDataFrame(edges, 'group int, i int, j int, similarity double'), checkpoint).collect()}
    want, used = set(), set()
    for g, i, j, s in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if (g, "i", i) not in used and (g, "j", j) not in used:
            want.add((g, i, j, s))
            used |= {(g, "i", i), (g, "j", j)}
    assert got == want


def test_leaders_are_greedy(spark):
    import random

    rng = random.Random(2)
    pairs = [(a, b, round(rng.random(), 2)) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.15]
    out = {r.node: r.leader for r in similarity.leaders(spark.createDataFrame(pairs, "a int, b int, similarity double"), spark.createDataFrame([(i,) for i in range(25)], "node int"), checkpoint).collect()}
    sim, lead = {(a, b): s for a, b, s in pairs}, {}
    for n in range(25):
        near = [(-sim[(m, n)], m) for m in lead if lead[m] == m and (m, n) in sim]
        lead[n] = min(near)[1] if near else n
    assert out == lead


def test_similar_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = [(k, sorted(rng.sample(range(12), rng.randint(1, 10)))) for k in range(60)] + [(99, [])]
    df = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets], "key int, words array<string>")
    for bound in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in similarity.similar_pairs(df, bound).collect()}
        assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= bound}


def trail(spark, *texts):
    """Versions of one document, a list of clause texts each (None where a clause is missing)."""
    return spark.createDataFrame([(1, v, a, a, x) for v, row in enumerate(texts, 1) for a, x in enumerate(row, 1) if x is not None], "document_id bigint, version_ord int, ord int, alignment int, text string")


def test_diffs_and_reversals(spark):
    c = trail(spark, ["pay in thirty days", "same", None], ["pay in sixty days plus interest", "same", "new clause"], ["pay in sixty days", None, "new clause"])
    d = {(r.alignment, r.round): r.kind for r in versions.consecutive_diff(c).collect()}
    assert d == {(1, 1): "modified", (1, 2): "modified", (2, 1): "unchanged", (2, 2): "removed", (3, 1): "added", (3, 2): "unchanged"}
    assert {(r.alignment, r.kind) for r in versions.net_diff(c).collect()} == {(1, "modified"), (2, "removed"), (3, "added")}
    rev = versions.reversals(versions.with_hunks(versions.consecutive_diff(c)), c).collect()
    assert [(r.alignment, r.round, r.lost_words) for r in rev] == [(1, 1, ["interest", "plus"])]
    assert [(r.alignment, r.round) for r in versions.set_reversals(versions.consecutive_diff(c), c).collect()] == [(1, 1)]
    assert versions.word_hunks("a b c", "a x c d") == [("replace", "b", "x"), ("insert", "", "d")] and versions.word_hunks(None, "a") == [("insert", "", "a")]


def test_moves_and_chains(spark):
    long = "the supplier shall indemnify the customer against every loss arising from breach"
    c = trail(spark, ["intro", long], [long + " hereof", "intro"], [long + " hereof", "other"])
    m = {(r.version_ord, r.i, r.j): r.basis for r in versions.moves(c, checkpoint).collect()}
    assert m == {(1, 2, 1): "content_jaccard", (2, 1, 1): "content_exact"}
    chained = versions.chains(versions.moves(c, checkpoint), c.drop("alignment"), checkpoint).collect()
    assert len({r.alignment for r in chained}) == 4 and {r.match_basis for r in chained} == {"none", "content_jaccard"}


def test_order(spark):
    base = [f"line {i}" for i in range(12)]
    rows = [(1, 1, base), (1, 2, base[:8] + ["x"] * 4), (1, 3, base[:10] + ["x"] * 2)]
    df = spark.createDataFrame([(d, v, "\n".join(x), v == 2) for d, v, x in rows], "document_id bigint, version bigint, text string, signed boolean")
    assert [r.version for r in sorted(versions.order_versions(df).collect(), key=lambda r: r.version_ord)] == [1, 3, 2]
    assert versions.chain_shape([0.1, 0.1, 0.3]) == "fork" and versions.chain_shape([0.5]) == "gap" and versions.chain_shape([0.1, 0.11]) == "linear"


def test_attribution(spark):
    h = spark.createDataFrame([(1, 1, "1", 0, 10, "insert", "pay interest monthly"), (1, 2, "2", 20, 30, "insert", "other words here")], "document_id int, hunk int, clause_path string, start int, end int, kind string, text string")
    c = spark.createDataFrame([(1, 7, "9", 5, 8, "insert", "pay interest monthly", "Ann"), (1, 8, "2", 90, 99, "delete", "other words here", "Bob")], "document_id int, change int, clause_path string, start int, end int, kind string, text string, author string")
    assert [(r.hunk, r.author) for r in versions.attribute_hunks(h, c, checkpoint).collect()] == [(1, "Ann")]


def test_classify(spark):
    tax = spark.createDataFrame([("cap", "Limitation of Liability", 1, "active"), ("law", "Governing Law", 2, "active"), ("old", "Assignment", 3, "inactive")], "id string, label string, ord int, status string")
    c = spark.createDataFrame([(1, "LIMITATION OF LIABILITY", "x"), (2, "Law Governing", "x"), (3, "Assignment", "x"), (4, None, "body"), (5, "", ""), (6, None, "judged")], "clause int, heading string, text string")
    v = spark.createDataFrame([(6, "law"), (4, "old")], "clause int, verdict_id string")
    assert {r.clause: (r.taxonomy_id, r.basis) for r in classify.classify(c, tax, v).collect()} == {1: ("cap", "heading_exact"), 2: ("law", "heading_similarity"), 3: (None, "unclassified"), 4: (None, "pending"), 5: (None, "empty"), 6: ("law", "judge")}


def test_integrity(spark):
    pins = spark.createDataFrame([("a", "hold", "usually_held"), ("b", "hold", "mixed"), ("c", "hold", "mixed")], "clause_id string, position string, baseline_stance string")
    new = spark.createDataFrame([("a", "usually_held"), ("b", "no_signal")], "clause_id string, stance string")
    assert {r.clause_id: (r.conflict, r.conflict_stance, r.orphan) for r in integrity.merge_pins(pins, new).collect()} == {"a": (False, None, False), "b": (True, "no_signal", False), "c": (False, None, True)}
    need = spark.createDataFrame([("x",), ("y",)], "id string")
    with pytest.raises(integrity.CoverageError):
        integrity.coverage_gate(need, need.where("id = 'x'"), "id")
    integrity.coverage_gate(need, need, "id")
    key = need.select(integrity.payload_key(stage=F.lit("scope"), text=F.col("id"), none=F.lit(None).cast("string"))).first()[0]
    import hashlib

    assert key == hashlib.sha256(b'{"none":null,"stage":"scope","text":"x"}').hexdigest()


def test_redaction(spark):
    s = "Call 555-123-4567 or ann@corp.example.com\nDocuSign Envelope ID: 1\nsee https://a.b/c and Ab1Cd2Ef3Gh4Ij5Kl6Mn at 12 Rose Lane"
    assert one(spark, s, redact.scrub) == "Call [redacted] or [redacted]\nsee [redacted] and [redacted] at [redacted]"
    names = redact.aliases(["Acme Corp", "Acme Corp Holdings"])
    assert one(spark, "ACME  Corp Holdings met Acme Corp", lambda c: redact.pseudonymize(c, names)) == "Counterparty-2 met Counterparty-1"
    assert one(spark, "Counterparty-2 met Counterparty-1", lambda c: redact.resolve_aliases(c, names)) == "Acme Corp Holdings met Acme Corp"
    assert one(spark, "deal-acme-corp-2020", lambda c: redact.pseudonymize_id(c, names)) == "deal-Counterparty-1-2020"
    assert one(spark, "the counterparty and Counterparty-3", redact.generic_party) == "Counterparty and Counterparty-3"
    assert one(spark, "Big-Secret  Thing and secret", lambda c: redact.redact_terms(c, ["secret thing", "secret"])) == "Big-[redacted] and [redacted]"
    df = spark.createDataFrame([(1, "by GlobexIndustries now"), (2, "nothing")], "k int, s string")
    assert [(r.k, r.name) for r in redact.known_names(df, "k", "s", ["Globex Industries"]).collect()] == [(1, "Globex Industries")]


def test_names_beside_accented_letters(spark, tmp_path):
    from compare import compare
    from dealgrain.plans import catalogue

    names = redact.aliases(["Que les", "Acme Corp"])
    texts = {
        "réque les de": "réCounterparty-1 de", "Éque\n LESè": "ÉCounterparty-1è", "éACME Corp.": "éCounterparty-2.", "ñacme corpñ que les": "ñCounterparty-2ñ Counterparty-1",
        "xque les": "xque les", "que les_": "que les_", "9acme corp": "9acme corp", "acme corpé": "Counterparty-2é", "": "", None: None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for few in (1000, 0):
        out = df.select("doc_id", redact.pseudonymize(F.col("text"), names, few).alias("x")).orderBy("doc_id")
        assert [r.x for r in out.collect()] == list(texts.values())
    assert one(spark, "réCounterparty-1è Counterparty-12", lambda c: redact.resolve_aliases(c, names)) == "réQue lesè Counterparty-12"
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(catalogue.QUERIES["pseudonymize_fold"](spark, str(tmp_path)), catalogue.ORACLES["pseudonymize_fold"], str(tmp_path)) == ""


RTF = r"{\rtf1\ansi{\fonttbl{\f0 Times;}}{\*\generator x;}\f0 Preamble \'e9\par 1. Term\par The term is \u8364? one year\tab now\par 1.1) Renewal\par yes\par GOVERNING LAW\par Ohio\par}"


def make_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f"""<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Fees</w:t></w:r></w:p>
    <w:p><w:r><w:t>Pay </w:t></w:r><w:ins w:author="Ann" w:date="2024-05-01T00:00:00Z"><w:r><w:t>promptly</w:t></w:r></w:ins><w:del w:author="Bob"><w:r><w:delText>late</w:delText></w:r></w:del></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_parsers():
    assert text.rtf_text(RTF.encode()).split("\n")[:3] == ["Preamble é", "1. Term", "The term is € one year\tnow"]
    d = text.docx(make_docx())
    assert d.lines == [("Fees", 1), ("Pay promptly", 0), ("a | b", 0)] and [(c["change_type"], c["author"], c["text"]) for c in d.changes] == [("insertion", "Ann", "promptly"), ("deletion", "Bob", "late")]
    again = text.docx(text.accepted(make_docx()))
    assert again.lines == d.lines and again.changes == []
    assert text.pdf_pages(b"%PDF-1.4\nstream\nBT (1. Scope) Tj T* (All \\(of\\) it) Tj ET\nendstream") == ["1. Scope\nAll (of) it"]
    with pytest.raises(text.ParseError):
        text.docx(b"no")
    assert text.markdown_lines("# Head\n<!-- x -->\n![i](j)\n**bold** text\n| a | b |\n|---|---|\n- item") == [("Head", 1), ("bold text", 0), ("a | b", 0), ("item", 0)]
    assert clauses.split_items("Both: (a) one; (b) two") == ("Both:", [("a", "one;"), ("b", "two")]) and clauses.split_items("only (a) one")[1] == []


def test_folder(spark, tmp_path):
    for name, data in (("alpha/v2 signed.rtf", RTF.encode()), ("alpha/v10.rtf", b"junk"), ("beta/v1.docx", make_docx()), ("beta/v1.doc", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path))
    assert {(r.document_id, r.file_name, r.version_ord, r.looks_signed) for r in found.collect()} == {("alpha", "v2 signed.rtf", 1, True), ("alpha", "v10.rtf", 2, False), ("beta", "v1.docx", 1, False)}
    rows = files.parsed(found)
    assert [(r.clause_path, r.parent_path, r.heading, r.text) for r in rows.where("document_id = 'alpha' and version = '1'").orderBy("ord").collect()] == [("0", None, None, "Preamble é"), ("1", "0", "Term", "The term is € one year\tnow"), ("1.1", "1", "Renewal", "yes"), ("0.1", "0", "GOVERNING LAW", "Ohio")]
    assert files.quarantined(rows).count() == 1 and clauses.tree_problems(rows.where("ord >= 0")).count() == 0
    assert [(r.author, r.change_type) for r in files.tracked_changes(found).orderBy("author").collect()] == [("Ann", "insertion"), ("Bob", "deletion")]
    assert files.unreadable(spark, str(tmp_path)).count() == 1
    stale = files.stale(found, spark.createDataFrame([], "doc_key string"), "v1")
    assert stale.count() == 2 and files.stale(found, stale, "v1").count() == 0 and files.stale(found, stale, "v2").count() == 2
    listing = spark.createDataFrame([("a", "v2.rtf"), ("a", "v10 executed.rtf"), ("b", "x.RTF"), ("b", "X.pdf"), ("b", "n.txt")], "folder string, file_name string")
    assert {(r.staged_name, r.signed) for r in files.staged(listing).where("folder = 'a'").collect()} == {("01__v2.rtf", False), ("02__v10 executed.rtf", True)}
    assert {(r.code, r.folder) for r in files.lint(listing).collect()} == {("duplicate_stem", "b"), ("unsupported", "b")}


def test_playbook(spark):
    obs = observe(spark, *[("cap", "neutral", "our_paper", "signed", "none", "judge")] * 3)
    docs = spark.createDataFrame([("d0", 2)], "document_id string, versions int")
    a = playbook.assemble({"id": "x", "name": "Test"}, rollup.rollup(obs), docs, run={"run_id": "1", "generated_at": "now"})
    b = playbook.assemble({"name": "Test", "id": "x"}, rollup.rollup(obs), docs, run={"run_id": "2"})
    assert a["identity"] == b["identity"] and playbook.problems(a) == []
    assert playbook.canonical({"b": [2, 1], "a": "é́"}) == '{"a":"é́","b":[2,1]}'
    bad = json.loads(json.dumps(a))
    bad["evidence"]["clauses"].append(bad["evidence"]["clauses"][0])
    bad["agreement_type"]["name"] = "Te​st"
    assert {m for m, _, _ in playbook.problems(bad)} == {"id clause-cap is there 2 times", "invisible characters", "content hash differs"}
    p = playbook.posture({"rounds": "two", "leverage": "We may waive indemnity caps.", "audience": "counsel"})
    assert p["version"] == 1 and playbook.conflicts(p["system_prompt"], [{"id": "i", "statement": "Never lift the indemnity cap"}])
    cand = playbook.interview_candidates({"sacred_clauses": "IP stays ours; Liability cap", "flexible_clauses": "liability cap"})
    inv = playbook.promote(cand, [])
    assert [c["auto_rejected"] for c in cand] == [False, True] and len(inv) == 1 and playbook.promote(cand, inv) == inv
    assert "## Floor" in playbook.prompt(a) and "<td>Cap</td>" in playbook.html(a)
    assert [(c["clause_id"], c["position"], c["error"]) for c in playbook.curate("pin CAP hold\nunpin nothing\ndance", a["evidence"]["clauses"])] == [("clause-cap", "hold", None), (None, None, "unknown clause"), (None, None, "unknown command")]
    out = playbook.publish({"evidence": {"t": "Acme pays"}}, lambda s: s.replace("Acme", "[redacted]"), ["Acme"])
    assert out["evidence"]["t"] == "[redacted] pays"
    with pytest.raises(ValueError):
        playbook.publish({"evidence": {"t": "Acme pays"}}, lambda s: s, ["Acme"])


def test_identity():
    doc = {"evidence": {"clauses": [{"id": "b"}, {"id": "a"}]}, "compiler": {"run_id": "1", "generated_at": "now", "name": "x"}, "curation": {"p": 1}, "floor": {}, "n": [1.0, 1, "é", "é"]}
    assert playbook.canonical_document(doc) == '{"compiler":{"name":"x"},"evidence":{"clauses":[{"id":"b"},{"id":"a"}]},"floor":{},"n":[1.0,1,"é","é"]}'
    turned = dict(reversed(doc.items()))
    assert playbook.identity(doc) == playbook.identity({**turned, "compiler": {"name": "x", "run_id": "2"}, "identity": {}})
    swapped = {**doc, "evidence": {"clauses": [{"id": "a"}, {"id": "b"}]}}
    assert playbook.identity(doc)["content_hash"] != playbook.identity(swapped)["content_hash"]
    digests = playbook.identity(doc)["section_digests"]
    assert digests["posture"] == digests["floor"] == "sha256:44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a" and digests["curation"] != digests["floor"]


def test_verdict_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def put(n, *rows):
        (log / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "kind", "value", "seq"), r))) for r in rows))

    allowed = {"scope": ("in", "out")}
    run = lambda: verdict_log.follow(spark, str(log), str(tmp_path / "t"), str(tmp_path / "c"), allowed).awaitTermination(60)
    put(1, ("a", "scope", "in", 1), ("b", "scope", "nonsense", 2))
    run()
    put(2, ("a", "scope", "out", 3), ("c", "scope", "in", 4), ("d", "other", "in", 5))
    run()
    got = {(r.key, r.value) for r in verdict_log.current(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", "out"), ("c", "in")}
    for n in range(3, 6):
        put(n, ("a", "scope", "in", 10 + n))
        run()
    assert {(r.key, r.value, r.seq) for r in verdict_log.current(spark, str(tmp_path / "t")).collect()} == {("a", "in", 15), ("c", "in", 4)}
    assert len(list((tmp_path / "t/manifest").iterdir())) == 2 and len(list((tmp_path / "t/parts").iterdir())) <= 3
    assert {r.problem for r in spark.read.parquet(str(tmp_path / "t/rejects/v1")).collect()} == {"unknown_kind"}


def test_components(spark):
    from dealgrain.operators.graph import connected_components

    import random

    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    one_, many = (sorted(map(tuple, connected_components(df, checkpoint, small).collect())) for small in (10**6, 0))
    assert {x for x in one_ if x[0] != x[1]} == {x for x in many if x[0] != x[1]}


def test_similar_sets_are_folded(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [f"w{x}" for x in sorted(rng.sample(range(25), rng.randrange(4, 12)))]) for i in range(150)]
    rows += [(1000 + i, list(reversed(rows[i % 3][1]))) for i in range(20)] + [(2000, [])]
    df = spark.createDataFrame(rows, "key int, words array<string>")
    held = {i: set(w) for i, w in rows if w}
    for bound in (0.3, 0.6, 0.8, 1.0):
        want = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in itertools.combinations(sorted(held), 2)}
        want = {k: v for k, v in want.items() if v >= bound}
        got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, bound, checkpoint=checkpoint).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        from dealgrain.operators.graph import connected_components

        roots = {tuple(r) for r in connected_components(similarity.similar_links(df, bound, checkpoint=checkpoint), checkpoint).collect()}
        assert roots == {tuple(r) for r in connected_components(spark.createDataFrame(sorted(want) or [(0, 0)], "u bigint, v bigint"), checkpoint).collect()}
        over = {(a, b): len(held[a] & held[b]) / min(len(held[a]), len(held[b])) for a, b in itertools.combinations(sorted(held), 2)}
        got = {(r.a, r.b): r.similarity for r in similarity.overlapping_pairs(df, bound, "key", "words", checkpoint).collect()}
        assert got == {k: v for k, v in over.items() if v >= bound}
    best = {a: max((len(held[a] & held[b]) / len(held[a] | held[b]) for b in held if b != a and held[a] & held[b]), default=None) for a in held}
    got = {r.key: r.similarity for r in similarity.nearest(df, "key", "words", checkpoint=checkpoint).collect()}
    assert got == {k: v for k, v in best.items() if v is not None}


def test_copies_make_ties_and_not_pairs(spark):
    df = spark.range(10_000).select(F.col("id").alias("key"), F.array(*[F.lit(f"w{i}") for i in range(9)]).alias("words"))
    assert similarity.similar_links(df, 0.8, checkpoint=checkpoint).count() == 9_999


def test_hints_decide_between_equal_orders(spark):
    texts = {1: "a\nb\nc", 2: "a\nb\nd", 3: "a\nb\ne", 4: "a\nb\nsigned"}
    rows = [(7, v, f"v{v}", t, v == 4) for v, t in texts.items()] + [(8, 1, "v1", "alone", False)]
    v = spark.createDataFrame(rows, "document_id bigint, version bigint, name string, text string, signed boolean")

    def run(df, hints=None):
        got = versions.order_versions(df, hints).collect()
        return [r.version for r in sorted(got, key=lambda r: r.version_ord) if r.document_id == 7], {r.document_id: r.basis for r in got}

    assert run(v) == ([1, 2, 3, 4], {7: "exhaustive", 8: "single"})
    hint = lambda order, times: spark.createDataFrame([(7, order, times)], "document_id bigint, version_order array<string>, timestamps map<string,string>")
    assert run(v, hint(["v3", "v1", "v2", "v4"], {})) == ([3, 1, 2, 4], {7: "hints", 8: "single"})
    assert run(v, hint([], {"v2": "2020", "v1": "2021", "v3": "2022"})) == ([2, 1, 3, 4], {7: "hints", 8: "single"})
    assert run(v, hint(["v1", "v2"], {}))[1][7] == "exhaustive"  # the first of the cheapest agrees already
    dated = v.withColumn("timestamp", F.when(F.col("version") == 3, "2019").when(F.col("version") == 1, "2020"))
    assert run(dated)[0].index(3) < run(dated)[0].index(1)
    assert run(dated, hint([], {"v3": "2021"}))[0].index(1) < run(dated, hint([], {"v3": "2021"}))[0].index(3)  # an explicit hint goes before a version's own date
    far = v.where("document_id = 7").withColumn("text", F.when(F.col("version") == 2, "x\ny\nz").otherwise(F.col("text")))
    assert run(far, hint(["v3", "v2", "v1"], {}))[0][0] == 2  # content is stronger than hints
    many = spark.createDataFrame([(7, i, f"v{i}", "\n".join(map(str, range(i, i + 12))), False) for i in range(11)], v.schema)
    got, basis = run(many)
    assert basis == {7: "greedy"} and got in (list(range(11)), list(range(10, -1, -1)))


def test_terminals_and_representatives(spark):
    line = lambda a, b: "\n".join(f"l{i}" for i in range(a, b))
    rows = [(1, 1, "v1", line(0, 6), False), (1, 2, "v2", line(0, 9), False), (2, 1, "v1", "x", False), (3, 1, "a", line(0, 6), False), (3, 2, "b", line(2, 8), False), (3, 3, "c", line(4, 10), True)]
    v = spark.createDataFrame(rows, "document_id bigint, version bigint, name string, text string, signed boolean")
    ordered = versions.order_versions(v)
    held = v.join(ordered.select("document_id", "version", "terminals"), ["document_id", "version"]).withColumn("confidence", F.lit(0.9)).withColumn("natural_key", F.col("name"))
    assert {(r.document_id, r.version, r.basis) for r in versions.representative(held).collect()} == {(1, 2, "filename_tiebreak"), (2, 1, "single"), (3, 3, "signed")}
    assert {r.document_id: r.terminals for r in ordered.collect()}[1] == [1, 2]
    one_end = held.withColumn("terminals", F.when(F.col("document_id") == 1, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("terminals")))
    assert ("chain_terminal", 1) in {(r.basis, r.version) for r in versions.representative(one_end).collect()}


def test_template_similarity(spark):
    df = spark.createDataFrame([(1, "a\n b \nc"), (2, "x\ny"), (3, None)], "k int, text string")
    got = {r.k: round(r.similarity, 6) for r in versions.template_similarity(df, "a\nb\nc\nd").collect()}
    assert got == {1: round(6 / 7, 6), 2: 0.0, 3: 0.0}


def test_shapes_are_those_of_the_function(spark):
    import random

    rng = random.Random(4)
    steps = {k: [rng.choice([0.0, 0.1, 0.15, 0.2, 0.3, 0.39, 0.41, 0.6]) for _ in range(rng.randrange(1, 6))] for k in range(120)}
    df = spark.createDataFrame([(k, s) for k, v in steps.items() for s in v], "key int, step double")
    assert {r.key: r["shape"] for r in versions.shapes(df, "key").collect()} == {k: versions.chain_shape(v) for k, v in steps.items()}


def test_names_in_one_pass(spark):
    import random

    rng = random.Random(6)
    parts = ["acme", "globex", "corp", "holdings", "inc", "of", "ohio", "north"]
    names = redact.aliases([" ".join(rng.sample(parts, rng.randrange(1, 4))) for _ in range(60)])
    texts = [" ".join(rng.choice([*parts, "ACME", "said", "é", "x-corp", "Inc."]) + rng.choice(["", "", " ", "\n"]) for _ in range(30)) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert len(names) > 32
    fold, once = (df.select("t", redact.pseudonymize(F.col("t"), names, few).alias("x")).collect() for few in (1000, 0))
    assert [r.x for r in fold] == [r.x for r in once]
    keyed = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    import re

    want = set()
    for k, t in enumerate(texts):
        plain = f" {re.sub(r'[^0-9a-zà-ÿ]+', ' ', (t or '').lower()).strip()} "
        want |= {(k, n) for n in names if f" {n} " in plain or (len(n.replace(" ", "")) >= 8 and n.replace(" ", "") in plain.replace(" ", ""))}
    assert {(r.k, r.name) for r in redact.known_names(keyed, "k", "t", list(names)).collect()} == want


def test_paths_and_fuzzy_names(spark):
    import re

    assert one(spark, "see /home/ann/deals/msa v2.docx or C:\\deals\\a.pdf", redact.strip_paths) == "see msa v2.docx or a.pdf" or one(spark, "see /home/ann/msa.docx", redact.strip_paths) == "see msa.docx"
    assert re.search(redact.fuzzy_name("Acme Corp, Inc."), "by ACME-Corp today") and re.search(redact.fuzzy_name("Acme Corp, Inc."), "acme") and not re.search(redact.fuzzy_name("Acme Corp"), "acmes")


def test_export_rounds(spark):
    s = spark.createDataFrame([("a", "mail ann@corp.example"), ("b", "Globex pays"), ("c", "fine")], "path string, text string")
    none = spark.createDataFrame([], "key_hash string, rewritten string")
    out, left = redact.export_round(s, "path", "text", none, ["Globex"])
    assert {(r.path, tuple(r.kinds)) for r in left.collect()} == {("a", ("email",)), ("b", ("known_name",))}
    told = left.select("key_hash", F.lit("rewritten").alias("rewritten"))
    out, left = redact.export_round(s, "path", "text", told, ["Globex"])
    assert left.isEmpty() and {r.path: r.text for r in out.collect()} == {"a": "rewritten", "b": "rewritten", "c": "fine"}


def test_verdicts_that_wait(spark):
    from dealgrain.operators import judges

    rows = spark.createDataFrame([(1, "our_paper", "alias_first_party", 0.85, "p1", ""), (2, "our_paper", "alias_present", 0.65, "p2", ""), (3, "our_paper", "alias_present", 0.65, "p2", ""), (4, "our_paper", "alias_absent", 0.65, "p4", "")], "document_id int, provenance string, basis string, confidence double, preamble string, letterhead string")
    key = integrity.payload_key(stage=F.lit("provenance"), preamble=F.lit("p2"), letterhead=F.lit(""), agreement_type=F.lit("x"))
    told = spark.range(1).select(key.alias("key"), F.lit("counterparty_paper").alias("provenance"), F.lit(None).cast("double").alias("confidence"))
    out, wait = judges.provenance(rows, told, "x")
    assert {(r.document_id, r.provenance, r.basis, r.confidence) for r in out.collect()} == {(1, "our_paper", "alias_first_party", 0.85), (2, "counterparty_paper", "judge", 0.65), (3, "counterparty_paper", "judge", 0.65), (4, "our_paper", "alias_absent", 0.65)}
    assert wait.count() == 1


def test_cycles_of_any_length(spark):
    from dealgrain.operators import segments

    up = {1: None, 2: 1, 3: 2, 10: 12, 11: 10, 12: 11, 13: 12, 20: 20, 30: 99, **{100 + i: 100 + i - 1 for i in range(1, 40)}, 100: 1}
    nodes = spark.createDataFrame([(5, k, v, k, k) for k, v in up.items()], "document_id int, node_id int, parent_id int, start_block int, end_block int")
    blocks = nodes.select("document_id", F.col("node_id").alias("block_id"), F.col("node_id").alias("ord"))
    got = {(r.node_id, r.problem) for r in segments.grounding_problems(nodes, blocks, checkpoint).collect()}
    assert got == {(10, "cycle"), (11, "cycle"), (12, "cycle"), (13, "cycle"), (20, "cycle"), (30, "unknown_parent")}


def test_tree_hash(spark):
    import hashlib

    lines = [f"line {i % 300}" for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    h = sorted(hashlib.sha256(x.encode()).hexdigest() for x in lines)
    leaves = {}
    for x in h:
        leaves.setdefault(x[:2], []).append(x)
    root = hashlib.sha256("\n".join(sorted(f"{k}:{hashlib.sha256(chr(10).join(v).encode()).hexdigest()}" for k, v in leaves.items())).encode()).hexdigest()
    for n in (1, 7):
        assert [tuple(r) for r in integrity.tree_hash(df.repartition(n), F.col("x"), digits=2).collect()] == [(1000, root)]


def test_digest_and_checks_of_playbooks():
    forms = [{"n": 1, "text_summary": "x" * 400, "material": True} for _ in range(50)]
    doc = {"evidence": {"clauses": [{"id": "a", "observed_positions": forms}]}}
    assert playbook.digest(doc, 10)["over_budget"] and playbook.digest(doc, 10)["top"] == 3 and not playbook.digest({"evidence": {"clauses": []}})["over_budget"]
    ref = {"document_id": "d", "version": 1, "clause_path": "1"}
    clause = {"observed_positions": [{"example_ref": ref, "precedent_count": 12}], "summary": {"acceptable_if": [{"if": "A", "to": "b"}, {"if": "a", "to": "B!", "observation_ref": ref}, "plain words", {"if": "", "to": ""}, "third", "fourth"]}}
    got = playbook.variations(clause, 2)
    assert got == [{"if": "a", "to": "B!", "observation_ref": ref, "n": 13, "band": "often"}, "plain words"]
    bad = {
        "corpus": {"documents": [{"document_id": "d", "versions": 2, "provenance": "counterparty_paper"}]},
        "evidence": {"clauses": [
            {"our_standard": {"source_ref": {"document_id": "d"}}, "observed_positions": [{"provenance": "counterparty_paper", "observed_at": "2024-Q2"}, {"provenance": "counterparty_paper", "observed_at": "May"}], "summary": {"position": "standard", "held": 1, "of": 2, "historical_stance": "consistently_held"},
             "negotiation_trail": [{"ref": {"document_id": "d", "version": 3}}, {"ref": {"document_id": "e", "version": 1}}, {"ref": {"document_id": "d", "version": 2}}]},
            {"summary": {"held": 2, "of": 2, "historical_stance": "usually_conceded"}},
        ]},
    }
    assert [m for m, _, _ in playbook.provenance_problems(bad)] == ["standard from a counterparty's paper", "position is settled by counterparties' papers alone"]
    assert [(m, b) for m, _, b in playbook.dynamics_problems(bad)] == [("held always, but not by its counts", False), ("unknown version of a document", True), ("unknown document", True), ("no date", True), ("conceded, but not by its counts", False)]


def test_floor_states():
    cand = [{"id": "c1", "slug": "ip", "statement": "IP stays ours", "decision": "accepted"}, {"id": "c2", "slug": "cap", "statement": "Cap", "decision": "rejected", "auto_rejected": True}, {"id": "c3", "slug": "x", "statement": "X", "decision": "rejected"}]
    inv = playbook.sign(cand, [], "Ann", "2024-05-01")
    assert [(i["id"], i["signed_by"]) for i in inv] == [("inv-ip", "Ann")] and playbook.sign(cand, inv, "Bob", "2025-01-01") == inv
    assert [s for _, s in playbook.floor_states(cand, inv)] == ["signed", None, "rejected"]


def test_large_corpora_are_named_by_a_hash(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(playbook, "LISTED", 5)
    obs = observe(spark, *[("cap", "neutral", "our_paper", "signed", "none", "judge")] * 3)
    docs = spark.createDataFrame([(f"d{i}", 2) for i in range(9)], "document_id string, versions int")
    a, b = (playbook.assemble({"id": "x", "name": "T"}, rollup.rollup(obs), d) for d in (docs, docs.repartition(3)))
    assert a["corpus"]["documents"] == [] and a["corpus"]["stats"]["documents"] == 9 and a["identity"] == b["identity"] and len(a["corpus"]["stats"]["manifest_hash"]) == 64
    playbook.write_atomic(a | {"format_version": "0.2"}, str(tmp_path / "p.json"))
    assert playbook.load(str(tmp_path / "p.json"))["corpus"]["stats"]["clauses"] == 1


def test_reports_say_what_is_left_out(spark):
    from dealgrain.plans import reports

    text_ = reports.markdown("T", {"Rows": spark.range(30).select((-F.col("id")).alias("x")), "None": spark.range(0)}, most=3)
    assert "| -29 |" in text_ and "27 more rows are left out." in text_ and text_.rstrip().endswith("none")


def test_parsed_once(spark, tmp_path):
    for name in ("a/v1.rtf", "b/v1.rtf", "b/v2.rtf"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"junk" if name == "b/v2.rtf" else RTF.encode())
    found = files.scan(spark, str(tmp_path / "in"))
    table = str(tmp_path / "cache")
    plain = sorted(map(repr, files.parsed(found).collect()))
    for _ in range(2):
        assert sorted(map(repr, files.cached(found, table, "1").collect())) == plain
    assert spark.read.parquet(table).select("content_key").distinct().count() == 2
    listing = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [files.layout(listing(*p)) for p in (["a/v1.rtf"], ["a/Versions/v1.rtf"], ["a/EXECUTED_x.pdf"], ["manifest.jsonl", "a/v1.rtf"])] == ["flat", "clm_nested", "clm_nested", "manifest"]
    df = spark.createDataFrame([("x", 1), ("y", None)], "k string, n int")
    files.write_jsonl(df, str(tmp_path / "rows"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "rows"), "k string, n int").collect())) == [("x", 1), ("y", None)]


def test_taxonomy_yaml(spark):
    from dealgrain.sources import config

    out = config.taxonomy_yaml(spark.createDataFrame([("b", 'Say "x"', True), ("a", None, False)], "id string, label string, structural boolean"), "msa")
    assert out == 'taxonomy: "msa"\nentries:\n  - id: "a"\n    label: null\n    structural: false\n  - id: "b"\n    label: "Say \\"x\\""\n    structural: true\n'


def test_counts_by_window(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("k1", "scope", at(1)), ("k2", "scope", at(2)), ("k3", "floor", at(7))], "key string, kind string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, kind string, at timestamp").parquet(str(tmp_path / "in"))
    q = verdict_log.counts_by_window(stream, "at").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.kind, r.n) for r in spark.table("counted").collect()} == {("scope", 2), ("floor", 1)}


def test_set_join_passes_on_sets_and_pairs_alone(spark):
    import random

    rng = random.Random(5)
    sets = [(k, sorted(rng.sample(range(60 * (k % 3), 60 * (k % 3) + 80), 30))) for k in range(300)]
    sets += [(1000 + k, [x for x in s if x != s[3]] + [500 + k]) for k, s in sets[:40]] + [(2000, list(range(900, 1700))), (2001, list(range(905, 1720)))]
    df = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets], "key int, words array<string>")
    rows = []

    def counted(d):
        d = checkpoint(d)
        rows.append(d.count())
        return d

    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, 0.8, checkpoint=counted).collect()}
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) >= 41
    assert max(rows) <= len(sets) and rows[-1] <= 2 * len(want)


def test_many_copies_of_a_set_meet_once(spark):
    from dealgrain.operators.similarity import _Meet

    sets = [(k, [str(x) for x in range(20)] + ([] if k % 2 else ["end"])) for k in range(2000)]
    df = spark.createDataFrame(sets, "key int, words array<string>")
    assert similarity.similar_links(df, 0.8, checkpoint=checkpoint).count() == 1999
    assert list(_Meet(0.8)(iter([]))) == []


def test_equal_clauses_are_matched_in_one_pass(spark):
    edges = [("g", i, j, 1.0) for i in range(40) for j in range(40)] + [("h", 1, 1, 0.8), ("h", 1, 2, 0.9), ("h", 2, 2, 0.95)]
    calls = []

    def once(d):
        calls.append(1)
        return checkpoint(d)

    got = similarity.greedy_matching(spark.createDataFrame(edges, "group string, i int, j int, similarity double"), once).collect()
    assert {(r.group, r.i, r.j) for r in got} == {("g", i, i) for i in range(40)} | {("h", 1, 1), ("h", 2, 2)} and len(calls) == 1


def test_likely_keeps_all_that_are_asked_for(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    asked = spark.range(0, 5000, 50).select("id")
    got = {r.doc_id for r in similarity.likely(rows, "doc_id", asked).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 150
    assert similarity.likely(rows, "doc_id", asked.where("id < 0")).count() == 0


def test_pairs_that_overlap_come_once_from_the_join(spark):
    import random

    from dealgrain.operators.similarity import _Overlap

    rng = random.Random(9)
    sets = [(k, sorted(rng.sample(range(40), rng.randrange(0, 7)))) for k in range(200)] + [(300, list(range(90)))]
    df = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets], "node bigint, words array<string>")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in similarity.overlapping_pairs(df, 0.5, "node", "words", checkpoint).collect())
    over = {(a, b): len(set(x) & set(y)) / min(len(x), len(y)) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y}
    assert got == [(a, b, round(v, 9)) for (a, b), v in sorted(over.items()) if v >= 0.5]
    assert list(_Overlap(0.5)(iter([]))) == []


def test_taxonomy_writes_edges_by_number(spark):
    wide = []

    def seen(d):
        wide.append([k for c, k in d.dtypes if c in ("a", "b", "leader")])
        return checkpoint(d)

    heads = spark.createDataFrame([(d, h) for d in range(4) for h in ("Governing law", "Governing law and venue", "Term", "Term of agreement")], "document_id bigint, heading string")
    got = {r.leader: (r.documents, r.forms) for r in classify.induce(heads, seen).collect()}
    assert got == {"governing law": (4, 2), "term": (4, 2)}
    assert any(wide) and all(k == "bigint" for kinds in wide for k in kinds)


def test_trail_keeps_versions_with_their_document(spark):
    from dealgrain.operators import judges

    order = spark.createDataFrame([(d, v, v, "gap" if d < 3 else "linear", "exhaustive") for d in range(1, 5) for v in range(1, 5)] + [(5, 1, 1, "linear", "greedy"), (None, 1, 1, "gap", "greedy")], "document_id bigint, version bigint, version_ord int, shape string, basis string")
    key = lambda d, vs: integrity.payload_key(stage=F.lit("trail"), document=F.lit(d).cast("bigint"), versions=F.lit(vs))
    one = spark.range(1)
    verdicts = one.select(key(1, "1,2,3,4").alias("key"), F.array(*[F.lit(x).cast("bigint") for x in (4, 3, 2, 1)]).alias("versions")).unionByName(one.select(key(2, "1,2,3,4").alias("key"), F.array(*[F.lit(x).cast("bigint") for x in (4, 3, 2)]).alias("versions"))).unionByName(one.select(key(3, "1,2,3,4").alias("key"), F.array(*[F.lit(x).cast("bigint") for x in (4, 3, 2, 1)]).alias("versions")))
    out, pending = judges.trail(order, verdicts)
    got = sorted(((r.document_id or 0, r.version, r.version_ord, r.basis) for r in out.collect()))
    assert got == sorted([(0, 1, 1, "greedy"), (5, 1, 1, "greedy")] + [(1, v, 5 - v, "judge") for v in range(1, 5)] + [(d, v, v, "exhaustive") for d in (2, 3, 4) for v in range(1, 5)])
    assert pending.count() == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(version" in plan and "Window" not in plan


def test_deals_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from dealgrain.operators import intake
    from dealgrain.operators.graph import connected_components

    rng = random.Random(4)
    rows = [(f"{k:03d}", [str(x) for x in rng.sample(range(300), rng.randrange(0, 25))], rng.sample(["p", "q", "r", None], rng.randrange(0, 3))) for k in range(160)]
    rows += [(f"x{k}", rows[k][1], []) for k in range(10)]
    df = spark.createDataFrame(rows, "path string, words array<string>, parties array<string>")
    ids = {r.path: r.id for r in df.select("path", F.xxhash64("path").alias("id")).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    links = [(ids[p], ids[q]) for (p, a, s), (q, b, t) in itertools.combinations(rows, 2) if like(a, b) >= 0.35 or (like(a, b) >= 1 - 0.90 and {x for x in s if x} & {x for x in t if x})]
    root = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint"), checkpoint).collect()}
    want = {}
    for p in sorted(ids):
        want.setdefault(root.get(ids[p], ids[p]), p)
    want = {p: want[root.get(i, i)] for p, i in ids.items()}
    for held in (12_000_000, 200):
        monkeypatch.setattr(similarity, "HELD", held)
        assert {r.path: r.deal for r in intake.deals(df, checkpoint).collect()} == want
