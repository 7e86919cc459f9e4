"""A small corpus from clauses to a playbook."""

import os

import pytest
from dealgrain.plans import mine, playbook, reports
from dealgrain.sources import config
from pyspark.sql import functions as F

LAW = "This agreement is governed by the laws of the state of Ohio without regard to conflicts of law"
CAP = "The liability of either party under this agreement is limited to the fees paid in the twelve months before"
PAY = "Invoices are due within thirty days of receipt and bear interest of one percent each month when late"
SIGN = "IN WITNESS WHEREOF the parties sign\nBy: Ann Lee\nBy: Bob Ray"


def corpus(spark):
    rows = []
    for doc in ("deal-a", "deal-b"):
        for v, (law, cap, pay) in enumerate([(LAW, CAP, PAY), (LAW, CAP + " and doubled for gross negligence events", PAY.replace("thirty", "forty five calendar")), (LAW, CAP, PAY.replace("thirty", "forty five calendar"))], 1):
            opening = "between Acme and Globex. " + ("Draft terms" if v == 1 else "Terms")
            for k, (head, text) in enumerate([(None, opening), ("Governing Law", law), ("Liability Cap", cap), ("Payment Terms", pay), ("Signatures", SIGN if v == 3 else "By: ____")]):
                rows.append((doc, str(v), k, str(k), head, text))
    rows += [("tiny", "1", 0, "1", "Only", "one"), ("broken", "1", -1, None, None, "bad file")]
    return spark.createDataFrame(rows, "document_id string, version string, ord int, clause_path string, heading string, text string")


def test_mine_and_project(spark):
    tax = config.taxonomy(spark, [{"id": "law", "label": "Governing Law"}, {"id": "cap", "label": "Liability Cap"}, {"id": "pay", "label": "Payment Terms"}, {"id": "sig", "label": "Signatures", "structural": True}])
    none = spark.createDataFrame([], "key string, deviation string, direction string, magnitude string")
    first = mine.mine(spark, corpus(spark), tax, ["Acme"], none)
    assert {(r.document_id, r.in_scope) for r in first.scope.collect()} == {("deal-a", True), ("deal-b", True), ("tiny", False)}
    assert {(r.document_id, r.version, r.version_ord) for r in first.order.where("version = 3").collect()} == {("deal-a", 3, 3), ("deal-b", 3, 3)}
    assert {(r.document_id, tuple(r.lost_words)) for r in first.reversals.collect() if "gross" in r.lost_words} == {("deal-a", ("doubled", "events", "gross", "negligence")), ("deal-b", ("doubled", "events", "gross", "negligence"))}
    obs = {(r.document_id, r.taxonomy_id): r for r in first.observations.where("taxonomy_id is not null").collect()}
    assert obs[("deal-a", "law")].outcome == "signed" and obs[("deal-a", "law")].deviation == "none" and obs[("deal-a", "law")].provenance == "our_paper"
    assert obs[("deal-a", "cap")].outcome == "proposed_then_reversed" and obs[("deal-a", "pay")].deviation in ("none", "needs_review")
    ids = [r.observation_id for r in first.observations.collect()]
    assert len(set(ids)) == len(ids)
    wait = first.pending.where("kind = 'deviation'")
    assert wait.count() > 0
    verdicts = wait.select("key", F.lit("substantive").alias("deviation"), F.lit("worse").alias("direction"), F.lit("minor").alias("magnitude"))
    second = mine.mine(spark, corpus(spark), tax, ["Acme"], verdicts)
    assert second.pending.where("kind = 'deviation'").count() == 0
    doc = mine.project(second, {"id": "msa", "name": "Services"})
    stances = {c["taxonomy_id"]: c["summary"]["position"] for c in doc["evidence"]["clauses"]}
    assert stances["law"] == "standard" and stances["cap"] == "hold_firm"
    assert not [m for m, _, blocking in playbook.problems(doc) if blocking] and playbook.digest(doc)["top"] == 5
    assert doc["identity"] == mine.project(second, {"id": "msa", "name": "Services"})["identity"]
    told = reports.after_action(second, verdicts)
    assert all(f"## {x}" in told for x in ("Corpus", "Backbone", "Meaning", "Economics", "Honesty", "Quarantine")) and "| outcome | proposed_then_reversed |" in told


def test_unequal_buckets(spark):
    rows = [("d", 1, 1, "alpha beta gamma", "x"), ("d", 1, 2, "delta epsilon", "x"), ("d", 2, 1, "delta epsilon zeta", "x"), ("d", 3, 1, "unrelated words", "x"), ("e", 1, 1, "one", "y"), ("e", 2, 1, "two", "y")]
    df = spark.createDataFrame(rows, "document_id string, version_ord int, ord int, text string, taxonomy_id string")
    out = {(r.document_id, r.version_ord, r.ord): (r.alignment, r.match_basis) for r in mine.align(df).collect()}
    assert out[("d", 2, 1)][0] == out[("d", 1, 2)][0] and out[("d", 3, 1)][1] == "own_row" and out[("e", 1, 1)][0] == out[("e", 2, 1)][0]


def test_side_files(spark, tmp_path):
    assert config.config({"agreement_type": {"id": "x"}, "provenance": {"our_party_aliases": ["Acme"]}}).aliases == ("Acme",)
    for bad in ({"agreement_type": {"id": "x"}, "odd": 1}, {}, {"agreement_type": {"id": "x"}, "classification": {"ambiguity_threshold": 0.9}}):
        with pytest.raises(config.ConfigError):
            config.config(bad)
    with pytest.raises(config.ConfigError):
        config.taxonomy(spark, [{"id": "a"}, {"id": "a"}])
    h = config.hints(spark, {"d": {"order": ["v1.docx", "v2"], "signed_version": "v2.pdf"}}).first()
    assert (h.version_order, h.signed_version) == (["v1", "v2"], "v2")
    assert config.safe_component("a.rtf") and not config.safe_component("../a") and not config.safe_component("..")
    path = tmp_path / "aliases.json"
    config.write_private({"Acme": "Counterparty-1"}, str(path))
    assert os.stat(path).st_mode & 0o777 == 0o600 and config.load(str(path)) == {"Acme": "Counterparty-1"}


def test_scopes_hints_and_settings(spark):
    tax = config.taxonomy(spark, [{"id": "law", "label": "Governing Law"}, {"id": "cap", "label": "Liability Cap"}, {"id": "pay", "label": "Payment Terms"}])
    none = spark.createDataFrame([], "key string, deviation string, direction string, magnitude string")
    scopes = spark.createDataFrame([("deal-b", False, "a purchase order")], "document_id string, in_scope boolean, scope_rationale string")
    hints = config.hints(spark, {"deal-a": {"order": ["2", "1", "3"], "signed_version": "2", "provenance": "counterparty_paper"}})
    settings = config.config({"agreement_type": {"id": "msa"}, "classification": {"ambiguity_threshold": 0.2, "auto_classify_threshold": 0.3}, "provenance": {"known_entities": ["Deal A", "Globex"]}})
    renamed = corpus(spark).withColumn("heading", F.when(F.col("heading") == "Governing Law", "Governing Law and Venue").otherwise(F.col("heading")))
    got = mine.mine(spark, renamed, tax, ["Acme"], none, scopes=scopes, hints=hints, settings=settings)
    assert {(r.document_id, r.in_scope, r.basis, r.scope_rationale) for r in got.scope.collect()} == {("deal-a", True, "judge_failed", None), ("deal-b", False, "judge", "a purchase order"), ("tiny", False, "too_short", None)}
    assert {r.document_id for r in got.pending.where("kind = 'scope'").collect()} == {"deal-a"} and {r.document_id for r in got.order.collect()} == {"deal-a"}
    order = {r.version: r for r in got.order.collect()}
    assert order[2].version_ord == 3 and {r.basis for r in order.values()} <= {"exhaustive", "hints"}
    obs = got.observations.collect()
    assert {r.provenance for r in obs} == {"counterparty_paper"} and {r.counterparty_ref for r in obs} == {"Deal A"}
    assert any(r.taxonomy_id == "law" for r in obs)  # by a heading that is alike at 0.3 and not at 0.85
    strict = mine.mine(spark, renamed, tax, ["Acme"], none)
    assert not any(r.taxonomy_id == "law" for r in strict.observations.collect())
    ours = mine.mine(spark, corpus(spark), tax, ["Nobody"], none, template="\n".join(["between Acme and Globex. Draft terms", "Governing Law", LAW, "Liability Cap", CAP, "Payment Terms", PAY]))
    assert {r.provenance for r in ours.observations.collect()} == {"our_paper"}
    doc = mine.project(mine.mine(spark, corpus(spark), tax, ["Acme"], none), {"id": "msa", "name": "Services"}, min_evidence=5)
    assert {c["summary"]["evidence_sufficient"] for c in doc["evidence"]["clauses"]} == {False}


def test_reversed_twice_counts_once(spark):
    net = spark.createDataFrame([], "document_id string, alignment bigint, taxonomy_id string, clause_path string, before string, after string, kind string, deviation string, basis string, confidence double, our_standard string")
    back = spark.createDataFrame([("d", 1, 2, "second"), ("d", 1, 1, "first"), ("d", 2, 1, "other")], "document_id string, alignment bigint, round int, proposed_text string")
    docs = spark.createDataFrame([("d", "our_paper", True, 4)], "document_id string, provenance string, signed boolean, versions int")
    none = spark.createDataFrame([], "key string, deviation string, direction string, magnitude string")
    for n in (1, 3):
        got = mine.observe(net, back.repartition(n), docs, none).collect()
        assert {(r.alignment, r.full_text, r.outcome) for r in got} == {(1, "first", "proposed_then_reversed"), (2, "other", "proposed_then_reversed")}


def test_commands(spark, tmp_path, capsys):
    import json

    from dealgrain.__main__ import main

    rtf = lambda *paras: (r"{\rtf1 " + "".join(p + r"\par " for p in paras) + "}").encode()
    later = PAY.replace("thirty", "forty five calendar")
    for v, extra, pay in ((1, "", PAY), (2, " and doubled for gross negligence", later), (3, "", later)):
        path = tmp_path / "in/deal-a" / f"v{v}.rtf"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rtf("GOVERNING LAW", LAW, "LIABILITY CAP", CAP + extra, "PAYMENT", pay))
    (tmp_path / "config.json").write_text(json.dumps({"agreement_type": {"id": "msa", "name": "Services"}, "provenance": {"our_party_aliases": ["Acme"], "min_evidence_n": 1}}))
    (tmp_path / "taxonomy.json").write_text(json.dumps([{"id": "law", "label": "Governing Law"}, {"id": "cap", "label": "Liability Cap"}]))
    (tmp_path / "hints.json").write_text(json.dumps({"deal-a": {"signed_version": "v3.rtf", "provenance": "our_paper"}}))
    at = lambda x: str(tmp_path / x)
    assert main(["mine", at("in"), at("out"), "--config", at("config.json"), "--taxonomy", at("taxonomy.json"), "--hints", at("hints.json")]) == 0
    obs = spark.read.parquet(at("out/observations")).collect()
    assert {(r.taxonomy_id, r.outcome, r.provenance) for r in obs if r.taxonomy_id} == {("law", "signed", "our_paper"), ("cap", "proposed_then_reversed", "our_paper")}
    assert main(["project", at("out"), at("playbook.json"), "--config", at("config.json")]) == 0
    doc = json.loads((tmp_path / "playbook.json").read_text())
    assert {c["taxonomy_id"]: c["summary"]["evidence_sufficient"] for c in doc["evidence"]["clauses"]} == {"law": True, "cap": True}
    capsys.readouterr()
    assert main(["lint", at("in")]) == 0 and main(["induce", at("in")]) == 0 and "liability_cap" in capsys.readouterr().out
    assert main(["digest", at("playbook.json")]) == 0 and json.loads(capsys.readouterr().out)["over_budget"] is False
    assert main(["prompt", at("playbook.json")]) == 0 and "## Floor" in capsys.readouterr().out
