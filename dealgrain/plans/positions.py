"""Queries over observations: positions, digests, coverage, floors, pins and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text_ops import band, natural_key, normalize, quarter, sql_dedup_key, sql_normalize
from ..operators import coverage, integrity, rollup
from .base import SQL_COUNTED, SQL_LINES, SQL_OBSERVATIONS, lines, observations, table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_FACTS = """agg AS (
  SELECT taxonomy_id, count(*) AS n_observations, count(CASE WHEN provenance = 'our_paper' THEN 1 END) AS n_our_paper, count(CASE WHEN provenance = 'counterparty_paper' THEN 1 END) AS n_counterparty_paper,
    count(CASE WHEN outcome = 'signed' AND direction = 'neutral' AND deviation <> 'none' AND basis NOT IN ('stub', 'needs_review') THEN 1 END) AS n_acceptable,
    count(CASE WHEN provenance = 'our_paper' AND outcome = 'signed' AND direction = 'worse' THEN 1 END) AS n_fallbacks,
    count(CASE WHEN outcome = 'proposed_then_reversed' THEN 1 END) AS n_rejected,
    count(CASE WHEN provenance = 'our_paper' AND outcome = 'proposed_then_reversed' THEN 1 END) AS n_our_rejected,
    count(CASE WHEN provenance = 'our_paper' AND outcome = 'signed' AND direction = 'neutral' AND deviation <> 'none' AND basis NOT IN ('stub', 'needs_review') THEN 1 END) AS n_our_variants,
    count(CASE WHEN basis = 'stub' THEN 1 END) AS n_stub,
    count(CASE WHEN provenance = 'our_paper' AND (outcome = 'proposed_then_reversed' OR direction <> 'worse') THEN 1 END) AS held_ours,
    count(CASE WHEN outcome = 'proposed_then_reversed' OR direction <> 'worse' THEN 1 END) AS held_all
  FROM counted GROUP BY taxonomy_id),
placed AS (SELECT *, CASE WHEN n_our_paper = 0 OR n_stub > 0 OR n_our_paper < 2 OR n_fallbacks > 0 THEN 'negotiable' WHEN n_our_variants > 0 THEN 'acceptable_variants_exist' WHEN n_our_rejected > 0 THEN 'hold_firm' ELSE 'standard' END AS position FROM agg),
stanced AS (SELECT *, CASE WHEN n_stub > 0 OR n_our_paper < 2 THEN 'no_signal' WHEN position = 'negotiable' THEN CASE WHEN n_our_rejected > 0 THEN 'mixed' ELSE 'usually_conceded' END
  WHEN position = 'acceptable_variants_exist' THEN 'usually_held' ELSE 'consistently_held' END AS historical_stance FROM placed)"""
_ROLL = f"WITH {SQL_OBSERVATIONS}, {SQL_COUNTED}, {_FACTS} "


@query(_ROLL + "SELECT taxonomy_id, n_observations, n_our_paper, n_counterparty_paper, round_even((n_our_paper + 0.5 * n_counterparty_paper) / (n_our_paper + n_counterparty_paper), 3) AS score, n_our_paper >= 2 AS evidence_sufficient, n_acceptable, n_fallbacks, n_rejected FROM stanced")
def precedent_rollup(spark, sf_dir):
    return rollup.rollup(observations(spark, sf_dir)).select("taxonomy_id", "n_observations", "n_our_paper", "n_counterparty_paper", "score", "evidence_sufficient", "n_acceptable", "n_fallbacks", "n_rejected")


def by_brand(spark, sf_dir):
    """Observations with the document's last digits as taxonomy: many small groups, so every branch of the cascade occurs."""
    return observations(spark, sf_dir).withColumn("taxonomy_id", F.pmod(F.col("document_id"), F.lit(5000)).cast("string"))


SQL_SMALL = f"WITH {SQL_OBSERVATIONS.replace('CASE WHEN p_size < 50 THEN p_type END AS taxonomy_id', 'CAST(l_orderkey % 5000 AS VARCHAR) AS taxonomy_id')}, {SQL_COUNTED}, {_FACTS} "


@query(SQL_SMALL + "SELECT taxonomy_id, position, historical_stance FROM stanced")
def position_cascade(spark, sf_dir):
    return rollup.rollup(by_brand(spark, sf_dir)).select("taxonomy_id", "position", "historical_stance")


@query(SQL_SMALL + "SELECT taxonomy_id, CASE WHEN n_our_paper > 0 THEN held_ours ELSE held_all END AS held, CASE WHEN n_our_paper > 0 THEN n_our_paper ELSE n_observations END AS \"of\", CASE WHEN n_our_paper > 0 THEN 'our_paper' ELSE 'all' END AS detail_basis FROM stanced")
def stance_detail(spark, sf_dir):
    return rollup.rollup(by_brand(spark, sf_dir)).select("taxonomy_id", "held", "of", "detail_basis")


@query(f"""WITH {SQL_OBSERVATIONS}, {SQL_COUNTED}, p AS (SELECT *, count(*) OVER (PARTITION BY taxonomy_id, {sql_dedup_key("full_text")}) AS precedent_count FROM counted)
SELECT taxonomy_id, document_id, version, full_text, magnitude, precedent_count, CAST(row_number() OVER (PARTITION BY taxonomy_id ORDER BY CASE magnitude WHEN 'minor' THEN 1 WHEN 'material' THEN 2 ELSE 0 END, ord) AS INTEGER) AS rank
FROM p WHERE provenance = 'our_paper' AND outcome = 'signed' AND direction = 'worse'""")
def fallbacks_ranked(spark, sf_dir):
    return rollup.fallbacks(observations(spark, sf_dir)).select("taxonomy_id", "document_id", "version", "full_text", "magnitude", "precedent_count", "rank")


@query(f"""WITH {SQL_OBSERVATIONS}, {SQL_COUNTED}, p AS (SELECT *, count(*) OVER (PARTITION BY taxonomy_id, {sql_dedup_key("full_text")}) AS precedent_count FROM counted),
k AS (SELECT *, row_number() OVER (PARTITION BY taxonomy_id, full_text ORDER BY CASE provenance WHEN 'our_paper' THEN 0 ELSE 1 END, ord) AS turn FROM p
  WHERE outcome = 'signed' AND direction = 'neutral' AND deviation <> 'none' AND basis NOT IN ('stub', 'needs_review'))
SELECT taxonomy_id, full_text, provenance, document_id, precedent_count, CAST(row_number() OVER (PARTITION BY taxonomy_id ORDER BY CASE provenance WHEN 'our_paper' THEN 0 ELSE 1 END, ord) AS INTEGER) AS rank FROM k WHERE turn = 1""")
def acceptable_variants(spark, sf_dir):
    return rollup.acceptable(observations(spark, sf_dir)).select("taxonomy_id", "full_text", "provenance", "document_id", "precedent_count", "rank")


@query(f"""WITH {SQL_OBSERVATIONS} SELECT taxonomy_id, count(*) AS n_forms, count(CASE WHEN provenance = 'counterparty_paper' THEN 1 END) AS n_counterparty_paper, array_to_string(list_sort(list(DISTINCT full_text)), '|') AS forms
FROM observations WHERE taxonomy_id IS NOT NULL AND outcome = 'signed' GROUP BY taxonomy_id""")
def clause_library(spark, sf_dir):
    return rollup.library(observations(spark, sf_dir)).withColumn("forms", F.array_join("forms", "|"))


def _forms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    own = lines(spark, sf_dir).join(docs, "doc_id")
    return own.select(F.col("source").alias("taxonomy_id"), F.col("line").alias("full_text"), F.lit(1).alias("precedent_count"), (F.length("line") > 600).alias("material"), (F.col("doc_id") * 100000 + F.col("ord")).alias("ord"))


_FORMS = f"""WITH {SQL_LINES}, forms AS (SELECT source AS taxonomy_id, line AS full_text, length(line) > 600 AS material, doc_id * 100000 + ord AS ord, {sql_normalize("line")} AS form FROM lines JOIN documents USING (doc_id)),
g AS (SELECT taxonomy_id, form, count(*) AS n, bool_or(material) AS material, min(ord) AS first_seen, coalesce(max_by(full_text, ord) FILTER (material), min_by(full_text, ord)) AS representative FROM forms WHERE form <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY taxonomy_id ORDER BY n DESC, first_seen) AS rank FROM g) """


@query(_FORMS + "SELECT taxonomy_id, representative, n, material, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 OR material")
def digest_topn(spark, sf_dir):
    return rollup.ranked_forms(_forms(spark, sf_dir), normalize(F.col("full_text"))).select("taxonomy_id", "representative", "n", "material", "rank")


@query(_FORMS + "SELECT band, count(*) AS forms, CAST(sum(n) AS BIGINT) AS observations FROM (SELECT *, CASE WHEN n >= 10 THEN 'often' WHEN n >= 2 THEN 'sometimes' ELSE 'rare' END AS band FROM r) GROUP BY band")
def digest_bands(spark, sf_dir):
    forms = _forms(spark, sf_dir).withColumn("form", normalize(F.col("full_text"))).where("form <> ''").groupBy("taxonomy_id", "form").agg(F.count("*").alias("n"))
    return forms.groupBy(band(F.col("n")).alias("band")).agg(F.count("*").alias("forms"), F.sum("n").alias("observations"))


@query("""WITH bare AS (SELECT source AS document_id, doc_id AS ord FROM documents ANTI JOIN labels USING (doc_id)), first AS (SELECT * FROM bare ORDER BY ord LIMIT 5)
SELECT document_id, count(*) AS n, coalesce((SELECT array_to_string(list_sort(list(ord)), ',') FROM first f WHERE f.document_id = bare.document_id), '') AS examples FROM bare GROUP BY document_id""")
def unclassified_coverage(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    obs = docs.join(labels, "doc_id", "left").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ord"), F.col("quality").cast("string").alias("taxonomy_id"))
    return coverage.unclassified(obs).withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {SQL_OBSERVATIONS} SELECT CASE WHEN grouping(deviation) = 0 THEN 'deviation' WHEN grouping(provenance) = 0 THEN 'provenance' ELSE 'taxonomy_id' END AS histogram,
  CASE WHEN grouping(deviation) = 0 THEN deviation WHEN grouping(provenance) = 0 THEN provenance ELSE coalesce(taxonomy_id, '(none)') END AS value, count(*) AS n
FROM observations GROUP BY GROUPING SETS ((deviation), (provenance), (taxonomy_id))""")
def semantic_coverage(spark, sf_dir):
    return coverage.histograms(observations(spark, sf_dir), "deviation", "provenance", "taxonomy_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS top_n, max_by(event_type, struct_pack(a := n, b := event_type)) AS top_value, max(n) / sum(n) > 0.9 AS degenerate FROM c GROUP BY user_id HAVING sum(n) >= 20""")
def degenerate_share(spark, sf_dir):
    return coverage.degenerate_shares(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS in_scope, count(CASE WHEN quality = 0 THEN 1 END) AS out_of_scope, count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS undecided, count(CASE WHEN d.doc_id IS NULL THEN 1 END) AS without_trail FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def corpus_coverage(spark, sf_dir):
    scope = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("in_scope"))
    return coverage.corpus(scope, table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {SQL_LINES}, n AS (SELECT d.doc_id, count(ord) AS n_clauses FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT n.doc_id, n_clauses, CASE WHEN n_clauses < 2 THEN false ELSE coalesce(quality = 1, true) END AS in_scope,
  CASE WHEN n_clauses = 0 THEN 'empty' WHEN n_clauses < 2 THEN 'too_short' WHEN quality IS NULL THEN 'judge_failed' ELSE 'judge' END AS basis,
  CAST(CASE WHEN n_clauses = 0 THEN 0.95 WHEN n_clauses < 2 THEN 0.80 WHEN quality IS NULL THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM n LEFT JOIN labels l ON l.doc_id = n.doc_id""")
def scope_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n_clauses"))
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verdict"))
    return coverage.scope_ladder(docs.join(verdicts, "doc_id", "left")).drop("verdict")


@query(f"""WITH {SQL_OBSERVATIONS}, g AS (SELECT taxonomy_id, count(DISTINCT document_id) AS n_deals, count(*) AS n_reversals, count(DISTINCT (document_id, version, clause_path)) AS n_citations
  FROM observations WHERE outcome = 'proposed_then_reversed' AND taxonomy_id IS NOT NULL AND taxonomy_id <> 'PROMO' GROUP BY 1)
SELECT *, printf('cand-%03d', row_number() OVER (ORDER BY taxonomy_id)) AS candidate_id FROM g WHERE n_deals >= 3""")
def reversal_candidates(spark, sf_dir):
    return rollup.reversal_candidates(observations(spark, sf_dir), 3, ("PROMO",))


@query(f"""WITH {SQL_OBSERVATIONS}, g AS (SELECT taxonomy_id, count(DISTINCT document_id) AS deals, count(*) AS n FROM observations WHERE outcome = 'proposed_then_reversed' GROUP BY 1)
SELECT CAST(coalesce(sum(n) FILTER (taxonomy_id IS NULL), 0) AS BIGINT) AS unclassified, CAST(coalesce(sum(n) FILTER (taxonomy_id = 'PROMO'), 0) AS BIGINT) AS structural,
  CAST(coalesce(sum(n) FILTER (taxonomy_id IS NOT NULL AND taxonomy_id <> 'PROMO' AND deals < 3), 0) AS BIGINT) AS below_min_deals FROM g""")
def omitted_reversals(spark, sf_dir):
    return rollup.omitted_reversals(observations(spark, sf_dir), 3, ("PROMO",))


@query("SELECT item_id FROM benchmark ANTI JOIN (SELECT doc_id AS item_id FROM labels WHERE quality = 1) l USING (item_id)")
def floor_coverage_gate(spark, sf_dir):
    evaluated = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"))
    return integrity.uncovered(table(spark, sf_dir, "benchmark").select("item_id"), evaluated, "item_id")


@query(f"""WITH {SQL_OBSERVATIONS.replace('CASE WHEN p_size < 50 THEN p_type END AS taxonomy_id', 'CAST(l_orderkey % 5000 AS VARCHAR) AS taxonomy_id')}, all_counted AS (SELECT * FROM observations WHERE outcome IN ('signed', 'proposed_then_reversed')),
old AS (WITH counted AS (SELECT * FROM all_counted WHERE version <= 4), {_FACTS} SELECT taxonomy_id AS clause_id, position, historical_stance AS baseline_stance FROM stanced),
new AS (WITH counted AS (SELECT * FROM all_counted WHERE version > 1), {_FACTS} SELECT taxonomy_id AS clause_id, historical_stance AS stance FROM stanced)
SELECT clause_id, position, baseline_stance, CASE WHEN stance <> baseline_stance THEN stance END AS conflict_stance, coalesce(stance <> baseline_stance, false) AS conflict, stance IS NULL AS orphan FROM old LEFT JOIN new USING (clause_id)""")
def curation_merge(spark, sf_dir):
    obs = by_brand(spark, sf_dir)
    old = rollup.rollup(obs.where("version <= 4")).select(F.col("taxonomy_id").alias("clause_id"), "position", F.col("historical_stance").alias("baseline_stance"))
    new = rollup.rollup(obs.where("version > 1")).select(F.col("taxonomy_id").alias("clause_id"), F.col("historical_stance").alias("stance"))
    return integrity.merge_pins(old, new)


@query("SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS observed_at, count(*) AS n FROM lineitem GROUP BY 1")
def quarter_coarsen(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(quarter(F.col("l_shipdate")).alias("observed_at")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS document_id, l_linenumber AS version, CASE WHEN o_orderkey IS NULL THEN 'unknown_document' ELSE 'unknown_version' END AS problem
FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey % 7 AS versions FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_linenumber < 1 OR l_linenumber > versions""")
def citation_antijoin(spark, sf_dir):
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version"))
    corpus = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_id"), F.pmod("o_custkey", F.lit(7)).alias("versions"))
    return integrity.bad_citations(cites, corpus)


_KEY = "sha256('{\"document\":\"' || doc_id || '\",\"stage\":\"scope\"}')"


@query(f"""SELECT {_KEY} AS key, doc_id, quality AS verdict, quality IS NULL AS pending FROM documents LEFT JOIN labels USING (doc_id)""")
def verdict_join_pending(spark, sf_dir):
    key = integrity.payload_key(stage=F.lit("scope"), document=F.col("doc_id"))
    items = table(spark, sf_dir, "documents").select(key.alias("key"), "doc_id")
    log = table(spark, sf_dir, "labels").select(key.alias("key"), F.col("quality").alias("verdict"), F.lit(1).alias("seq"))
    held, pending = integrity.with_verdicts(items, integrity.latest_verdicts(log).select("key", "verdict"))
    return held.withColumn("pending", F.lit(False)).unionByName(pending.select("key", "doc_id", F.lit(None).cast("int").alias("verdict"), F.lit(True).alias("pending")))


@query("""WITH h AS (SELECT o_orderstatus, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders),
leaves AS (SELECT o_orderstatus, substr(h, 1, 3) AS leaf, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL)
SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf || ':' || h)) AS digest FROM leaves GROUP BY 1""")
def canonical_digest(spark, sf_dir):
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")
    return integrity.tree_hash(table(spark, sf_dir, "orders"), row, "o_orderstatus")


@query("""WITH h AS (SELECT sha256(doc_id || '|' || 1 || '|' || sha256(text)) AS h FROM documents),
leaves AS (SELECT substr(h, 1, 3) AS leaf, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL)
SELECT sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf || ':' || h)) AS manifest_hash FROM leaves""")
def manifest_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.sha2("text", 256).alias("sha256"))
    return integrity.manifest_hash(docs)


@query("SELECT DISTINCT p_brand AS id, 'active' AS status FROM part WHERE p_size <= 2 UNION ALL (SELECT DISTINCT p_brand, 'inactive' FROM part ANTI JOIN (SELECT p_brand FROM part WHERE p_size <= 2) USING (p_brand))")
def taxonomy_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    have = part.where("p_size <= 2").select(F.col("p_brand").alias("id")).distinct().withColumn("status", F.lit("active"))
    return integrity.merge_taxonomy(have, part.select(F.col("p_brand").alias("id")).distinct().withColumn("status", F.lit("active")))


@query("SELECT p_brand, array_to_string(list_transform(regexp_extract_all(lower(p_brand), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END), '') AS sort_key, count(*) AS n FROM part GROUP BY ALL")
def natural_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", natural_key(F.col("p_brand")).alias("sort_key"), "n")


@query("SELECT doc_key, count(*) AS n FROM (SELECT n_chars % 1000 AS doc_key FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return integrity.duplicates(table(spark, sf_dir, "documents"), (F.col("n_chars") % 1000).alias("doc_key"))


@query("""WITH m AS (SELECT source AS id FROM documents), a AS (SELECT id, count(*) AS n FROM m GROUP BY 1), b AS (SELECT source AS id, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT id, 'left' AS side FROM (SELECT a.id, unnest(range(greatest(a.n - coalesce(b.n, 0), 0))) FROM a LEFT JOIN b USING (id))""")
def digest_multiset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.col("source").alias("id"))
    return integrity.multiset_difference(a, docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("id")))
