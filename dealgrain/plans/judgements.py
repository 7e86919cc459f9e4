"""Queries of verdict tables: what rules leave in doubt, what a verdict decides, and what stays pending."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_ops import sql_normalize
from ..operators import classify, coverage, judges, redact, rollup, segments
from ..operators.integrity import payload_key
from .base import SQL_COUNTED, SQL_LINES, SQL_OBSERVATIONS, lines, observations, table
from .positions import SQL_SMALL, by_brand
from .publication import MADE, SQL_PROVENANCE, SQL_SIGNED
from .reports import apply_feedback

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_PREAMBLE = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], chr(10))"


@query(SQL_PROVENANCE.replace("FROM p", "FROM p JOIN documents USING (doc_id)").replace("SELECT doc_id, CASE", f", r AS (SELECT doc_id, {_PREAMBLE} AS preamble, CASE", 1) + f"""),
v AS (SELECT {_PREAMBLE} AS preamble, CASE WHEN max(quality) = 1 THEN 'our_paper' ELSE 'counterparty_paper' END AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN basis <> 'alias_first_party' THEN coalesce(verdict, provenance) ELSE provenance END AS provenance, CASE WHEN basis <> 'alias_first_party' AND verdict IS NOT NULL THEN 'judge' ELSE basis END AS basis FROM r LEFT JOIN v USING (preamble)""")
def provenance_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = classify.provenance(docs, ["Erst", "Thand"]).select("doc_id", "provenance", "basis", "confidence", segments.preamble(F.col("text")).alias("preamble"), F.lit("").alias("letterhead"))
    key = payload_key(stage=F.lit("provenance"), preamble=F.col("preamble"), letterhead=F.lit(""), agreement_type=F.lit("msa"))
    told = ruled.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(key.alias("key")).agg(F.max("quality").alias("q"))
    verdicts = told.select("key", F.when(F.col("q") == 1, "our_paper").otherwise("counterparty_paper").alias("provenance"), F.lit(0.9).alias("confidence"))
    return judges.provenance(ruled, verdicts, "msa")[0].select("doc_id", "provenance", "basis")


@query(f"""WITH ruled AS ({SQL_SIGNED}) SELECT doc_id, CASE WHEN basis IN ('electronic_signature', 'empty_signature_section') AND doc_id % 2 = 0 THEN false ELSE signed END AS signed,
CASE WHEN basis IN ('electronic_signature', 'empty_signature_section') AND doc_id % 2 = 0 THEN 'judge' ELSE basis END AS basis FROM ruled WHERE doc_id < 0""")
def signed_verdicts(spark, sf_dir):
    """The made-up rows alone, as the documents have no signature section."""
    docs = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(MADE)], "doc_id bigint, text string")
    ruled = classify.signed_status(docs).withColumn("section", F.col("text"))
    verdicts = docs.where("doc_id % 2 = 0").select(payload_key(stage=F.lit("signed"), section=F.col("text")).alias("key"), F.lit(False).alias("signed"), F.lit(0.9).alias("confidence"))
    return judges.signed(ruled, verdicts)[0].select("doc_id", "signed", "basis")


@query(f"""WITH {SQL_LINES}, n AS (SELECT doc_id, source, count(line) AS n FROM documents LEFT JOIN lines USING (doc_id) GROUP BY ALL)
SELECT doc_id, CASE WHEN n < 2 THEN false WHEN length(source) % 2 = 0 THEN false ELSE true END AS in_scope, CASE WHEN n = 0 THEN 'empty' WHEN n < 2 THEN 'too_short' WHEN length(source) % 2 = 0 THEN 'judge' ELSE 'judge_failed' END AS basis FROM n""")
def scope_verdicts(spark, sf_dir):
    """Documents judged by their source, which stands for the headings of their clauses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("clause_heads"))
    counted = docs.join(lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_clauses")), "doc_id", "left").fillna({"n_clauses": 0}).withColumn("verdict", F.lit(None).cast("boolean"))
    heads = docs.select("clause_heads").distinct().where(F.length("clause_heads") % 2 == 0)
    verdicts = heads.select(payload_key(stage=F.lit("scope"), clause_heads=F.col("clause_heads")).alias("key"), F.lit(False).alias("in_scope"), F.lit(0.9).alias("confidence"))
    return judges.scope(coverage.scope_ladder(counted), verdicts)[0].select("doc_id", "in_scope", "basis")


@query("""WITH o AS (SELECT o_custkey AS document_id, o_orderkey AS version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS up, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS down, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
j AS (SELECT *, (document_id % 3 = 0 OR document_id % 5 = 0) AND document_id % 2 = 0 AND (document_id % 7 <> 0) AS judged FROM o)
SELECT document_id, version, CASE WHEN judged THEN down ELSE up END AS version_ord, CASE WHEN judged THEN 'judge' WHEN document_id % 5 = 0 THEN 'greedy' ELSE 'exhaustive' END AS basis FROM j""")
def trail_verdicts(spark, sf_dir):
    """Orders of a customer turned round by verdicts; of every seventh customer the verdict leaves one out and is void."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"))
    order = o.withColumn("version_ord", F.row_number().over(Window.partitionBy("document_id").orderBy("version"))).withColumn("shape", F.when(F.col("document_id") % 3 == 0, "gap").otherwise("linear")).withColumn("basis", F.when(F.col("document_id") % 5 == 0, "greedy").otherwise("exhaustive"))
    all_ = o.where("document_id % 2 = 0").groupBy("document_id").agg(F.array_sort(F.collect_list("version")).alias("v"))
    key = payload_key(stage=F.lit("trail"), document=F.col("document_id"), versions=F.array_join(F.transform("v", lambda x: x.cast("string")), ","))
    told = F.when(F.col("document_id") % 7 == 0, F.slice(F.reverse("v"), F.lit(2), F.size("v"))).otherwise(F.reverse("v"))
    return judges.trail(order, all_.select(key.alias("key"), told.alias("versions")))[0].select("document_id", "version", "version_ord", "basis")


@query("""WITH c AS (SELECT l_orderkey AS document_id, l_returnflag AS taxonomy_id, l_linenumber AS node, l_discount * 10 AS confidence, CASE WHEN l_quantity < 5 THEN 'own_row' WHEN l_quantity < 30 THEN 'similarity' ELSE 'position' END AS match_basis FROM lineitem),
d AS (SELECT *, bool_or(match_basis = 'own_row' OR (match_basis = 'similarity' AND confidence < 0.5)) OVER (PARTITION BY document_id, taxonomy_id) AS doubt FROM c)
SELECT document_id, node, CAST(CASE WHEN doubt AND document_id % 4 = 0 AND node % 2 = 1 THEN node + 100 ELSE node END AS BIGINT) AS alignment, CASE WHEN doubt AND document_id % 4 = 0 AND node % 2 = 1 THEN 'judge' ELSE match_basis END AS match_basis FROM d""")
def alignment_verdicts(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("taxonomy_id"), F.col("l_linenumber").cast("bigint").alias("node"), F.col("l_linenumber").cast("bigint").alias("alignment"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(F.col("l_quantity") < 5, "own_row").when(F.col("l_quantity") < 30, "similarity").otherwise("position").alias("match_basis"),
    )
    key = payload_key(stage=F.lit("alignment"), document=F.col("document_id"), taxonomy=F.col("taxonomy_id"))
    verdicts = item.where("document_id % 4 = 0 and node % 2 = 1").select(key.alias("key"), "node", (F.col("node") + 100).alias("to")).distinct()
    return judges.alignment(item, verdicts)[0].select("document_id", "node", "alignment", "match_basis")


@query(SQL_SMALL + """SELECT taxonomy_id, position, 'review' AS flag FROM stanced WHERE position = 'negotiable' AND n_fallbacks > 0 AND 2 * CASE WHEN n_our_paper > 0 THEN held_ours ELSE held_all END > CASE WHEN n_our_paper > 0 THEN n_our_paper ELSE n_observations END AND CAST(taxonomy_id AS INTEGER) % 2 = 0""")
def coherence_verdicts(spark, sf_dir):
    p = rollup.rollup(by_brand(spark, sf_dir))
    key = payload_key(stage=F.lit("coherence"), taxonomy=F.col("taxonomy_id"), position=F.col("position"), n_our_paper=F.col("n_our_paper").cast("string"))
    verdicts = p.where(F.col("taxonomy_id").cast("int") % 2 == 0).select(key.alias("key"), F.lit("review").alias("flag"))
    return judges.coherence(p, verdicts)[0]


@query("""WITH c AS (SELECT p_partkey AS candidate_id, p_type AS taxonomy_id FROM part), i AS (SELECT DISTINCT p_type AS taxonomy_id FROM part WHERE p_partkey <= 2), v AS (SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS told FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 3 > 0)
SELECT candidate_id, taxonomy_id, CASE WHEN taxonomy_id IN (SELECT taxonomy_id FROM i) THEN 'signed' ELSE coalesce(told, 'pending') END AS decision FROM c LEFT JOIN v USING (candidate_id)""")
def floor_decisions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("taxonomy_id"))
    by = F.when(F.col("candidate_id") % 3 == 0, "interview").otherwise("person")
    verdicts = part.where("candidate_id % 7 = 0").select("candidate_id", F.when(F.col("candidate_id") % 2 == 0, "rejected").otherwise("accepted").alias("decision"), by.alias("by"))
    return judges.floor(part, verdicts, part.where("candidate_id <= 2"))


@query(f"""WITH {SQL_OBSERVATIONS}, {SQL_COUNTED}, e AS (SELECT taxonomy_id, provenance AS if_text, full_text AS to_text, document_id % 4 + 1 AS n1, magnitude = 'material' AND ord % 97 = 0 AS material, ord, {sql_normalize("provenance || ' ' || full_text")} AS form FROM counted),
g AS (SELECT taxonomy_id, form, CAST(sum(n1) AS BIGINT) AS n, bool_or(material) AS material, min(ord) AS first_seen, arg_min(to_text, (-n1, ord)) AS to_text FROM e GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY taxonomy_id ORDER BY n DESC, first_seen) AS INTEGER) AS rank FROM g)
SELECT taxonomy_id, to_text, n, material, rank, CASE WHEN n >= 10 THEN 'often' WHEN n >= 2 THEN 'sometimes' ELSE 'rare' END AS band FROM r WHERE rank <= 5 OR material""")
def preferred_variations(spark, sf_dir):
    e = rollup.counted(observations(spark, sf_dir)).select("taxonomy_id", F.col("provenance").alias("if_text"), F.col("full_text").alias("to_text"), (F.col("document_id") % 4 + 1).alias("precedent_count"), ((F.col("magnitude") == "material") & (F.col("ord") % 97 == 0)).alias("material"), "ord")
    return rollup.preferred_variations(e).select("taxonomy_id", "to_text", "n", "material", "rank", "band")


@query("""WITH f AS (SELECT doc_id AS item, CASE doc_id % 5 WHEN 0 THEN 'pin' WHEN 1 THEN 'hint' WHEN 2 THEN 'dance' ELSE 'note' END AS route FROM labels), i AS (SELECT doc_id AS item, source AS clause_id FROM documents WHERE doc_id % 3 > 0)
SELECT item, route, clause_id, CASE WHEN route = 'dance' THEN 'unknown route' WHEN clause_id IS NULL THEN 'unknown item' END AS error FROM f LEFT JOIN i USING (item)""")
def feedback_targets(spark, sf_dir):
    route = F.when(F.col("doc_id") % 5 == 0, "pin").when(F.col("doc_id") % 5 == 1, "hint").when(F.col("doc_id") % 5 == 2, "dance").otherwise("note")
    feedback = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), route.alias("route"), F.lit("x").alias("value"))
    index = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("item"), F.col("source").alias("clause_id"))
    return apply_feedback(index, feedback).drop("value")


_ENTITIES = ("ththan", "therha inhe", "heston")
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name FROM w WHERE contains(plain, ' {n} ')" + (f" OR contains(replace(plain, ' ', ''), '{n.replace(' ', '')}')" if len(n.replace(" ", "")) >= 8 else "") for n in _ENTITIES)


@query(f"WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS plain FROM documents) SELECT DISTINCT doc_id, name FROM ({_FOUND})")
def known_entity_hits(spark, sf_dir):
    return redact.known_names(table(spark, sf_dir, "documents"), "doc_id", "text", list(_ENTITIES))


@query("""WITH f AS (SELECT doc_id, quality AS files, toxic AS failed, doc_id % 4 AS clauses FROM labels)
SELECT doc_id AS document_id, CASE WHEN files = 0 THEN 'no_files' WHEN failed >= files THEN 'all_failed' ELSE 'no_text' END AS reason FROM f WHERE clauses = 0""")
def zero_clause_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("files"), F.col("toxic").alias("failed"), (F.col("doc_id") % 4).alias("clauses"))
    return coverage.zero_clauses(docs)
