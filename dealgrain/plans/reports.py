"""Reports as Markdown from small aggregates, feedback applied to them, and queries of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_ops import sql_words, words
from ..operators import coverage, intake, integrity, segments
from .base import SQL_LINES, SQL_OBSERVATIONS, checkpoint, lines, observations, table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def markdown(title: str, parts: dict[str, DataFrame], most: int = 200) -> str:
    """A section for each table: its first ``most`` rows by all columns from the left, and how many more there are."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.orderBy(*[c for c, kind in df.dtypes if not kind.startswith("map")]).limit(most + 1).collect()
        more = df.count() - most if len(rows) > most else 0
        rows = rows[:most]
        out += ["", f"## {name}", ""]
        out += [f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns)] + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows] if rows else ["none"]
        if more:
            out += ["", f"{more} more rows are left out."]
    return "\n".join(out) + "\n"


def after_action(mined, verdicts: DataFrame) -> str:
    """What a run did: coverage, backbone, meaning, economics and honesty."""
    trails = mined.order.groupBy("document_id").agg(F.lit(True).alias("ordered")).join(mined.observations.groupBy("document_id").agg(F.bool_or(F.col("outcome") == "signed").alias("signed"), F.count_if(F.col("outcome") == "proposed_then_reversed").alias("reversals")), "document_id", "left")
    return markdown("After action", {
        "Corpus": coverage.corpus(mined.scope, trails, "document_id"), "Backbone": coverage.backbone(trails.fillna({"signed": False, "reversals": 0})), "Meaning": coverage.histograms(mined.observations, "deviation", "provenance", "outcome"),
        "Economics": coverage.judgment_economics(mined.pending, verdicts.withColumn("kind", F.lit("deviation"))), "Honesty": coverage.honesty(mined.observations, "taxonomy_id", "deviation", "basis"), "Quarantine": mined.quarantine,
    })


def apply_feedback(index: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback (item, route, value) on numbered items (item, clause_id): the target of each, or why there is none."""
    both = feedback.join(index, "item", "left")
    known = F.col("route").isin("hint", "verdict", "pin", "floor", "note")
    return both.select("item", "route", "value", "clause_id", F.when(~known, "unknown route").when(F.col("clause_id").isNull(), "unknown item").alias("error"))


@query(f"""WITH {SQL_OBSERVATIONS} SELECT field, count(CASE WHEN v = '' THEN 1 END) AS blank, count(CASE WHEN v = 'needs_review' THEN 1 END) AS needs_review, count(CASE WHEN v NOT IN ('', 'needs_review') THEN 1 END) AS filled
FROM (SELECT 'taxonomy_id' AS field, coalesce(taxonomy_id, '') AS v FROM observations UNION ALL SELECT 'deviation', deviation FROM observations UNION ALL SELECT 'basis', basis FROM observations) GROUP BY field""")
def honesty_audit(spark, sf_dir):
    return coverage.honesty(observations(spark, sf_dir), "taxonomy_id", "deviation", "basis")


@query("""WITH p AS (SELECT source AS kind, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1), v AS (SELECT source AS kind, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT coalesce(p.kind, v.kind) AS kind, coalesce(v.n, 0) AS verdicts, coalesce(p.n, 0) AS pending, coalesce(p.n, 0) * 200 AS estimated_tokens FROM p FULL JOIN v ON p.kind = v.kind""")
def judgment_economics(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind")), table(spark, sf_dir, "labels")
    return coverage.judgment_economics(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id"))


@query(f"""WITH {SQL_OBSERVATIONS}, t AS (SELECT document_id, bool_or(outcome = 'signed') AS signed, count(CASE WHEN outcome = 'proposed_then_reversed' THEN 1 END) AS reversals, count(*) > 1 AS ordered FROM observations GROUP BY 1)
SELECT count(*) AS trails, count(CASE WHEN ordered THEN 1 END) AS ordered, count(CASE WHEN signed THEN 1 END) AS signed, count(CASE WHEN reversals > 0 THEN 1 END) AS with_reversals FROM t""")
def backbone_health(spark, sf_dir):
    t = observations(spark, sf_dir).groupBy("document_id").agg(F.bool_or(F.col("outcome") == "signed").alias("signed"), F.count_if(F.col("outcome") == "proposed_then_reversed").alias("reversals"), (F.count("*") > 1).alias("ordered"))
    return coverage.backbone(t)


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], chr(10)) AS preamble, substr(text, 1, 1000) AS opening FROM documents")
def preamble_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.preamble(F.col("text")).alias("preamble"), segments.opening(F.col("text")).alias("opening"))


_NODES = f"""{SQL_LINES}, blocks AS (SELECT doc_id AS document_id, ord AS block_id FROM lines),
nodes AS (SELECT doc_id AS document_id, ord - CASE WHEN length(line) % 11 = 0 THEN 1 ELSE 0 END AS node_id, CASE WHEN ord % 6 = 1 AND doc_id % 3 = 0 THEN ord + 2 WHEN ord > 1 THEN ord - 1 - CASE WHEN length(line) % 5 = 0 THEN 1000 ELSE 0 END END AS parent_id, ord AS start_block, ord + length(line) % 3 - 1 AS end_block FROM lines)"""


@query(f"""WITH RECURSIVE {_NODES}, n AS (SELECT *, count(*) OVER (PARTITION BY document_id, node_id) AS n FROM nodes), ups AS (SELECT document_id, node_id, min(parent_id) AS up FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL),
reach AS (SELECT document_id, node_id, up FROM ups UNION SELECT r.document_id, r.node_id, u.up FROM reach r JOIN ups u ON u.document_id = r.document_id AND u.node_id = r.up),
loops AS (SELECT DISTINCT document_id, node_id FROM reach WHERE up = node_id), endless AS (SELECT * FROM loops UNION SELECT r.document_id, r.node_id FROM reach r JOIN loops l ON l.document_id = r.document_id AND l.node_id = r.up),
ids AS (SELECT DISTINCT document_id, node_id FROM nodes)
SELECT * FROM (SELECT n.document_id, n.node_id, CASE WHEN n.n > 1 THEN 'duplicate_node' WHEN b2.block_id IS NULL THEN 'unknown_block' WHEN end_block < start_block THEN 'inverted' WHEN e.node_id IS NOT NULL THEN 'cycle' WHEN n.parent_id IS NOT NULL AND ids.node_id IS NULL THEN 'unknown_parent' END AS problem
FROM n LEFT JOIN blocks b2 ON b2.document_id = n.document_id AND b2.block_id = end_block LEFT JOIN ids ON ids.document_id = n.document_id AND ids.node_id = n.parent_id LEFT JOIN endless e ON e.document_id = n.document_id AND e.node_id = n.node_id) WHERE problem IS NOT NULL""")
def grounding_check(spark, sf_dir):
    l = lines(spark, sf_dir)  # noqa: E741
    size = F.length("line")
    nodes = l.select(
        F.col("doc_id").alias("document_id"), (F.col("ord") - F.when(size % 11 == 0, 1).otherwise(0)).alias("node_id"), F.when((F.col("ord") % 6 == 1) & (F.col("doc_id") % 3 == 0), F.col("ord") + 2).when(F.col("ord") > 1, F.col("ord") - 1 - F.when(size % 5 == 0, 1000).otherwise(0)).alias("parent_id"),
        F.col("ord").alias("start_block"), (F.col("ord") + size % 3 - 1).alias("end_block"),
    )
    blocks = l.select(F.col("doc_id").alias("document_id"), F.col("ord").alias("block_id"), "ord")
    return segments.grounding_problems(nodes, blocks, checkpoint)


_FILES = f"""f AS (SELECT doc_id, source, {sql_words("text")} AS w FROM documents WHERE len({sql_words("text")}) > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.doc_id < b.doc_id WHERE len(list_intersect(a.w, b.w)) >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * CASE WHEN a.source = b.source THEN {1 - intake.NEAR_WITH_PARTY} ELSE {1 - intake.NEAR} END - 1e-9),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.root FROM reach r JOIN p ON p.a = r.node OR p.b = r.node)"""


@query(f"WITH RECURSIVE {_FILES}, deal AS (SELECT node, min(root) AS root FROM reach GROUP BY 1) SELECT lpad(CAST(node AS VARCHAR), 8, '0') AS path, lpad(CAST(root AS VARCHAR), 8, '0') AS deal FROM deal")
def intake_deals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.format_string("%08d", "doc_id").alias("path"), words(F.col("text")).alias("words"), F.array("source").alias("parties"))
    return intake.deals(files, checkpoint).select("path", "deal")


@query("""WITH f AS (SELECT o_orderkey AS path, o_custkey AS deal, CASE WHEN o_custkey % 3 > 0 OR o_orderkey % 5 > 0 THEN o_orderdate END AS created FROM orders),
d AS (SELECT *, count(created) OVER (PARTITION BY deal) = count(*) OVER (PARTITION BY deal) AS dated, count(*) OVER (PARTITION BY deal) AS n FROM f)
SELECT deal, CAST(row_number() OVER (PARTITION BY deal ORDER BY CASE WHEN dated THEN created END, path) AS INTEGER) AS ord, path, CASE WHEN n = 1 THEN 0.5 WHEN dated THEN 0.9 ELSE 0.7 END AS confidence FROM d""")
def staging_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    known = (F.col("o_custkey") % 3 > 0) | (F.col("o_orderkey") % 5 > 0)
    files = o.select(F.col("o_orderkey").alias("path"), F.when(known, F.col("o_orderdate")).alias("created"), F.col("o_orderkey").alias("natural_key"))
    return intake.staging_plan(files, o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("deal")))


@query("""WITH l AS (SELECT doc_id AS document_id, source AS file_name FROM documents WHERE doc_id % 4 > 0), o AS (SELECT doc_id AS document_id, source AS file_name, CASE WHEN quality = 1 THEN 'ingested' ELSE 'failed' END AS status FROM documents JOIN labels USING (doc_id))
SELECT coalesce(l.document_id, o.document_id) AS document_id, coalesce(l.file_name, o.file_name) AS file_name, CASE WHEN l.document_id IS NULL THEN 'not_found' ELSE coalesce(status, 'not_ingested') END AS status FROM l FULL JOIN o USING (document_id, file_name)""")
def ingest_outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"))
    done = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "ingested").otherwise("failed").alias("status")), "document_id")
    return intake.ingest_outcomes(docs.where("document_id % 4 > 0"), done)


_SPANS = f"""{SQL_LINES}, s AS (SELECT doc_id AS document_id, ord, start + CASE WHEN ord % 7 = 3 THEN 2 ELSE 0 END AS start, "end" - CASE WHEN ord % 5 = 2 THEN 3 ELSE 0 END AS "end" FROM (
  SELECT doc_id, ord, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS BIGINT) AS "end", raw FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS ord FROM documents)) WHERE trim(raw) <> '')"""


def _spans(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("ord", F.col("pos") + 1)
    run = F.sum(F.length("raw") + 1).over(Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    s = raw.withColumn("end", run - 1).withColumn("start", F.col("end") - F.length("raw")).where(F.trim("raw") != "")
    return s.select("document_id", "ord", (F.col("start") + F.when(F.col("ord") % 7 == 3, 2).otherwise(0)).cast("bigint").alias("start"), (F.col("end") - F.when(F.col("ord") % 5 == 2, 3).otherwise(0)).cast("bigint").alias("end"))


@query(f"""WITH {_SPANS}, w AS (SELECT document_id, start, "end", coalesce(lag("end") OVER (PARTITION BY document_id ORDER BY start, "end"), 0) AS before, row_number() OVER (PARTITION BY document_id ORDER BY start DESC, "end" DESC) = 1 AS is_last FROM s),
j AS (SELECT w.*, substr(text, before + 1, greatest(start - before, 0)) AS gap, CASE WHEN is_last THEN substr(text, "end" + 1) ELSE '' END AS tail FROM w JOIN documents ON doc_id = document_id)
SELECT * FROM (SELECT document_id, start, "end", CASE WHEN start < before THEN 'overlap' WHEN trim(translate(gap, chr(10) || chr(9) || chr(13), '   ')) <> '' THEN 'gap' WHEN trim(translate(tail, chr(10) || chr(9) || chr(13), '   ')) <> '' THEN 'tail' END AS problem FROM j) WHERE problem IS NOT NULL""")
def uncovered_text(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return segments.uncovered_text(_spans(spark, sf_dir).drop("ord"), texts)


@query(f"""WITH {SQL_LINES}, kept AS (SELECT doc_id, ord, line FROM lines WHERE NOT (doc_id % 9 = 0 AND ord = 2)), made AS (SELECT doc_id, string_agg(line, '' ORDER BY ord) AS made FROM kept GROUP BY 1)
SELECT d.doc_id AS document_id FROM documents d LEFT JOIN made USING (doc_id) WHERE translate(coalesce(made, ''), ' ' || chr(10) || chr(9) || chr(13), '') <> translate(text, ' ' || chr(10) || chr(9) || chr(13), '')""")
def unfaithful_documents(spark, sf_dir):
    nodes = lines(spark, sf_dir).where("not (doc_id % 9 = 0 and ord = 2)").select(F.col("doc_id").alias("document_id"), "ord", F.col("line").alias("text"))
    return segments.unfaithful(nodes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("SELECT doc_id, source AS taxonomy_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 100 < 5)")
def unknown_taxonomy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("taxonomy_id"))
    known = d.where("doc_id % 100 < 5").select(F.col("taxonomy_id").alias("id")).distinct()
    return segments.unknown_taxonomy(d, known).select("doc_id", "taxonomy_id")


@query(f"""WITH {_SPANS} SELECT document_id, ord, substr(text, start + 1, "end" - start) AS cited FROM s JOIN documents ON doc_id = document_id WHERE "end" > start""")
def resolved_spans(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return _spans(spark, sf_dir).where("end > start").join(texts, "document_id").select("document_id", "ord", segments.resolve_span(F.col("text"), F.col("start"), F.col("end")).alias("cited"))


@query("SELECT conv_id AS document_id, role AS version, min_by(text, turn) AS letterhead FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def letterheads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("role").alias("version"), F.col("turn").alias("ord"), F.col("text").alias("heading"))
    return segments.letterheads(c)


@query("""WITH c AS (SELECT l_orderkey AS document_id, l_linenumber AS version FROM lineitem), v AS (SELECT o_orderkey AS document_id, 1 AS version, sha256(o_orderpriority || o_orderkey % 50) AS sha FROM orders WHERE o_orderkey % 3 > 0), f AS (SELECT sha256(o_orderpriority || o_orderkey % 50) AS sha, min(o_custkey) AS path FROM orders WHERE o_orderkey % 50 < 40 GROUP BY 1)
SELECT c.document_id, c.version, f.path, CASE WHEN v.sha IS NULL THEN 'unaddressable' WHEN f.path IS NULL THEN 'not_found' END AS problem FROM c LEFT JOIN v USING (document_id, version) LEFT JOIN f ON f.sha = v.sha""")
def citation_files(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version"))
    o = table(spark, sf_dir, "orders").withColumn("sha256", F.sha2(F.concat("o_orderpriority", (F.col("o_orderkey") % 50).cast("string")), 256))
    held = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("version"), "sha256")
    return integrity.resolve_citations(cited, held, o.where("o_orderkey % 50 < 40").select("sha256", F.col("o_custkey").alias("path"))).select("document_id", "version", "path", "problem")


@query("""WITH i AS (SELECT doc_id AS ord, CASE WHEN quality = 0 THEN ['junk'] ELSE [] END || CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS reasons FROM labels)
SELECT ord, array_to_string(reasons, ',') AS reasons, row_number() OVER (ORDER BY CASE WHEN len(reasons) > 0 THEN 0 ELSE 1 END, ord) AS item FROM i""")
def attention_order(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "junk"), F.when(F.col("toxic") == 1, "toxic")))
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), reasons.alias("reasons"))
    return coverage.attention(items, checkpoint).select("ord", F.array_join("reasons", ",").alias("reasons"), "item")
