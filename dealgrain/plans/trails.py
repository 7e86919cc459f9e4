"""Queries over trails of versions, made from groups of near copies among the documents, and over lines and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_ops import normalize, snippet, sql_jaccard, sql_normalize, sql_words, words
from ..operators import integrity, segments, similarity, versions
from ..operators.graph import connected_components
from .base import SQL_LINES, checkpoint, lines, table

Q, S = {}, {}
SIMILAR = 0.8


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), words(F.col("text")).alias("words"))


def _clusters(spark, sf_dir):
    return connected_components(similarity.similar_links(_sets(spark, sf_dir), SIMILAR, checkpoint=checkpoint), checkpoint)


def versions_of(spark, sf_dir):
    """(document_id, version, version_ord, text, signed)."""
    found = _clusters(spark, sf_dir)
    docs = similarity.likely(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", found.select("node"))
    order = Window.partitionBy("root").orderBy("node")
    v = found.join(docs, found.node == docs.doc_id).select(F.col("root").alias("document_id"), F.col("node").alias("version"), F.row_number().over(order).alias("version_ord"), "text")
    return v.withColumn("signed", F.col("version") == F.max("version").over(Window.partitionBy("document_id")))


def clauses_of(spark, sf_dir):
    """(document_id, version_ord, ord, alignment, text): a non-blank line is a clause, aligned by its number."""
    v = versions_of(spark, sf_dir).select("document_id", "version_ord", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "text"))
    return checkpoint(v.select("document_id", "version_ord", (F.col("pos") + 1).alias("ord"), (F.col("pos") + 1).alias("alignment"), "text"))


SQL_TRAILS = f"""sets AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
counted_sets AS (SELECT *, len(w) AS n FROM sets WHERE len(w) > 0),
pairs AS (SELECT a, b, shared / (na + nb - shared) AS similarity FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.w, b.w))::DOUBLE AS shared
  FROM counted_sets a JOIN counted_sets b ON a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n) WHERE shared / (na + nb - shared) >= 0.8),
reach AS (SELECT a AS node, a AS root FROM pairs UNION SELECT b, b FROM pairs UNION
  SELECT CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.root FROM reach r JOIN pairs p ON p.a = r.node OR p.b = r.node),
clusters AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
versions AS (SELECT root AS document_id, node AS version, CAST(row_number() OVER (PARTITION BY root ORDER BY node) AS INTEGER) AS version_ord, text FROM clusters JOIN documents ON doc_id = node),
clauses AS (SELECT document_id, version_ord, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS INTEGER) AS alignment
  FROM (SELECT document_id, version_ord, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM versions))"""
_T = f"WITH RECURSIVE {SQL_TRAILS} "
_DIFF = """, tops AS (SELECT document_id, max(version_ord) AS last FROM versions GROUP BY 1),
diffs AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.alignment, b.alignment) AS alignment, coalesce(a.version_ord, b.version_ord - 1) AS round, a.text AS before, b.text AS after,
  CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'modified' END AS kind
  FROM (SELECT c.* FROM clauses c JOIN tops USING (document_id) WHERE version_ord < last) a FULL JOIN (SELECT * FROM clauses WHERE version_ord > 1) b ON a.document_id = b.document_id AND a.alignment = b.alignment AND b.version_ord = a.version_ord + 1) """


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, line FROM lines")
def lines_explode(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS BIGINT) AS \"end\" FROM lines")
def block_spans(spark, sf_dir):
    return segments.block_spans(lines(spark, sf_dir), "doc_id", "ord", "line").select("doc_id", "ord", "start", "end")


@query(f"""WITH {SQL_LINES}, spans AS (SELECT doc_id, ord, ord * 10 AS start, ord * 10 + length(line) % 13 AS "end" FROM lines),
g AS (SELECT *, start - lag("end") OVER (PARTITION BY doc_id ORDER BY ord) AS gap FROM spans)
SELECT doc_id, ord, gap, CASE WHEN gap < 0 THEN 'overlap' ELSE 'gap' END AS problem FROM g WHERE gap < 0 OR gap > 1""")
def span_gap_check(spark, sf_dir):
    spans = lines(spark, sf_dir).select("doc_id", "ord", (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + F.length("line") % 13).alias("end"))
    return integrity.span_problems(spans, "doc_id", "ord").select("doc_id", "ord", "gap", "problem")


_CAPS = "regexp_matches(line, '[A-Z]') AND upper(line) = line AND len(string_split(line, ' ')) <= 8 AND NOT regexp_matches(line, '[^ -~]') AND NOT line LIKE '%.'"


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, line FROM lines WHERE {_CAPS}")
def allcaps_headings(spark, sf_dir):
    return lines(spark, sf_dir).where(segments.capitals(F.col("line")))


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS heading, CAST(count(CASE WHEN length(line) < 60 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS clause_no FROM lines")
def heading_owner(spark, sf_dir):
    head = F.when(F.length("line") < 60, F.col("line"))
    return segments.owned(lines(spark, sf_dir), head, "doc_id").select("doc_id", "ord", "heading", "clause_no")


@query(f"SELECT page_id, CAST(ord AS INTEGER) AS ord, tag, text FROM (SELECT page_id, unnest(regexp_extract_all(html, '{segments.ELEMENT}', 1)) AS tag, unnest(regexp_extract_all(html, '{segments.ELEMENT}', 2)) AS text, generate_subscripts(regexp_extract_all(html, '{segments.ELEMENT}', 1), 1) AS ord FROM pages)")
def html_clause_tree(spark, sf_dir):
    return segments.html_blocks(table(spark, sf_dir, "pages"), "page_id")


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, count(*) OVER (PARTITION BY norm) AS precedent_count FROM (SELECT *, {sql_normalize('line')} AS norm FROM lines) WHERE norm <> ''")
def exact_line_dedup(spark, sf_dir):
    keyed = lines(spark, sf_dir).withColumn("norm", normalize(F.col("line"))).where("norm <> ''")
    return keyed.select("doc_id", "ord", F.count("*").over(Window.partitionBy("norm")).alias("precedent_count"))


@query(f"SELECT min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, {sql_normalize('text')} AS norm FROM documents) GROUP BY norm HAVING count(*) > 1")
def doc_exact_dupes(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("norm"))
    twice = integrity.duplicates(norm, "norm")
    return norm.join(twice, "norm").groupBy("norm", "n").agg(F.min("doc_id").alias("first_doc")).select("first_doc", "n")


@query(f"WITH RECURSIVE {SQL_TRAILS.split('reach AS')[0].rstrip().rstrip(',')} SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def jaccard_pairs(spark, sf_dir):
    return similarity.similar_pairs(_sets(spark, sf_dir), SIMILAR, checkpoint=checkpoint).withColumn("similarity", F.round("similarity", 9))


_BENCH = f"b AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark)"


@query(f"WITH {_BENCH} SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w))::DOUBLE / least(len(x.w), len(y.w)), 9) AS overlap FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) > 0")
def overlap_coeff_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("words"))
    return similarity.overlaps(b, "item_id", "words").select("a", "b", F.round("similarity", 9).alias("overlap"))


@query(f"""WITH {_BENCH}, d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents ),
s AS (SELECT doc_id, item_id, {sql_jaccard('d.w', 'b.w')} AS similarity FROM d, b WHERE len(list_intersect(d.w, b.w)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS turn FROM s)
SELECT doc_id, item_id, round(similarity, 9) AS similarity, CASE WHEN similarity >= 0.85 THEN 'auto' WHEN similarity < 0.70 THEN 'unclassified' ELSE 'judge' END AS band FROM r WHERE turn = 1""")
def standard_match(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words"))
    refs = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("ref_words"), F.col("item_id").alias("order"))
    best = similarity.best_match(items, refs, "doc_id", "item_id", "order")
    return best.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), F.when(F.col("similarity") >= 0.85, "auto").when(F.col("similarity") < 0.70, "unclassified").otherwise("judge").alias("band"))


@query(_T + f"""SELECT a.document_id, a.version_ord, a.alignment AS i, b.alignment AS j FROM
  (SELECT *, {sql_normalize('text')} AS norm, row_number() OVER (PARTITION BY document_id, version_ord, {sql_normalize('text')} ORDER BY alignment) AS k FROM clauses) a JOIN
  (SELECT *, {sql_normalize('text')} AS norm, row_number() OVER (PARTITION BY document_id, version_ord, {sql_normalize('text')} ORDER BY alignment) AS k FROM clauses) b
  ON a.document_id = b.document_id AND b.version_ord = a.version_ord + 1 AND a.norm = b.norm AND a.k = b.k WHERE length(a.norm) >= 30""")
def move_exact_match(spark, sf_dir):
    return versions.exact_moves(clauses_of(spark, sf_dir))


@query()
def move_greedy_match(spark, sf_dir):
    return versions.moves(clauses_of(spark, sf_dir), checkpoint)


@query()
def aligned_chains(spark, sf_dir):
    c = clauses_of(spark, sf_dir).drop("alignment")
    return versions.chains(versions.moves(c, checkpoint), c, checkpoint)


@query(_T + _DIFF + "SELECT document_id, alignment, round, before, after, kind FROM diffs")
def consecutive_diff(spark, sf_dir):
    return versions.consecutive_diff(clauses_of(spark, sf_dir))


@query(_T + """, ends AS (SELECT document_id, min(version_ord) AS low, max(version_ord) AS high FROM versions GROUP BY 1),
a AS (SELECT c.* FROM clauses c JOIN ends USING (document_id) WHERE version_ord = low), b AS (SELECT c.* FROM clauses c JOIN ends USING (document_id) WHERE version_ord = high)
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.alignment, b.alignment) AS alignment, a.text AS before, b.text AS after,
  CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.document_id = b.document_id AND a.alignment = b.alignment""")
def net_diff(spark, sf_dir):
    return versions.net_diff(clauses_of(spark, sf_dir))


@query()
def word_hunks(spark, sf_dir):
    diffs = versions.with_hunks(versions.consecutive_diff(clauses_of(spark, sf_dir)))
    return diffs.where("kind = 'modified'").select("document_id", "alignment", "round", F.posexplode("hunks").alias("hunk", "x")).select("document_id", "alignment", "round", "hunk", "x.kind", "x.old_text", "x.new_text")


@query()
def reversals(spark, sf_dir):
    c = clauses_of(spark, sf_dir)
    return versions.reversals(versions.with_hunks(versions.consecutive_diff(c)), c)


@query(_T + _DIFF + f""", signed AS (SELECT document_id, alignment, {sql_words('text')} AS w FROM clauses JOIN tops USING (document_id) WHERE version_ord = last),
n AS (SELECT document_id, alignment, round, list_filter({sql_words('after')}, lambda x: NOT list_contains({sql_words('before')}, x)) AS new FROM diffs WHERE kind IN ('added', 'modified'))
SELECT document_id, alignment, round, CAST(len(list_filter(new, lambda x: NOT list_contains(coalesce(w, []), x))) AS INTEGER) AS lost FROM n LEFT JOIN signed USING (document_id, alignment) WHERE len(list_filter(new, lambda x: NOT list_contains(coalesce(w, []), x))) > 0""")
def reversals_set_form(spark, sf_dir):
    c = clauses_of(spark, sf_dir)
    return versions.set_reversals(versions.consecutive_diff(c), c)


@query(_T + _DIFF + "SELECT document_id, round, alignment, kind, CAST(row_number() OVER (PARTITION BY document_id, round ORDER BY alignment) AS INTEGER) AS move, substr(kind || ': ' || CASE kind WHEN 'removed' THEN before ELSE after END, 1, 200) AS change_summary FROM diffs WHERE kind <> 'unchanged'")
def round_moves(spark, sf_dir):
    return versions.round_moves(versions.consecutive_diff(clauses_of(spark, sf_dir)))


@query("SELECT conv_id, turn, 'obs-' || conv_id || '-' || role || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS observation_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)")
def obs_id_suffix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("base", F.concat(F.lit("obs-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("role")))
    return versions.numbered(c, "base", "turn").select("conv_id", "turn", "observation_id")


@query("""WITH l AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents), h AS (SELECT *, substr(line, 1, 100) AS head FROM l)
SELECT doc_id, CASE WHEN length(line) <= 100 THEN line WHEN contains(head, ' ') THEN rtrim(substr(head, 1, 100 - instr(reverse(head), ' ')), ' ') ELSE rtrim(head, ' ') END AS snippet FROM h""")
def search_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@query(_T + "SELECT node, root FROM clusters")
def deal_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH {_BENCH}, s AS (SELECT x.item_id, y.item_id AS other, 1 - ({sql_jaccard('x.w', 'y.w')}) AS distance FROM b x JOIN b y ON x.item_id <> y.item_id WHERE len(list_intersect(x.w, y.w)) > 0) SELECT item_id, round(min(distance), 9) AS distance FROM s GROUP BY 1")
def nearest_doc(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("words"))
    return similarity.nearest(b, "item_id", "words", checkpoint=checkpoint).select("item_id", F.round(1 - F.col("similarity"), 9).alias("distance"))


@query()
def pairwise_line_distance(spark, sf_dir):
    return versions.pairwise_distances(versions_of(spark, sf_dir).select("document_id", "version", "text"))


@query()
def chain_order(spark, sf_dir):
    return versions.order_versions(versions_of(spark, sf_dir).select("document_id", "version", "text", "signed"))


@query("""WITH g AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) % 1000000 / 2400000.0::DOUBLE AS step FROM events), s AS (SELECT user_id, list_sort(list(step)) AS s FROM g WHERE step IS NOT NULL GROUP BY 1)
SELECT user_id, s[-1] AS largest, s[len(s) // 2 + 1] AS upper_median, CASE WHEN s[-1] > 0.4 THEN 'gap' WHEN len(s) > 1 AND s[len(s) // 2 + 1] > 0 AND s[-1] >= 2 * s[len(s) // 2 + 1] AND s[-1] <> s[len(s) // 2 + 1] THEN 'fork' ELSE 'linear' END AS shape FROM s""")
def chain_shape(spark, sf_dir):
    g = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return versions.shapes(g.select("user_id", (gap % 1000000 / F.lit(2400000.0)).alias("step")), "user_id")


@query("SELECT o_custkey AS document_id, o_orderkey AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice END, o_orderkey DESC) AS turn FROM orders) WHERE turn = 1")
def representative_version(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("signed"), F.col("o_totalprice").alias("confidence"), F.col("o_orderkey").alias("natural_key"))
    return versions.representative(v).select("document_id", "version")


@query()
def hunk_attribution(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id"), F.col("event_type").alias("clause_path"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.col("value").cast("bigint")).alias("end"), F.when(F.col("event_id") % 2 == 0, "insert").otherwise("delete").alias("kind"), F.concat_ws(" ", "event_type", "props").alias("text"))
    hunks = e.where("event_id % 3 = 0").withColumnRenamed("event_id", "hunk")
    changes = e.where("event_id % 3 = 1").withColumnRenamed("event_id", "change").withColumn("author", F.col("clause_path"))
    return versions.attribute_hunks(hunks, changes, checkpoint)


@query()
def taxonomy_induction(spark, sf_dir):
    from ..operators.classify import induce

    heads = html_clause_tree(spark, sf_dir).where("tag in ('title', 'li')").select(F.col("page_id").alias("document_id"), F.col("text").alias("heading"))
    return induce(heads, checkpoint)
