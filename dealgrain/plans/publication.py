"""Queries of publication scans, and ladders over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, redact
from .base import table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _q(p: str) -> str:
    return p.replace("'", "''")


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{_q(p)}')) AS hit FROM documents" for k, p in (("email", redact.EMAIL), ("phone", redact.PHONE), ("url", redact.URL)))


@query(f"SELECT doc_id, kind, hit, count(*) AS n FROM ({_HITS}) GROUP BY ALL")
def contact_hits(spark, sf_dir):
    return redact.hits(table(spark, sf_dir, "documents"), "doc_id", "text")


_STEPS, _X = "", f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{_q(redact.AUDIT)}')), chr(10))"
for _k, (_kind, _p) in enumerate(redact.SPANS):
    _STEPS += f"s{_k} AS (SELECT doc_id, {_X} AS x FROM {f's{_k - 1}' if _k else 'documents'}), "
    if _kind == "token":  # without look-ahead: runs that have a digit, a small and a large letter, the longest first
        _X = "list_reduce([x] || list_sort(list_filter(regexp_extract_all(x, '\\b[A-Za-z0-9_-]{18,}'), lambda t: regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]')), 'DESC'), lambda acc, t: replace(acc, t, '[redacted]'))"
    else:
        _X = f"regexp_replace(x, '{_q(_p)}', '[redacted]', 'g')"


@query(f"WITH {_STEPS.rstrip(', ')} SELECT doc_id, {_X} AS text FROM s{len(redact.SPANS) - 1}")
def scrub_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.scrub(F.col("text")).alias("text"))


@query(f"SELECT doc_id, kind, hit, count(*) AS n FROM (SELECT doc_id, 'institution' AS kind, unnest(regexp_extract_all(text, '{_q(redact.INSTITUTION)}')) AS hit FROM documents UNION ALL SELECT doc_id, 'address', unnest(regexp_extract_all(text, '{_q(redact.STREET)}')) FROM documents UNION ALL SELECT doc_id, 'address', unnest(regexp_extract_all(text, '{_q(redact.BOX)}')) FROM documents) GROUP BY ALL")
def institution_scan(spark, sf_dir):
    return redact.institution_hits(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, kind, hit FROM (SELECT doc_id, kind, hit FROM ({_HITS}) GROUP BY ALL) UNION ALL SELECT doc_id, 'known_name', 'heston' FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' heston ')")
def publish_blockers(spark, sf_dir):
    return redact.publishable(table(spark, sf_dir, "documents"), "doc_id", "text", ["heston"])


@query(f"WITH f AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_q(redact.NAME)}'))) AS name FROM documents) SELECT name, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id))[1:3], ',') AS samples FROM f GROUP BY 1")
def proper_noun_residue(spark, sf_dir):
    return redact.proper_nouns(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("samples", F.array_join("samples", ","))


@query(f"WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(redact.NAME)}')) AS name FROM documents), c AS (SELECT doc_id, name, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS rank FROM c) SELECT doc_id, name, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def party_candidates(spark, sf_dir):
    return redact.party_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")


_NAMES = redact.aliases(["The and", "Than the", "And the", "Que les"])
_FOLD = "text"
for _n in sorted(_NAMES, key=lambda n: (-len(n), n)):
    _FOLD = f"regexp_replace({_FOLD}, '(?i)\\b{'[ \\t\\r\\n]+'.join(_n.split())}\\b', '{_NAMES[_n]}', 'g')"


@query(f"SELECT doc_id, {_FOLD} AS text FROM documents")
def pseudonymize_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.pseudonymize(F.col("text"), _NAMES).alias("text"))


@query("""WITH d AS (SELECT s_suppkey AS supplier, regexp_replace(lower('deal-' || lower(replace(s_name, '#', '-'))), '[^a-z0-9]+', '-', 'g') AS id FROM supplier),
e AS (SELECT s_name AS entity, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier WHERE s_suppkey % 3 = 0),
m AS (SELECT supplier, count(DISTINCT entity) AS n, min(entity) AS entity FROM d JOIN e ON contains('-' || id || '-', '-' || slug || '-') GROUP BY 1)
SELECT d.supplier, CASE WHEN n = 1 THEN m.entity END AS entity FROM d LEFT JOIN m USING (supplier)""")
def counterparty_refs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    docs = s.select(F.concat(F.lit("deal-"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))).alias("document_id"), F.col("s_suppkey").alias("supplier"))
    return redact.entity_in_id(docs, s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("entity"))).select("supplier", "entity")


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(url, '[a-z-]+[.]example[.](?:com|net|org)')) AS site FROM pages) GROUP BY 1")
def site_mentions(spark, sf_dir):
    return redact.hits(table(spark, sf_dir, "pages"), "page_id", "url", (("site", "[a-z-]+[.]example[.](?:com|net|org)"),)).groupBy("page_id").agg(F.sum("n").alias("n"))


_LADDER_ROWS = """VALUES (0, 'IN WITNESS WHEREOF the parties' || chr(10) || 'By: Ann Lee' || chr(10) || 'By: Bob Ray'), (1, 'Signatures' || chr(10) || 'By: Ann Lee'), (2, 'Signatures' || chr(10) || 'By: ____ | By: '),
 (3, 'DocuSign Envelope ID: 01234567-89ab-cdef-0123-456789abcdef'), (4, 'in witness whereof, so'), (5, 'Signatures'), (6, 'executed as a deed' || chr(10) || '/s/ Ann Lee'), (7, 'sent by HelloSign'), (8, '/s/ A /s/ B'), (9, 'nothing here')"""
SQL_SIGNED = f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - k, t FROM ({_LADDER_ROWS}) x(k, t)),
f AS (SELECT doc_id, regexp_matches(text, '{classify.CERTIFICATE}') AS cert, regexp_matches(text, '{classify.PLATFORM}') AS plat, regexp_matches(text, '{classify.HEADING}') AS head, regexp_matches(text, '{classify.TRAILER}') AS trail,
  regexp_extract_all(text, '{classify.BY}', 1) AS bys, len(regexp_extract_all(text, '{classify.SLASH}')) AS slash FROM t),
g AS (SELECT *, len(list_filter(bys, lambda x: regexp_matches(x, '{classify.BLANK}'))) AS blank, len(bys) AS n FROM f),
b AS (SELECT doc_id, CASE WHEN cert THEN 'docusign_certificate' WHEN NOT (head OR trail) AND slash >= 2 THEN 'dual_signatures' WHEN NOT (head OR trail) AND slash = 1 THEN 'electronic_signature' WHEN NOT (head OR trail) AND plat THEN 'electronic_signature'
  WHEN NOT (head OR trail) THEN 'no_signature_section' WHEN n - blank + slash >= 2 THEN 'dual_signatures' WHEN n - blank = 1 THEN 'single_signature' WHEN slash = 1 THEN 'electronic_signature' WHEN blank > 0 THEN 'blank_signature_blocks' WHEN head THEN 'empty_signature_section' ELSE 'unsigned_trailer_reference' END AS basis FROM g)
SELECT doc_id, basis, basis IN ('docusign_certificate', 'dual_signatures', 'electronic_signature', 'single_signature') AS signed FROM b"""


MADE = ["IN WITNESS WHEREOF the parties\nBy: Ann Lee\nBy: Bob Ray", "Signatures\nBy: Ann Lee", "Signatures\nBy: ____ | By: ", "DocuSign Envelope ID: 01234567-89ab-cdef-0123-456789abcdef", "in witness whereof, so", "Signatures", "executed as a deed\n/s/ Ann Lee", "sent by HelloSign", "/s/ A /s/ B", "nothing here"]


@query(SQL_SIGNED)
def signed_ladder(spark, sf_dir):
    """The documents, and ten made-up rows, as no document has a signature section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(MADE)], "doc_id bigint, text string"))
    return classify.signed_status(docs).select("doc_id", "basis", "signed")


_OURS = r"(^|[^\p{L}\p{N}_])(erst|thand)($|[^\p{L}\p{N}_])"


SQL_PROVENANCE = rf"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL VALUES (-1, 'made between erst and other co. rest'), (-2, 'made between other co and thand, inc.')),
p AS (SELECT *, regexp_extract(substr(t, 1, 1000), 'between\s+(.{{1,200}}?)\s+and\s+(.{{1,200}}?)(?:[.,;(]|$)', 1) AS a, regexp_extract(substr(t, 1, 1000), 'between\s+(.{{1,200}}?)\s+and\s+(.{{1,200}}?)(?:[.,;(]|$)', 2) AS b FROM d)
SELECT doc_id, CASE WHEN regexp_matches(a, '{_OURS}') THEN 'our_paper' WHEN regexp_matches(b, '{_OURS}') THEN 'counterparty_paper' WHEN regexp_matches(t, '{_OURS}') THEN 'our_paper' ELSE 'counterparty_paper' END AS provenance,
 CASE WHEN regexp_matches(a, '{_OURS}') THEN 'alias_first_party' WHEN regexp_matches(b, '{_OURS}') THEN 'alias_second_party' WHEN regexp_matches(t, '{_OURS}') THEN 'alias_present' ELSE 'alias_absent' END AS basis FROM p"""


@query(SQL_PROVENANCE)
def provenance_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "Made between Erst and Other Co. Rest"), (-2, "Made between Other Co and Thand, Inc.")], "doc_id bigint, text string"))
    return classify.provenance(docs, ["Erst", "Thand"]).select("doc_id", "provenance", "basis")
