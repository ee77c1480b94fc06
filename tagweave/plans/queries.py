"""Queries over the driver's tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cite, tags
from ..functions.pairwise import Texts
from ..operators import analyze, counts, dedup
from ..operators.components import components
from ..sources import reader, ris, writers
from . import adapters
from .storage import fresh_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_DOC = """WITH d AS (SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY text) AS duplicate_id FROM documents),
raw AS (SELECT 'search-' || doc_id AS record_id, duplicate_id, source AS cite_source, 'search' AS cite_label, lang AS cite_string FROM d
  UNION ALL SELECT 'screened-' || doc_id, duplicate_id, NULL, 'screened', lang FROM d JOIN labels USING (doc_id)
  UNION ALL SELECT 'final-' || doc_id, duplicate_id, NULL, 'final', lang FROM d JOIN labels USING (doc_id) WHERE quality = 1),
"""
_PART = """WITH raw AS (SELECT l_orderkey || '-' || l_linenumber AS record_id, l_partkey AS duplicate_id, n_name AS cite_source,
    CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'search' ELSE 'screened' END AS cite_label, l_returnflag AS cite_string
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
"""
_UNI = """uni AS (SELECT duplicate_id, string_agg(record_id, ', ' ORDER BY record_id) AS record_ids,
    coalesce(string_agg(cite_source, ', ' ORDER BY record_id, cite_source), '') AS cite_source, coalesce(string_agg(cite_label, ', ' ORDER BY record_id, cite_label), '') AS cite_label,
    coalesce(string_agg(cite_string, ', ' ORDER BY record_id, cite_string), '') AS cite_string FROM raw GROUP BY duplicate_id),
src AS (SELECT DISTINCT duplicate_id, cite_source AS s FROM raw WHERE cite_source IS NOT NULL),
lab AS (SELECT DISTINCT duplicate_id, cite_label AS l FROM raw),
alone AS (SELECT duplicate_id, count(*) = 1 AS u FROM src GROUP BY duplicate_id),
long AS (SELECT DISTINCT a.duplicate_id, a.s AS cite_source, b.l AS cite_label, c.cite_string, record_ids, u AS "unique", CASE WHEN u THEN 'unique' ELSE 'duplicated' END AS type
  FROM src a JOIN lab b USING (duplicate_id) JOIN (SELECT DISTINCT duplicate_id, cite_string FROM raw) c USING (duplicate_id) JOIN uni USING (duplicate_id) JOIN alone USING (duplicate_id))
"""
_PCT = "printf('%.1f', round({0} * 100, 1)) || '%'"


def _add(name: str, sql: str | None = None, base: str = _DOC + _UNI) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = base + sql
        return f

    return add


def _simple(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, part: bool = False) -> None:
    unique = adapters.part_unique if part else adapters.doc_unique
    _add(name, sql, (_PART if part else _DOC) + _UNI)(lambda spark, sf: f(unique(spark, sf)))


# imports and merges
_add("raw_union", "SELECT * FROM raw")(adapters.doc_citations)
_add("exact_dedup_merge", "SELECT duplicate_id, record_ids, cite_source, cite_label, cite_string FROM uni")(adapters.doc_unique)
_add("part_dedup_merge", "SELECT duplicate_id, record_ids, cite_source, cite_label, cite_string FROM uni", _PART + _UNI)(adapters.part_unique)
_add("import_summary", "SELECT cite_source, count(*) AS records FROM raw GROUP BY 1")(lambda s, d: counts.import_summary(adapters.doc_citations(s, d)))

# who found what
_simple("count_unique", analyze.count_unique, "SELECT * FROM long")
_simple("count_unique_part", lambda u: analyze.count_unique(u).groupBy("cite_source", "cite_label", "type").agg(F.count("*").alias("n")), "SELECT cite_source, cite_label, type, count(*) AS n FROM long GROUP BY ALL", True)
_simple("count_unique_refs", lambda u: analyze.count_unique(u.withColumn("title", F.concat(F.lit("T"), F.col("duplicate_id").cast("string"))), True), "SELECT long.*, 'T' || duplicate_id AS title FROM long")
_simple("phase_types", analyze.phase_types, "SELECT DISTINCT a.duplicate_id, a.s AS cite_source, b.l AS cite_label, CASE WHEN u THEN 'unique' ELSE 'duplicated' END AS type FROM src a JOIN lab b USING (duplicate_id) JOIN alone USING (duplicate_id)")


def _matrix(kind: str, prefix: str, column: str, values: list[str]) -> None:
    flags = ", ".join(f"""coalesce(bool_or({column} = '{v}'), false) AS "{prefix}{v}" """ for v in values)
    _simple(f"compare_{kind}", lambda u: analyze.compare_sources(u, kind), f"SELECT duplicate_id, {flags} FROM raw GROUP BY duplicate_id")


_matrix("sources", "source__", "cite_source", [f"src{i}" for i in range(20)])
_matrix("labels", "label__", "cite_label", ["final", "screened", "search"])
_matrix("strings", "string__", "cite_string", ["de", "en", "es", "fr"])
_simple("record_choices", lambda u: tags.choices(u, ["cite_source", "cite_label", "cite_string"], True), "SELECT DISTINCT 'cite_source' AS tag, s AS value FROM src UNION ALL SELECT DISTINCT 'cite_label', l FROM lab UNION ALL SELECT DISTINCT 'cite_string', cite_string FROM raw")
_simple(
    "row_filter",
    lambda u: tags.row_filter(u, cite_source=["src1", "src10"], cite_label=["screened"]).select("duplicate_id", "cite_source", "cite_label"),
    "SELECT duplicate_id, cite_source, cite_label FROM uni WHERE list_has_any(string_split(cite_source, ', '), ['src1', 'src10']) AND list_contains(string_split(cite_label, ', '), 'screened')",
)
_simple(
    "item_filter",
    lambda u: tags.item_filter(u, True, cite_source=["src1", "src2", "src3"]).select("duplicate_id", "cite_source"),
    "SELECT * FROM (SELECT duplicate_id, array_to_string(list_reverse(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(cite_source, ', '), lambda x: x IN ('src1', 'src2', 'src3')), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_prepend(b[1], a) END)), ', ') AS cite_source FROM uni) WHERE cite_source <> ''",
)
_simple("label_filter", lambda u: tags.label_filter(u, ["FINAL", "screen"]).select("duplicate_id", "cite_label"), "SELECT duplicate_id, cite_label FROM uni WHERE regexp_matches(cite_label, 'FINAL|screen', 'i')")

# overlaps and sets
_OVER = "o AS (SELECT x.s AS a, y.s AS b, count(*) AS records FROM src x JOIN src y USING (duplicate_id) GROUP BY ALL)"
_overlap = f", {_OVER} SELECT a, b, records, records / max(CASE WHEN a = b THEN records END) OVER (PARTITION BY a) AS share FROM o"
_simple("overlap_counts", analyze.overlap, _overlap)
_simple("overlap_counts_part", analyze.overlap, _overlap, True)
_simple(
    "overlap_percent",
    lambda u: analyze.heatmap_data(u, "sources", plot_type="percentages"),
    f""", {_OVER}, p AS (SELECT *, records / max(CASE WHEN a = b THEN records END) OVER (PARTITION BY a) AS share FROM o)
SELECT *, CASE WHEN a = b THEN records::VARCHAR WHEN share > 0 AND share < 0.01 THEN '< 1%' ELSE round(share * 100)::BIGINT || '%' END AS label FROM p""",
)
_simple(
    "overlap_triangle",
    analyze.heatmap_data,
    f""", {_OVER}, z AS (SELECT a AS i, records AS n FROM o WHERE a = b)
SELECT a, b, records, records::VARCHAR AS label FROM o JOIN z p ON a = p.i JOIN z q ON b = q.i WHERE (p.n, a) >= (q.n, b)""",
)
_simple(
    "overlap_facet",
    lambda u: analyze.overlap(u, "cite_source", "cite_label"),
    """, o AS (SELECT l AS cite_label, x.s AS a, y.s AS b, count(*) AS records FROM src x JOIN src y USING (duplicate_id) JOIN lab USING (duplicate_id) GROUP BY ALL)
SELECT *, records / max(CASE WHEN a = b THEN records END) OVER (PARTITION BY cite_label, a) AS share FROM o""",
)
_SETS = "SELECT items, degree, count(*) AS records FROM (SELECT string_agg(s, '&' ORDER BY s) AS items, count(*)::INTEGER AS degree FROM {0} GROUP BY duplicate_id) GROUP BY ALL"
_simple("set_intersections", analyze.set_intersections, _SETS.format("src"))
_simple("set_intersections_part", analyze.set_intersections, _SETS.format("src"), True)
_simple("set_intersections_top", lambda u: analyze.set_intersections(u, nsets=5), ", best AS (SELECT s FROM src GROUP BY s ORDER BY count(*) DESC, s LIMIT 5) " + _SETS.format("(SELECT * FROM src WHERE s IN (SELECT s FROM best))"))
_simple("set_sizes", analyze.set_sizes, "SELECT s AS item, count(*) AS records FROM src GROUP BY 1")
_CON = "SELECT cite_source, cite_label, type, count(*) AS n FROM long GROUP BY ALL"
_simple("contributions_counts", lambda u: analyze.contributions(analyze.count_unique(u)), _CON)
_simple(
    "contributions_centered",
    lambda u: analyze.contributions(analyze.count_unique(u), center=True),
    f""", c AS ({_CON}) SELECT *, CASE WHEN type = 'unique' THEN n ELSE -n END AS signed_n,
CASE WHEN n * 10 < max(n) OVER () THEN CASE WHEN type = 'unique' THEN 1 ELSE -1 END * max(n) OVER () / 10 ELSE (CASE WHEN type = 'unique' THEN n ELSE -n END) / 2 END AS label_pos FROM c""",
)
_simple(
    "contributions_ordered",
    lambda u: analyze.contributions(analyze.count_unique(u), facets=None, bar_order=["final", "search"], color_order=["duplicated", "unique"]),
    """SELECT cite_label, type, count(*) AS n, CASE cite_label WHEN 'final' THEN 1 WHEN 'search' THEN 2 ELSE 3 END AS bar_place,
  CASE type WHEN 'duplicated' THEN 1 WHEN 'unique' THEN 2 ELSE 3 END AS color_place FROM long GROUP BY ALL""",
)
_simple("legend_totals", lambda u: analyze.legend_totals(analyze.count_unique(u)), "SELECT type, type || chr(10) || '(N = ' || format('{:,}', count(*)) || ')' AS legend FROM long GROUP BY type")

# counts, precision and recall
_RAW = "raws AS (SELECT cite_source AS \"Source\", count(*) AS \"Records_Imported\" FROM raw WHERE cite_source IS NOT NULL GROUP BY 1), own AS (SELECT s AS \"Source\", count(*) AS \"Distinct_Records\" FROM src GROUP BY 1)"
_SHARES = f"""s AS (SELECT *, "Distinct_Records" - "Unique_Records" AS "Nonunique_Records", {_PCT.format('"Distinct_Records" / nullif(sum("Distinct_Records") OVER (), 0)')} AS "Source_Contribution",
  {_PCT.format('"Unique_Records" / nullif(sum("Unique_Records") OVER (), 0)')} AS "Source_Unique_Contribution", {_PCT.format('"Unique_Records" / nullif("Distinct_Records", 0)')} AS "Source_Unique" FROM r)
SELECT * FROM s UNION ALL SELECT 'Total', sum("Records_Imported")::BIGINT, {{0}}, sum("Unique_Records")::BIGINT, sum("Nonunique_Records")::BIGINT, NULL, NULL, NULL FROM s"""
_simple("count_sources", lambda u: counts.count_sources(u, "cite_source"), 'SELECT s AS "Source", count(*) AS n FROM src GROUP BY 1')


@_add("record_counts", f", {_RAW}, r AS (SELECT * FROM raws LEFT JOIN own USING (\"Source\")) SELECT * FROM r UNION ALL SELECT 'Total', sum(\"Records_Imported\")::BIGINT, sum(\"Distinct_Records\")::BIGINT FROM r")
def _record_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.record_counts(adapters.doc_unique(spark, sf), adapters.doc_citations(spark, sf))


_UNIQUE = "n AS (SELECT cite_source AS \"Source\", count(DISTINCT duplicate_id) AS n FROM long WHERE \"unique\" {0} GROUP BY 1), r AS (SELECT raws.*, \"Distinct_Records\", coalesce(n, 0) AS \"Unique_Records\" FROM raws JOIN own USING (\"Source\") LEFT JOIN n USING (\"Source\")), "


def _record_summary(citations: Query, unique: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        u = unique(spark, sf)
        return counts.record_summary(u, citations(spark, sf), analyze.count_unique(u))

    return run


_summary_sql = f", {_RAW}, " + _UNIQUE.format("AND cite_label = 'search'") + _SHARES.format("(SELECT count(*) FROM uni)")
_add("record_summary", _summary_sql)(_record_summary(adapters.doc_citations, adapters.doc_unique))
_add("record_summary_part", _summary_sql, _PART + _UNI)(_record_summary(adapters.part_citations, adapters.part_unique))
_LABELLED = ", w AS (SELECT duplicate_id FROM uni WHERE regexp_matches(cite_label, 'screened', 'i')), raws AS (SELECT cite_source AS \"Source\", count(*) AS \"Records_Imported\" FROM raw WHERE cite_source IS NOT NULL AND duplicate_id IN (SELECT * FROM w) GROUP BY 1), own AS (SELECT s AS \"Source\", count(*) AS \"Distinct_Records\" FROM src WHERE duplicate_id IN (SELECT * FROM w) GROUP BY 1)"
_simple("initial_records", lambda u: counts.initial_records(u, ["screened"]), _LABELLED + ", r AS (SELECT * FROM raws JOIN own USING (\"Source\")) SELECT * FROM r UNION ALL SELECT 'Total', sum(\"Records_Imported\")::BIGINT, sum(\"Distinct_Records\")::BIGINT FROM r")
_simple("detailed_records", lambda u: counts.detailed_records(u, analyze.count_unique(u), ["screened"]), _LABELLED + ", " + _UNIQUE.format("AND cite_label = 'screened'") + _SHARES.format("(SELECT count(*) FROM uni)"))
_simple(
    "detailed_filtered",
    lambda u: counts.filtered_detailed_records(u, ["src1", "src2", "src3", "src4"], ["screened"]),
    ", w AS (SELECT duplicate_id FROM lab WHERE l = 'screened'), e AS (SELECT duplicate_id, cite_source FROM raw WHERE cite_source IN ('src1', 'src2', 'src3', 'src4') AND duplicate_id IN (SELECT * FROM w)), "
    "k AS (SELECT duplicate_id FROM e GROUP BY 1 HAVING count(DISTINCT cite_source) = 1), r AS (SELECT cite_source AS \"Source\", count(*) AS \"Records_Imported\", count(DISTINCT duplicate_id) AS \"Distinct_Records\", "
    "count(DISTINCT CASE WHEN duplicate_id IN (SELECT * FROM k) THEN duplicate_id END) AS \"Unique_Records\" FROM e GROUP BY 1), " + _SHARES.format("(SELECT count(DISTINCT duplicate_id) FROM e)"),
)
_PHASE = """p AS (SELECT s AS "Source", count(DISTINCT duplicate_id) AS "Distinct_Records", count(DISTINCT CASE WHEN l = 'screened' THEN duplicate_id END) AS screened, count(DISTINCT CASE WHEN l = 'final' THEN duplicate_id END) AS final
  FROM src JOIN lab USING (duplicate_id) GROUP BY 1), q AS (SELECT *, CASE WHEN "Distinct_Records" > 0 THEN round(final / "Distinct_Records" * 100, 2) ELSE 0 END AS "Precision", CASE WHEN f > 0 THEN round(final / f * 100, 2) ELSE 0 END AS "Recall" FROM p, t)
SELECT * EXCLUDE (n, c, f) FROM q UNION ALL SELECT 'Total', {0}, c, f, round(f / {0} * 100, 2), NULL FROM t"""
_phase_records = ", t AS (SELECT (SELECT count(*) FROM uni) AS n, (SELECT count(*) FROM lab WHERE l = 'screened') AS c, (SELECT count(*) FROM lab WHERE l = 'final') AS f), " + _PHASE.format("n")
_simple("phase_records", counts.phase_records, _phase_records)
_simple("phase_records_part", counts.phase_records, _phase_records, True)
_add(
    "phase_count",
    ", t AS (SELECT (SELECT count(*) FROM src) AS n, (SELECT count(*) FROM raw WHERE cite_label = 'screened') AS c, (SELECT count(*) FROM raw WHERE cite_label = 'final') AS f), " + _PHASE.format("n"),
)(lambda s, d: counts.phase_count(adapters.doc_unique(s, d), adapters.doc_citations(s, d)))
_SUMMARY = """, e AS (SELECT DISTINCT l AS stage, lab.duplicate_id, s AS item FROM lab LEFT JOIN src USING (duplicate_id) WHERE l IN ('search', 'final')),
k AS (SELECT *, coalesce(u, false) AS o FROM e LEFT JOIN alone USING (duplicate_id)),
i AS (SELECT stage, item, count(*) AS "Records_total", sum(o::BIGINT)::BIGINT AS "Records_unique" FROM k WHERE item IS NOT NULL GROUP BY ALL UNION ALL SELECT stage, 'Total', count(DISTINCT duplicate_id), sum(o::BIGINT)::BIGINT FROM k GROUP BY stage),
f AS (SELECT stage, item, "Records_total", "Records_unique", "Records_unique" / max(CASE WHEN item = 'Total' THEN "Records_total" END) OVER (PARTITION BY stage) AS "Contribution_unique",
  CASE WHEN item <> 'Total' THEN "Records_total" / max(CASE WHEN item = 'Total' THEN "Records_total" END) OVER (PARTITION BY stage) END AS "Sensitivity",
  CASE WHEN stage <> 'search' THEN "Records_total" / max(CASE WHEN stage = 'search' THEN "Records_total" END) OVER (PARTITION BY item) END AS "Precision" FROM i)
SELECT * FROM f"""
_simple("citation_summary", counts.citation_summary, _SUMMARY)
_simple("citation_summary_part", counts.citation_summary, _SUMMARY, True)
_simple("citation_summary_top", lambda u: counts.citation_summary(u, top_n=3), _SUMMARY + " WHERE item = 'Total' OR item IN (SELECT item FROM i WHERE stage = 'search' AND item <> 'Total' ORDER BY \"Records_total\" DESC, item LIMIT 3)")

# figures that notebooks take from the long frame
_simple("share_within_source", lambda u: counts.share_within(analyze.count_unique(u), "cite_source", "type"), ", g AS (SELECT cite_source, type, count(*) AS n FROM long GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY cite_source) AS share FROM g")
_add("journal_topk", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10", "")(lambda s, d: counts.top_values(adapters.table(s, d, "part"), "p_brand", 10))
_add("year_counts", "SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL", "")(
    lambda s, d: adapters.table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))
)

# bibliographic fields, citations and references
_BIB = """WITH f AS (SELECT l_orderkey, min(l_partkey) AS partkey, count(*) AS n FROM lineitem GROUP BY 1),
bib AS (SELECT o_orderkey::VARCHAR AS record_id, upper(substr(n_name, 1, 1)) || lower(substr(replace(n_name, '_', ''), 2)) || ', ' || substr(p_type, 1, 1) || '.' || CASE WHEN n > 1 THEN ' and ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ', X. Y.' ELSE '' END
    || CASE WHEN n > 4 THEN ' and Third, Anna' ELSE '' END AS author, year(o_orderdate)::VARCHAR AS year, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS journal, p_type AS source, p_size::VARCHAR AS volume,
    CASE WHEN p_size % 2 = 0 THEN n::VARCHAR END AS issue, NULL::VARCHAR AS number, p_size || '-' || (p_size + n) AS pages, CASE WHEN n % 3 = 0 THEN '10.1000/' || partkey END AS doi, CASE WHEN n % 3 = 1 THEN 'https://example.org/' || o_orderkey END AS url
  FROM orders JOIN f ON o_orderkey = l_orderkey JOIN part ON partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def _bib(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _add(name, sql, _BIB)(lambda spark, sf: f(adapters.bibliography(spark, sf)))


_bib("bibliography", lambda b: b, "SELECT * FROM bib")
_bib("coalesce_fields", lambda b: dedup.normalised(b).select("record_id", "journal", "number", "pages", "isbn"), "SELECT record_id, coalesce(journal, source) AS journal, coalesce(number, issue) AS number, pages, NULL::VARCHAR AS isbn FROM bib")
_bib("drop_near_empty", lambda b: reader.drop_near_empty(b.select("record_id", "journal", "issue", "doi", "url"), ["record_id"]), "SELECT record_id, journal, issue, doi, url FROM bib WHERE (journal IS NOT NULL)::INT + (issue IS NOT NULL)::INT + (doi IS NOT NULL)::INT + (url IS NOT NULL)::INT > 1")
_REF = """SELECT record_id, list_reduce(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN i = len(a) THEN ' & ' ELSE ', ' END || a[i]), lambda x, y: x || y) || ' (' || year || '). ' || title || '. ' || coalesce(j, '')
  || ', ' || volume || coalesce('(' || issue || ')', '') || '. ' || coalesce('https://doi.org/' || doi, url, '') AS reference
FROM (SELECT *, string_split(replace(author, 'X. Y.', 'X. Y.'), ' and ') AS raw_a, list_transform(string_split(author, ' and '), lambda x: regexp_replace(x, ', Anna$', ', A.')) AS a, upper(substr(journal, 1, 1)) || lower(substr(journal, 2)) AS j FROM bib)"""
_bib("apa_reference", lambda b: b.select("record_id", cite.apa_reference(b).alias("reference")), _REF)
_LETTER = "CASE WHEN {0} <= 26 THEN chr((96 + {0})::INT) ELSE chr((96 + ({0} - 1) // 26)::INT) || chr((97 + ({0} - 1) % 26)::INT) END"
#: Author lists of the bibliography have three names at most, so no common beginning is elided.
_CITED = """, au AS (SELECT record_id, year, unnest(string_split(author, ' and ')) AS name, generate_subscripts(string_split(author, ' and '), 1) AS p FROM bib),
nm AS (SELECT *, regexp_replace(name, ',.*$', '') AS last, array_to_string(list_transform(string_split(trim(replace(regexp_replace(name, '^[^,]*,', ''), '.', '')), ' '), lambda x: substr(x, 1, 1)), '. ') || '.' AS initials FROM au),
un AS (SELECT last FROM nm GROUP BY last HAVING count(DISTINCT initials) > 1),
li AS (SELECT record_id, year, list(CASE WHEN un.last IS NULL THEN nm.last ELSE initials || ' ' || nm.last END ORDER BY p) AS l FROM nm LEFT JOIN un USING (last) GROUP BY ALL),
ba AS (SELECT *, l[1] || CASE len(l) WHEN 1 THEN '' WHEN 2 THEN ' & ' || l[2] ELSE ' et al.' END || ' (' || year || ')' AS base FROM li),
ki AS (SELECT DISTINCT base, l FROM ba), ck AS (SELECT base, count(*) AS kinds FROM ki GROUP BY base),
co AS (SELECT a.base, max(CASE WHEN a.l[1] <> b.l[1] THEN 0 WHEN a.l[2] IS DISTINCT FROM b.l[2] THEN 1 WHEN a.l[3] IS DISTINCT FROM b.l[3] THEN 2 ELSE 3 END) AS c FROM ki a JOIN ki b ON a.base = b.base AND a.l <> b.l GROUP BY a.base),
sa AS (SELECT base, l, len(l) AS n, count(*) OVER (PARTITION BY base, l) > 1 AS twice FROM ba),
cm AS (SELECT base, max(c) AS c FROM (SELECT * FROM co UNION ALL SELECT base, n FROM sa WHERE twice) GROUP BY base),
c1 AS (SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base
    WHEN kinds = 1 THEN left(base, -1) || """ + _LETTER.format("(row_number() OVER (PARTITION BY base ORDER BY record_id))") + """ || ')'
    WHEN len(l) <= c + 2 THEN CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' & ' || l[2] ELSE l[1] || ', ' || l[2] || ' & ' || l[3] END || ' (' || year || ')'
    ELSE array_to_string(l[1:c + 1], ', ') || ' et al. (' || year || ')' END AS t FROM ba JOIN ck USING (base) LEFT JOIN cm USING (base)),
ci AS (SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY t) = 1 THEN t ELSE left(t, -1) || """ + _LETTER.format("(row_number() OVER (PARTITION BY t ORDER BY record_id))") + """ || ')' END AS citation FROM c1)
"""
_bib("apa_citations", lambda b: cite.apa_citations(b, "record_id"), _CITED + "SELECT * FROM ci")
_add("year_letters", "SELECT o_orderkey, o_custkey || ' (' || year(o_orderdate) || chr((96 + row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey))::INT) || ')' AS citation FROM orders", "")(
    lambda s, d: adapters.table(s, d, "orders").selectExpr("o_orderkey", "o_custkey", "year(o_orderdate) as y", "row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderkey) as n").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(" ("), F.col("y").cast("string"), cite.letter(F.col("n")), F.lit(")")).alias("citation"))
)


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@_add(
    "record_level_table",
    _CITED.rstrip() + ", re AS (" + _REF + ") SELECT record_id AS duplicate_id, citation, reference, CASE WHEN doi IS NOT NULL THEN 'x' ELSE '' END AS \"source__DOI\", "
    + ", ".join(f"CASE WHEN source = '{v}' THEN 'x' ELSE '' END AS \"source__{v}\"" for v in _TYPES)
    + " FROM ci JOIN re USING (record_id) JOIN bib USING (record_id)",
    _BIB,
)
def _record_level(spark: SparkSession, sf: str) -> DataFrame:
    b = adapters.bibliography(spark, sf).withColumnRenamed("record_id", "duplicate_id").withColumn("cite_source", F.concat_ws(", ", "source", F.when(F.col("doi").isNotNull(), "DOI")))
    return cite.record_level_table(b, "sources", indicator_presence="x", indicator_absence="")


# scans and exports
_bib(
    "ris_lines",
    lambda b: b.select("record_id", F.array_join(writers.ris_lines(b.select("author", "title", "year", "doi", "volume", "pages")), "|").alias("lines")),
    "SELECT record_id, 'TY  - JOUR|AU  - ' || replace(author, ' and ', '|AU  - ') || '|TI  - ' || title || '|PY  - ' || year || coalesce('|DO  - ' || doi, '') || '|VL  - ' || volume || '|SP  - ' || replace(pages, '-', '|EP  - ') || '|ER  - |' AS lines FROM bib",
)
_simple("bib_note", lambda u: writers.bib_note(u.withColumn("title", F.col("duplicate_id"))), "SELECT duplicate_id AS title, 'cite_source: ' || cite_source || '; cite_label: ' || cite_label || '; cite_string: ' || cite_string AS note FROM uni")
_simple(
    "export_csv_separate",
    lambda u: writers.csv_frame(u.select("duplicate_id", "cite_label", "cite_string"), ["cite_label"]),
    "SELECT duplicate_id, cite_string, cite_label LIKE '%final%' AS label_final, cite_label LIKE '%screened%' AS label_screened, cite_label LIKE '%search%' AS label_search FROM uni",
)


_READ = "SELECT author, title, year, doi, volume, array_to_string(list_sort(string_split(pages, '-')), '-') AS pages, 'orders' AS cite_source, 'search' AS cite_label FROM bib"
_COLUMNS = ["author", "title", "year", "doi", "volume", "pages"]


@_add("ris_parse", "SELECT author, title, year, doi, volume, array_to_string(list_sort(string_split(pages, '-')), '-') AS pages FROM bib", _BIB)
def _ris_parse(spark: SparkSession, sf: str) -> DataFrame:
    """What the tag parser makes of the lines that the writer makes of the bibliography."""
    b = adapters.bibliography(spark, sf)
    lines = b.select(F.lit("all").alias("file"), ris.entries(F.array_join(writers.ris_lines(b.select(*_COLUMNS)), "\r\n")).alias("entries"))
    return ris.citations(ris.with_fields(lines), _COLUMNS).drop("file")


def _read_back(kind: str, write: Callable[[DataFrame, str], None], columns: list[str], sql: str) -> None:
    """The bibliography, written to a folder of files by an export and read from there by the import."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = fresh_dir(spark, f"orders.{kind}")
        write(adapters.bibliography(spark, sf), path)
        return reader.read_citations(spark, [path], cite_sources=["orders"], cite_labels=["search"]).select(*columns, "cite_source", "cite_label")

    _add(f"read_{kind}", sql, _BIB)(run)


def _write_nbib(b: DataFrame, path: str) -> None:
    line = lambda tag, c: F.concat(F.lit(f"{tag:<4}- "), c)
    head, tail = F.substring_index("title", " ", 1), F.substring_index("title", " ", -1)
    authors = F.array_join(F.transform(F.split("author", " and "), lambda x: line("AU", x)), "\n")
    doi = F.when(F.col("doi").isNotNull(), line("AID", F.concat("doi", F.lit(" [doi]"))))
    parts = [line("PMID", F.col("record_id")), line("TI", F.concat(head, F.lit("\n      "), tail)), authors, line("DP", F.concat("year", F.lit(" Jan"))), line("VI", F.col("volume")), line("PG", F.col("pages")), doi]
    b.select(F.concat(F.concat_ws("\n", *parts), F.lit("\n"))).write.text(path)


_read_back("ris", lambda b, path: writers.export_ris(b.select(*_COLUMNS), path), _COLUMNS, _READ)
_read_back("nbib", _write_nbib, _COLUMNS, _READ.replace("list_sort(string_split(pages, '-'))", "list_sort([pages])"))
_read_back("csv", lambda b, path: writers.export_csv(b.drop("source"), path), [*_COLUMNS, "journal", "url"], _READ.replace("array_to_string(list_sort(string_split(pages, '-')), '-') AS pages", "pages, journal, url"))
_read_back("bib", lambda b, path: writers.export_bib(b.select(*_COLUMNS, "url"), path, ()), [*_COLUMNS, "url"], _READ.replace("array_to_string(list_sort(string_split(pages, '-')), '-') AS pages", "pages, url"))


_bib("pages_split", lambda b: b.select("record_id", F.split("pages", "-")[0].alias("start_page"), F.split("pages", "-")[1].alias("end_page")), "SELECT record_id, string_split(pages, '-')[1] AS start_page, string_split(pages, '-')[2] AS end_page FROM bib")
_add("year_extract", "SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%d %b %Y'), '\\d{4}') AS year FROM orders", "")(lambda s, d: adapters.table(s, d, "orders").select("o_orderkey", F.regexp_extract(F.date_format("o_orderdate", "dd MMM yyyy"), r"\d{4}", 0).alias("year")))

# fuzzy matching
_MATCH = _BIB + """, c AS (SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer),
m1 AS (SELECT record_id, author, year, translate(record_id, '0123456789', 'abcdefghij') || ' ' || title || ' in the ' || segment || ' market of ' || translate(record_id, '0123456789', 'abcdefghij') AS title,
    journal, volume, issue, pages, CASE WHEN doi IS NOT NULL THEN '10.1000/' || record_id END AS doi, 'A' AS cite_source
  FROM bib JOIN orders ON o_orderkey::VARCHAR = record_id JOIN c ON o_custkey = c_custkey),
m AS (SELECT * FROM m1 UNION ALL SELECT 'b' || record_id, author, year, replace(title, 'market', 'Markets'), journal, volume, issue, pages, NULL, 'B' FROM m1 WHERE record_id::BIGINT % 5 = 0
  UNION ALL SELECT 'c' || record_id, regexp_replace(author, ' and .*', ''), year, replace(title, ' in the ', ' in teh '), NULL, volume, issue, pages, doi, 'C' FROM m1 WHERE record_id::BIGINT % 7 = 0),
k AS (SELECT record_id, trim(regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g')) AS title, trim(regexp_replace(upper(author), '[^A-Z0-9]+', ' ', 'g')) AS author, lower(doi) AS doi, volume,
    trim(regexp_replace(pages, '[^A-Z0-9]+', ' ', 'g')) AS pages, issue AS number, year, trim(regexp_replace(upper(journal), '[^A-Z0-9]+', ' ', 'g')) AS journal,
    regexp_extract(upper(author), '^([A-Z0-9]+)', 1) AS author_key, regexp_replace(upper(title), '[^A-Z0-9]+', '', 'g') AS letters FROM m),
"""
_CANDIDATES = """x AS (SELECT *, substr(letters, 1, 12) AS title_key, right(letters, 12) AS title_end FROM k),
p AS (""" + " UNION ".join(f"SELECT least(a.record_id, b.record_id) AS id1, greatest(a.record_id, b.record_id) AS id2 FROM x a JOIN x b USING ({key}) WHERE a.record_id < b.record_id" for key in ("doi", "title_key", "title_end", "author_key, year", "journal, volume, pages", "year, pages, volume")) + """),
s AS (SELECT id1, id2, a.title AS t1, b.title AS t2, a.author AS a1, b.author AS a2, jaro_winkler_similarity(a.title, b.title) AS title, jaro_winkler_similarity(a.author, b.author) AS author, jaro_winkler_similarity(a.doi, b.doi) AS doi,
    jaro_winkler_similarity(a.journal, b.journal) AS journal, jaro_winkler_similarity(a.pages, b.pages) AS pages, a.year = b.year AS same_year, a.volume = b.volume AS same_volume, a.number = b.number AS same_number
  FROM p JOIN k a ON id1 = a.record_id JOIN k b ON id2 = b.record_id),
r AS (SELECT *, (doi = 1 AND title >= 0.85) OR (coalesce(journal >= 0.8, true) AND same_year AND coalesce(same_volume, true) AND coalesce(same_number, true) AND coalesce(doi >= 1, true)
    AND ((title >= 0.99 AND author >= 0.8 AND coalesce(pages >= 0.6, true)) OR (title >= 0.9 AND author >= 0.85 AND (coalesce(same_volume, false) OR coalesce(pages >= 0.95, false) OR coalesce(same_number, false))))) AS auto FROM s),
e AS (SELECT id1 AS a, id2 AS b FROM r WHERE auto UNION SELECT id2, id1 FROM r WHERE auto), w AS (SELECT record_id, record_id AS t FROM m UNION SELECT w.record_id, e.b FROM w JOIN e ON w.t = e.a),
g AS (SELECT record_id, min(t) AS duplicate_id FROM w GROUP BY record_id)
"""


def _blocked(spark: SparkSession, sf: str, score: Callable, kind: T.DataType) -> DataFrame:
    """All pairs of a journal, volume and page range, with a score of their titles."""
    k = written(dedup.keys(dedup.normalised(adapters.match_records(spark, sf))).select("record_id", "title", "journal", "volume", "pages"), "match-records")
    return dedup.scored_pairs(k, ("journal", "volume", "pages"), "title", score, kind)


def _six_places(texts: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarities rounded where they are made, half up."""
    return np.floor(texts.jaro_winkler(i, j) * 1e6 + 0.5) / 1e6


_SCORED = "p AS (SELECT least(a.record_id, b.record_id) AS id1, greatest(a.record_id, b.record_id) AS id2, a.title AS t, b.title AS u FROM k a JOIN k b USING (journal, volume, pages) WHERE a.record_id < b.record_id) "
_add("fuzzy_pairs_jw", _SCORED + "SELECT id1, id2, round(jaro_winkler_similarity(t, u), 6) AS score FROM p", _MATCH)(lambda s, d: _blocked(s, d, _six_places, T.DoubleType()))
_add("levenshtein_pairs", _SCORED + "SELECT id1, id2, levenshtein(t, u)::INTEGER AS score FROM p", _MATCH)(lambda s, d: _blocked(s, d, Texts.levenshtein, T.IntegerType()))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Each part of an order is linked with the order's least part."""
    items = adapters.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("b"))
    least = items.groupBy("l_orderkey").agg(F.min("b").alias("a"))
    return items.join(least, "l_orderkey").where("a <> b").select("a", "b").distinct()


_add(
    "components",
    """WITH RECURSIVE l AS (SELECT DISTINCT min(l_partkey) OVER (PARTITION BY l_orderkey) AS a, l_partkey AS b FROM lineitem), n AS (SELECT a, b FROM l WHERE a <> b),
u AS (SELECT a, b FROM n UNION SELECT b, a FROM n), r AS (SELECT min(a) AS t FROM u UNION SELECT u.b FROM r JOIN u ON r.t = u.a), s AS (SELECT count(*) AS n FROM r),
v AS (SELECT a AS node, a AS t FROM u WHERE a NOT IN (SELECT t FROM r) UNION SELECT v.node, u.b FROM v JOIN u ON v.t = u.a)
SELECT t AS node, min(t) OVER () AS component FROM r UNION ALL SELECT node, min(t) FROM v GROUP BY node""",
    "",
)(lambda s, d: components(_links(s, d)).groupBy("node").agg(F.min("component").alias("component")))


@_add(
    "manual_merge",
    """, g AS (SELECT uni.*, CASE WHEN duplicate_id % 2 = 1 AND duplicate_id - 1 IN (SELECT duplicate_id FROM uni) THEN duplicate_id - 1 ELSE duplicate_id END AS t FROM uni)
SELECT t AS duplicate_id, string_agg(record_ids, ', ' ORDER BY duplicate_id) AS record_ids, coalesce(string_agg(nullif(cite_source, ''), ', ' ORDER BY duplicate_id), '') AS cite_source,
string_agg(cite_label, ', ' ORDER BY duplicate_id) AS cite_label, string_agg(cite_string, ', ' ORDER BY duplicate_id) AS cite_string FROM g GROUP BY t""",
)
def _manual_merge(spark: SparkSession, sf: str) -> DataFrame:
    u = adapters.doc_unique(spark, sf)
    odd = u.where("duplicate_id % 2 = 1").select(F.col("duplicate_id").alias("duplicate_id2"), (F.col("duplicate_id") - 1).alias("duplicate_id1"))
    return dedup.add_manual_pairs(u, odd.join(u.select(F.col("duplicate_id").alias("duplicate_id1")), "duplicate_id1", "left_semi"))


@_add(
    "fuzzy_dedup",
    _CANDIDATES
    + """, z AS (SELECT m.*, duplicate_id, row_number() OVER (PARTITION BY duplicate_id ORDER BY doi IS NOT NULL DESC, (journal IS NOT NULL)::INT + 2 * (issue IS NOT NULL)::INT DESC, record_id DESC) AS n FROM m JOIN g USING (record_id))
SELECT duplicate_id, string_agg(record_id, ', ' ORDER BY record_id) AS record_ids, string_agg(cite_source, ', ' ORDER BY record_id) AS cite_source, max(CASE WHEN n = 1 THEN title END) AS title, max(CASE WHEN n = 1 THEN doi END) AS doi FROM z GROUP BY duplicate_id""",
    _MATCH.replace("WITH f AS", "WITH RECURSIVE f AS", 1),
)
def _fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_citations(adapters.match_records(spark, sf)).select("duplicate_id", "record_ids", "cite_source", "title", "doi")


@_add(
    "fuzzy_dedup_manual",
    _CANDIDATES
    + """SELECT id1, id2, a.duplicate_id AS duplicate_id1, b.duplicate_id AS duplicate_id2, t1 AS title1, t2 AS title2, round(title, 6) AS title, round(author, 6) AS author
FROM r JOIN g a ON id1 = a.record_id JOIN g b ON id2 = b.record_id WHERE NOT coalesce(auto, false) AND ((title >= 0.85 AND author >= 0.7) OR doi = 1 OR (title >= 0.95 AND same_year)) AND a.duplicate_id <> b.duplicate_id""",
    _MATCH.replace("WITH f AS", "WITH RECURSIVE f AS", 1),
)
def _fuzzy_manual(spark: SparkSession, sf: str) -> DataFrame:
    pairs = dedup.dedup_citations(adapters.match_records(spark, sf), manual=True)[1]
    return pairs.select("id1", "id2", "duplicate_id1", "duplicate_id2", "title1", "title2", F.round("title", 6).alias("title"), F.round("author", 6).alias("author"))
