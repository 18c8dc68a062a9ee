"""Independent SQL (DuckDB dialect) for every registered query that SQL can express.

Written from the operator definitions, not from the Spark code: PageRank is an
unrolled CTE, the index is ``unnest`` over a regex split, BM25 is spelled out.
"""

from __future__ import annotations

import re

from webloom.constants import DENSITY_PRESETS
from webloom.plans import catalog as C

TOKEN = r"[^\p{L}\p{N}]+"

P_BASE = """
np AS (SELECT count(*) + count(*) // 10 AS n FROM part),
pg AS (SELECT p_partkey AS url, p_name || ' ' || p_type || ' ' || p_brand AS text
       FROM part),
lk AS (SELECT l_partkey AS url, l_orderkey, l_linenumber, l_suppkey,
              l_orderkey % (1 + (l_partkey * 7919 + l_suppkey) % (SELECT n FROM np)) AS link
       FROM lineitem),
deg AS (SELECT url, count(*) AS d FROM lk GROUP BY url),
r0 AS (SELECT url, CAST(1.0 AS DOUBLE) AS rank FROM pg)"""


def _rounds(n: int) -> str:
    out = []
    for i in range(1, n + 1):
        out.append(f"""r{i} AS (SELECT lk.link AS url, 0.15 + 0.85 * sum(p.rank / deg.d) AS rank
       FROM lk JOIN deg ON lk.url = deg.url JOIN r{i - 1} p ON lk.url = p.url
       GROUP BY lk.link)""")
    return ",\n".join(out)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts if p.strip())


RANKED = """rk AS (SELECT r1.url, r1.rank, coalesce(deg.d, 0) AS total_links
       FROM r1 JOIN pg ON r1.url = pg.url LEFT JOIN deg ON r1.url = deg.url)"""


def _index(src: str, url: str, text: str) -> str:
    return f"""tok AS (SELECT {url} AS url, unnest(regexp_split_to_array(lower({text}), '{TOKEN}')) AS term
        FROM {src}),
idx AS (SELECT term, url, count(*) AS tf FROM tok WHERE term <> '' GROUP BY term, url)"""


def _terms(q: str) -> str:
    return ", ".join(f"'{t}'" for t in dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


def _bm25(q: str) -> str:
    return f"""dl AS (SELECT url, sum(tf) AS dl FROM idx GROUP BY url),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qp AS (SELECT * FROM idx WHERE term IN ({_terms(q)})),
dft AS (SELECT term, count(*) AS df FROM qp GROUP BY term),
hits AS (SELECT qp.url,
                sum(ln(1.0 + (CAST(st.n - dft.df AS DOUBLE) + 0.5) / (CAST(dft.df AS DOUBLE) + 0.5))
                    * qp.tf * 2.2 / (qp.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score
         FROM qp JOIN dft ON qp.term = dft.term JOIN dl ON qp.url = dl.url, st
         GROUP BY qp.url)"""


def _request(lookups: int, budget: int) -> str:
    return _with(P_BASE, _rounds(1), RANKED, _index("pg", "url", "text"), _bm25(C.GRAPH_QUERY), f"""
fh AS (SELECT url FROM hits ORDER BY score DESC, url ASC LIMIT {lookups}),
found AS (SELECT rk.url, floor(round(rk.rank, 9) * 1000000 + 0.5) / 1000000 AS rank, rk.total_links
          FROM rk JOIN fh ON rk.url = fh.url WHERE floor(round(rk.rank, 9) * 1000000 + 0.5) / 1000000 > 2.0),
top AS (SELECT * FROM found ORDER BY rank DESC, url ASC LIMIT {budget // 10}),
seeds AS (SELECT row_number() OVER (ORDER BY rank DESC, url ASC) - 1 AS seed_idx,
                 url, rank, total_links FROM top),
dlinks AS (SELECT s.seed_idx, lk.link,
                  min(struct_pack(o := lk.l_orderkey, n := lk.l_linenumber, s := lk.l_suppkey))
                    AS first_pos
           FROM lk JOIN seeds s ON lk.url = s.url GROUP BY s.seed_idx, lk.link),
sedges AS (SELECT CAST(d.seed_idx AS BIGINT) AS source, CAST(s.seed_idx AS BIGINT) AS target,
                  1 AS value
           FROM dlinks d JOIN seeds s ON d.link = s.url),
ne AS (SELECT source AS seed_idx, count(*) AS n_edges FROM sedges GROUP BY source),
ordered AS (SELECT d.seed_idx, d.link,
                   row_number() OVER (PARTITION BY d.seed_idx ORDER BY d.first_pos, d.link) AS k
            FROM dlinks d),
keep AS (SELECT o.* FROM ordered o LEFT JOIN ne ON o.seed_idx = ne.seed_idx
         WHERE o.k <= 10 - coalesce(ne.n_edges, 0)),
cnt AS (SELECT seed_idx, count(*) AS c FROM keep GROUP BY seed_idx),
offs AS (SELECT seed_idx, (SELECT count(*) FROM seeds)
                + coalesce(sum(c) OVER (ORDER BY seed_idx ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS off FROM cnt),
nbrs AS (SELECT CAST(offs.off + keep.k - 1 AS BIGINT) AS node_id, keep.seed_idx, keep.link
         FROM keep JOIN offs ON keep.seed_idx = offs.seed_idx),
nodes AS (SELECT CAST(seed_idx AS BIGINT) AS node_id, url AS name, 0 AS "group",
                 rank, total_links FROM seeds
          UNION ALL
          SELECT node_id, link AS name,
                 CAST(CASE WHEN seed_idx % 20 = 0 THEN 19 ELSE seed_idx % 20 END AS INTEGER),
                 CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM nbrs),
edges AS (SELECT source, target, value FROM sedges
          UNION ALL
          SELECT node_id AS source, CAST(seed_idx AS BIGINT) AS target, 4 AS value FROM nbrs)
""")


REQUEST = _request(10000, C.GRAPH_BUDGET)
LIMITED = _request(C.LIMITED["lookups"], C.LIMITED["budget"])

GRAPH_INDEX = _with(P_BASE, _index("pg", "url", "text"))
DOC_INDEX = _with(_index("documents", "doc_id", "text"))

TAG = r"<[^\n]*?>"
NON_ASCII = r"[^\x00-\x7F]"

SQL: dict[str, str] = {
    "pagerank_r1": _with(P_BASE, _rounds(1)) + " SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank FROM r1",
    "pagerank_r3": _with(P_BASE, _rounds(3)) + " SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank FROM r3",
    "pagerank_r10": _with(P_BASE, _rounds(10))
    + " SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank FROM r10",
    "ranked_pages": _with(P_BASE, _rounds(1), RANKED)
    + " SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank, total_links FROM rk",
    "top_ranks": _with(P_BASE, _rounds(1))
    + f" SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank FROM r1 ORDER BY rank DESC, url ASC LIMIT {C.TOP_N}",
    "out_degree": _with(P_BASE)
    + " SELECT url, count(*) AS out_degree, count(DISTINCT link) AS n_targets FROM lk GROUP BY url",
    "received_r1": _with(P_BASE)
    + " SELECT lk.link AS url, floor(round(sum(1.0 / deg.d), 9) * 1000000 + 0.5) / 1000000 AS received"
      " FROM lk JOIN deg ON lk.url = deg.url GROUP BY lk.link",
    "search_analysis": REQUEST + " SELECT url, rank, total_links FROM found",
    "search_table": REQUEST
    + f" SELECT url, rank, total_links FROM found ORDER BY rank DESC, url LIMIT {100}",
    "search_seeds": REQUEST + " SELECT seed_idx, url, rank, total_links FROM seeds",
    "search_seed_edges": REQUEST + " SELECT source, target, value FROM sedges",
    "search_neighbours": REQUEST + " SELECT node_id, seed_idx, link FROM nbrs",
    "graph_nodes": REQUEST + ' SELECT node_id, name, "group", rank, total_links FROM nodes',
    "graph_edges": REQUEST + " SELECT source, target, value FROM edges",
    "graph_document": REQUEST + """,
nl AS (SELECT coalesce(list(struct_pack(name := name, "group" := "group", rank := rank,
                                        total_links := total_links) ORDER BY node_id), []) AS l
       FROM nodes),
el AS (SELECT coalesce(list(struct_pack(source := source, target := target, value := value)
                            ORDER BY CASE WHEN value = 1 THEN source ELSE target END, value,
                                     source, target), []) AS l
       FROM edges)
SELECT CAST(len(nl.l) AS INTEGER) AS n_nodes, CAST(len(el.l) AS INTEGER) AS n_edges,
       to_json(struct_pack(nodes := nl.l, links := el.l)) AS document
FROM nl, el""",
    "hit_share_graph": GRAPH_INDEX + f""",
h AS (SELECT count(DISTINCT url) AS hits FROM idx WHERE term IN ({_terms(C.GRAPH_QUERY)})),
b AS (SELECT count(DISTINCT url) AS base_hits FROM idx WHERE term IN ({_terms(C.GRAPH_BASE_TERM)}))
SELECT hits, base_hits, 100.0 * hits / base_hits AS pct,
       '"{C.GRAPH_QUERY}" in ' || substr(CAST(100.0 * hits / base_hits AS VARCHAR), 1, 5)
       || '% of wikipedia pages' AS caption
FROM h, b""",
    "text_with_ranks": _with(P_BASE, _rounds(1), RANKED)
    + " SELECT rk.url, floor(round(rk.rank, 9) * 1000000 + 0.5) / 1000000 AS rank, length(pg.text) AS n_chars"
      " FROM pg JOIN rk ON pg.url = rk.url",
    "rank_slice_keys": _with(P_BASE, _rounds(1), RANKED) + " SELECT DISTINCT total_links FROM rk",
    "rank_slice": _with(P_BASE, _rounds(1), RANKED)
    + f" SELECT url, floor(round(rank, 9) * 1000000 + 0.5) / 1000000 AS rank FROM rk WHERE total_links = {C.SLICE_LINKS}",
    "doc_index": DOC_INDEX + " SELECT term, url, tf FROM idx",
    "doc_search_or": DOC_INDEX
    + f" SELECT url, count(DISTINCT term) AS matched FROM idx"
      f" WHERE term IN ({_terms(C.DOC_QUERY)}) GROUP BY url",
    "doc_search_and": DOC_INDEX
    + f" SELECT url, count(DISTINCT term) AS matched FROM idx"
      f" WHERE term IN ({_terms(C.DOC_QUERY)}) GROUP BY url"
      f" HAVING count(DISTINCT term) = {len(_terms(C.DOC_QUERY).split(','))}",
    "doc_phrase": f"""SELECT doc_id AS url FROM documents
WHERE strpos(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '{TOKEN}'),
                                                lambda x: x <> ''), ' ') || ' ',
             ' {' '.join(C.DOC_PHRASE.lower().split())} ') > 0""",
    "doc_bm25": _with(_index("documents", "doc_id", "text"), _bm25(C.DOC_QUERY))
    + " SELECT url, floor(round(score, 9) * 1000000 + 0.5) / 1000000 AS score FROM hits",
    "doc_best": _with(_index("documents", "doc_id", "text"), _bm25(C.DOC_QUERY)) + f"""
SELECT url, score, CAST(row_number() OVER (ORDER BY score DESC, url) AS INTEGER) AS rank
FROM (SELECT url, floor(round(score, 9) * 1000000 + 0.5) / 1000000 AS score FROM hits) QUALIFY rank <= {C.TOP_N}""",
    "doc_count": "SELECT count(*) AS n_docs FROM documents",
    "page_text": f"""SELECT page_id, url,
       regexp_replace(regexp_replace(html, '{TAG}', '', 'g'), '{NON_ASCII}', '', 'g') AS plaintext
FROM pages""",
    "page_links": r"""WITH a AS (
  SELECT page_id, url,
         list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: starts_with(x, '/')) AS hs
  FROM pages),
h AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM a)
SELECT page_id,
       CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
            ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href END AS link,
       min(pos) AS first_pos
FROM h GROUP BY ALL""",
    "page_domain": r"""SELECT page_id, url FROM pages
WHERE lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) = 'example.net'
   OR ends_with(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)),
                '.example.net')""",
    "page_prefix": f"SELECT page_id, url FROM pages WHERE starts_with(url, '{C.PREFIX_PATTERN}')",
    "event_key": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
}


def _nearest() -> str:
    far = [f"pow(total_links - {x}, 2) + pow(rank - {y}, 2)" for x, y in C.CENTRES]
    return f""",
far AS (SELECT *, [{', '.join(far)}] AS d FROM arows),
lab AS (SELECT url, CAST(total_links AS DOUBLE) AS total_links, rank, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS label FROM far)"""


def _lloyd(rounds: int) -> str:
    """Rounds of k-means from four distinct rows at equal steps, unrolled."""
    near = "list_position(list_transform(c, lambda p: pow(total_links - p[1], 2) + pow(rank - p[2], 2)), list_min(list_transform(c, lambda p: pow(total_links - p[1], 2) + pow(rank - p[2], 2)))) - 1"
    out = """,
am AS MATERIALIZED (SELECT url, CAST(total_links AS DOUBLE) AS total_links, rank FROM arows),
pt AS (SELECT DISTINCT total_links, rank FROM am),
pn AS (SELECT *, row_number() OVER (ORDER BY total_links, rank) - 1 AS i, count(*) OVER () AS n FROM pt),
c0 AS MATERIALIZED (SELECT list([total_links, rank] ORDER BY i) AS c FROM pn WHERE i IN (0, n // 4, 2 * n // 4, 3 * n // 4))"""
    for r in range(1, rounds + 1):
        out += f""",
l{r} AS MATERIALIZED (SELECT total_links, rank, {near} AS label FROM am, c{r - 1}),
m{r} AS MATERIALIZED (SELECT label, [avg(total_links), avg(rank)] AS p FROM l{r} GROUP BY label),
c{r} AS MATERIALIZED (SELECT list(coalesce(p, o) ORDER BY k) AS c FROM (SELECT unnest(c) AS o, generate_subscripts(c, 1) - 1 AS k FROM c{r - 1}) LEFT JOIN m{r} ON label = k)"""
    return out + f""",
lab AS (SELECT url, total_links, rank, CAST({near} AS INTEGER) AS label FROM am, c{rounds})"""


def _r6(x: str) -> str:
    return f"floor(round({x}, 9) * 1000000 + 0.5) / 1000000"


HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"

INDEX_LINES = f"""WITH l AS (
  SELECT {HOST_SQL} || ' ' || CAST(page_id AS VARCHAR) || ' {{"url": "' || url
         || '", "filename": "crawl/segment-' || CAST(page_id % 10 AS VARCHAR) || '/warc/part-'
         || CAST(page_id % 10 AS VARCHAR) || '.warc.gz"}}' AS value
  FROM pages),
p AS (SELECT split_part(value, ' ', 1) AS urlkey,
             json_extract_string(regexp_extract(value, '\\{{.*', 0), '$.url') AS url,
             json_extract_string(regexp_extract(value, '\\{{.*', 0), '$.filename') AS filename
      FROM l),
idx AS (SELECT urlkey, url, filename, filename IS NOT NULL AS valid,
               replace(replace(filename, '/warc/', '/wet/'), 'warc.gz', 'warc.wet.gz') AS text_path,
               replace(replace(filename, '/warc/', '/wat/'), 'warc.gz', 'warc.wat.gz') AS meta_path
        FROM p),
dom AS (SELECT * FROM idx WHERE valid AND
          (lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) = 'example.net'
           OR ends_with(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)),
                        '.example.net')))"""

def _batch(lookups: int) -> str:
    return _with(P_BASE, _rounds(1), RANKED, _index("pg", "url", "text"), f"""
dl AS (SELECT url, sum(tf) AS dl FROM idx GROUP BY url),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qs AS (SELECT DISTINCT p_name AS query_id FROM part),
qt AS (SELECT DISTINCT query_id, term FROM
         (SELECT query_id, unnest(regexp_split_to_array(lower(query_id), '{TOKEN}')) AS term FROM qs)
       WHERE term <> ''),
tp AS (SELECT * FROM idx WHERE term IN (SELECT term FROM qt)),
dft AS (SELECT term, count(*) AS df FROM tp GROUP BY term),
sc AS (SELECT qt.query_id, tp.url,
              sum(ln(1.0 + (CAST(st.n - dft.df AS DOUBLE) + 0.5) / (CAST(dft.df AS DOUBLE) + 0.5))
                  * tp.tf * 2.2 / (tp.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score
       FROM tp JOIN dft ON tp.term = dft.term JOIN qt ON tp.term = qt.term
            JOIN dl ON tp.url = dl.url, st
       GROUP BY qt.query_id, tp.url),
fh AS (SELECT query_id, url FROM
         (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS r
          FROM sc) WHERE r <= {lookups}),
found AS (SELECT fh.query_id, rk.url, {_r6('rk.rank')} AS rank, rk.total_links
          FROM fh JOIN rk ON fh.url = rk.url WHERE {_r6('rk.rank')} > 2.0),
arows AS (SELECT url, rank, total_links FROM found)""")


BATCH = _batch(10000)

BATCH_GRAPH = BATCH + f""",
seeds AS (SELECT * FROM
            (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, url) - 1
                      AS seed_idx, url, rank, total_links FROM found)
          WHERE seed_idx < {C.GRAPH_BUDGET // 10}),
dlinks AS (SELECT s.query_id, s.seed_idx, lk.link,
                  min(struct_pack(o := lk.l_orderkey, n := lk.l_linenumber, s := lk.l_suppkey))
                    AS first_pos
           FROM lk JOIN seeds s ON lk.url = s.url GROUP BY s.query_id, s.seed_idx, lk.link),
sedges AS (SELECT d.query_id, CAST(d.seed_idx AS BIGINT) AS source,
                  CAST(s.seed_idx AS BIGINT) AS target, 1 AS value
           FROM dlinks d JOIN seeds s ON d.query_id = s.query_id AND d.link = s.url),
ne AS (SELECT query_id, source AS seed_idx, count(*) AS n_edges FROM sedges GROUP BY 1, 2),
ordered AS (SELECT d.query_id, d.seed_idx, d.link,
                   row_number() OVER (PARTITION BY d.query_id, d.seed_idx
                                      ORDER BY d.first_pos, d.link) AS k
            FROM dlinks d),
keep AS (SELECT o.* FROM ordered o
         LEFT JOIN ne ON o.query_id = ne.query_id AND o.seed_idx = ne.seed_idx
         WHERE o.k <= 10 - coalesce(ne.n_edges, 0)),
cnt AS (SELECT query_id, seed_idx, count(*) AS c FROM keep GROUP BY 1, 2),
nseeds AS (SELECT query_id, count(*) AS n FROM seeds GROUP BY 1),
offs AS (SELECT cnt.query_id, cnt.seed_idx,
                nseeds.n + coalesce(sum(c) OVER (PARTITION BY cnt.query_id ORDER BY cnt.seed_idx
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM cnt JOIN nseeds ON cnt.query_id = nseeds.query_id),
nbrs AS (SELECT keep.query_id, CAST(offs.off + keep.k - 1 AS BIGINT) AS node_id,
                keep.seed_idx, keep.link
         FROM keep JOIN offs ON keep.query_id = offs.query_id AND keep.seed_idx = offs.seed_idx),
bnodes AS (SELECT query_id, CAST(seed_idx AS BIGINT) AS node_id, url AS name, 0 AS "group",
                  rank, total_links FROM seeds
           UNION ALL
           SELECT query_id, node_id, link AS name,
                  CAST(CASE WHEN seed_idx % 20 = 0 THEN 19 ELSE seed_idx % 20 END AS INTEGER),
                  CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM nbrs),
bedges AS (SELECT query_id, source, target, value FROM sedges
           UNION ALL
           SELECT query_id, node_id AS source, CAST(seed_idx AS BIGINT) AS target, 4 AS value
           FROM nbrs)"""

SQL.update({
    "phrase_index": SQL["doc_phrase"],
    "batch_best": _with(_index("documents", "doc_id", "text"), f"""
dl AS (SELECT url, sum(tf) AS dl FROM idx GROUP BY url), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '{TOKEN}')) AS term FROM benchmark),
dft AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
sc AS (SELECT qt.query_id, idx.url, sum(ln(1.0 + (CAST(st.n - dft.df AS DOUBLE) + 0.5) / (CAST(dft.df AS DOUBLE) + 0.5))
    * idx.tf * 2.2 / (idx.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score
  FROM idx JOIN dft USING (term) JOIN qt USING (term) JOIN dl ON dl.url = idx.url, st GROUP BY qt.query_id, idx.url)""") + f"""
SELECT query_id, url, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS INTEGER) AS rank
FROM (SELECT query_id, url, {_r6("score")} AS score FROM sc) QUALIFY rank <= {C.TOP_N}""",
    "pages_json_roundtrip": f"""SELECT url,
       CAST(len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1),
                            lambda x: starts_with(x, '/'))) AS INTEGER) AS n_links,
       CAST(length(regexp_replace(regexp_replace(html, '{TAG}', '', 'g'), '{NON_ASCII}', '', 'g'))
            AS BIGINT) AS n_chars
FROM pages""",
    "archive_roundtrip": f"""SELECT url,
       CAST(len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1),
                            lambda x: starts_with(x, '/'))) AS INTEGER) AS n_links,
       CAST(length(regexp_replace(regexp_replace(html, '{TAG}', '', 'g'), '{NON_ASCII}', '', 'g'))
            AS BIGINT) AS n_chars
FROM pages WHERE strpos(url, '{C.ARCHIVE_DESCRIPTOR}') > 0""",
    "served_table": SQL["search_table"],
    "served_graph_nodes": SQL["graph_nodes"],
    "served_graph_edges": SQL["graph_edges"],
    "batch_graph_nodes": BATCH_GRAPH
    + ' SELECT query_id, node_id, name, "group", rank, total_links FROM bnodes',
    "batch_graph_edges": BATCH_GRAPH + " SELECT query_id, source, target, value FROM bedges",
    "page_captures": r"""WITH a AS (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url,
         len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1),
                         lambda x: starts_with(x, '/'))) AS n_links
  FROM pages)
SELECT url, arg_min(page_id, (-n_links, page_id)) AS page_id,
       CAST(max(n_links) AS INTEGER) AS n_links
FROM a GROUP BY url""",
    "doc_hit_share": DOC_INDEX + f""",
h AS (SELECT count(DISTINCT url) AS hits FROM idx WHERE term IN ({_terms(C.DOC_PHRASE)})),
b AS (SELECT count(DISTINCT url) AS base_hits FROM idx WHERE term IN ({_terms(C.DOC_BASE_TERM)}))
SELECT hits, base_hits, 100.0 * hits / base_hits AS pct,
       '"{C.DOC_PHRASE}" in ' || substr(CAST(100.0 * hits / base_hits AS VARCHAR), 1, 5)
       || '% of wikipedia pages' AS caption
FROM h, b""",
    "index_records": INDEX_LINES
    + " SELECT urlkey, url, filename, valid, text_path, meta_path FROM idx",
    "index_archive_paths": INDEX_LINES
    + " SELECT DISTINCT filename AS path, text_path, meta_path FROM dom",
    "ingest_manifest": INDEX_LINES + """,
paths AS (SELECT DISTINCT unnest([filename, meta_path]) AS source_file FROM idx WHERE valid),
cnt AS (SELECT filename AS source_file, count(*) AS n FROM dom GROUP BY filename)
SELECT paths.source_file,
       CASE WHEN coalesce(cnt.n, 0) > 0 THEN 'uploaded' ELSE 'NOTuploaded' END AS status,
       coalesce(cnt.n, 0) AS n_records
FROM paths LEFT JOIN cnt ON paths.source_file = cnt.source_file""",
    "records_per_file": INDEX_LINES
    + " SELECT filename AS source_file, count(*) AS n_records FROM idx WHERE valid GROUP BY filename",
    "index_page": f"""SELECT page_id, url, row_idx FROM
  (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS row_idx FROM pages)
WHERE row_idx >= {C.PAGE_NO * C.PAGE_SIZE} AND row_idx < {(C.PAGE_NO + 1) * C.PAGE_SIZE}""",
    "index_page_count": f"""SELECT count(*) AS n_rows,
       CAST(ceil(count(*) / {float(C.PAGE_SIZE)}) AS BIGINT) AS n_pages FROM pages""",
    "cluster_labels": BATCH + _lloyd(C.LLOYD_ROUNDS) + " SELECT url, total_links, rank, label FROM lab",
    "cluster_centroids": BATCH + _lloyd(C.LLOYD_ROUNDS) + f""" SELECT label, count(*) AS n, {_r6("avg(total_links)")} AS total_links, {_r6("avg(rank)")} AS rank
FROM lab GROUP BY label""",
    "quarantined": """WITH p AS (SELECT page_id % 7 = 0 AS a, page_id % 9 = 0 AS b, page_id % 11 = 0 AS c FROM pages),
k AS (SELECT 'pages' AS kind, CASE WHEN a THEN 'not JSON' WHEN b THEN 'no url' END AS reason FROM p
  UNION ALL SELECT 'index', CASE WHEN a THEN 'not JSON' WHEN b THEN 'no filename' END FROM p
  UNION ALL SELECT 'text', CASE WHEN c THEN 'cut short' END FROM p
  UNION ALL SELECT 'metadata', CASE WHEN c THEN 'cut short' WHEN a THEN 'not JSON' END FROM p)
SELECT kind, reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY ALL""",
    "archive_stitched": """WITH p AS (SELECT url, html || chr(13) || chr(10) || chr(13) || chr(10) || 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Target-URI: fake'
  || chr(13) || chr(10) || 'Content-Length: 3' || chr(13) || chr(10) || chr(13) || chr(10) || 'abc' || chr(13) || chr(10) || chr(13) || chr(10)
  || 'WARC/1.0' || chr(13) || chr(10) || 'end' AS payload FROM pages)
SELECT url, true AS length_ok, CAST(strlen(payload) AS BIGINT) AS n_bytes, md5(payload) AS digest FROM p""",
    "listing_pages": f"""WITH n AS (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS row_idx FROM pages),
b AS (SELECT count(*) AS n_below FROM pages WHERE url < '{C.PREFIX_PATTERN}'),
k AS (SELECT 'first' AS kind, 0 AS p UNION ALL SELECT 'second', 1 UNION ALL SELECT 'prefix', n_below // {C.PAGE_SIZE} FROM b)
SELECT n.*, kind, n_below AS prefix_row FROM n JOIN k ON n.row_idx // {C.PAGE_SIZE} = k.p, b""",
    "store_lookup": _with(P_BASE, _rounds(1), RANKED) + f""" SELECT url, {_r6('rank')} AS rank, total_links
FROM rk JOIN part ON p_partkey = url WHERE p_size = {C.LOOKUP_SIZE}""",
    "batch_search": BATCH + " SELECT query_id, url, rank, total_links FROM found",
    "batch_tables": BATCH + """ SELECT query_id, url, rank, total_links FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, url) AS r FROM found)
WHERE r <= 100""",
    "upsert_ranks": _with(P_BASE, _rounds(2), f"""
o AS (SELECT r1.url, {_r6('r1.rank')} AS rank FROM r1 JOIN pg ON r1.url = pg.url),
n AS (SELECT r2.url, {_r6('r2.rank')} AS rank FROM r2 JOIN pg ON r2.url = pg.url)""")
    + " SELECT url, rank FROM o WHERE url NOT IN (SELECT url FROM n)"
      " UNION ALL SELECT url, rank FROM n",
    "limited_analysis": _request(C.LIMITED["analysis_lookups"], C.LIMITED["budget"]) + " SELECT url, rank, total_links FROM found",
    "limited_table": LIMITED + f" SELECT url, rank, total_links FROM found ORDER BY rank DESC, url LIMIT {C.LIMITED['rows']}",
    "limited_nodes": LIMITED + ' SELECT node_id, name, "group", rank, total_links FROM nodes',
    "limited_edges": LIMITED + " SELECT source, target, value FROM edges",
    "limited_batch_tables": _batch(C.LIMITED["batch_lookups"]) + f""" SELECT query_id, url, rank, total_links FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, url) AS r FROM found)
WHERE r <= {C.LIMITED["rows"]}""",
    "preset_seeds": REQUEST + " SELECT preset, row_number() OVER (PARTITION BY preset ORDER BY rank DESC, url) - 1 AS seed_idx, url FROM found, "
    + "(VALUES " + ", ".join(f"('{k}', {v // 10})" for k, v in DENSITY_PRESETS.items()) + ") AS p(preset, n)"
    + " QUALIFY row_number() OVER (PARTITION BY preset ORDER BY rank DESC, url) <= n",
    "document_store": f"""WITH p AS (SELECT page_id AS written, regexp_replace(url, '[?#].*$', '') AS url,
  length(regexp_replace(regexp_replace(html, '{TAG}', '', 'g'), '{NON_ASCII}', '', 'g')) AS n FROM pages)
SELECT url, arg_max(written, (written % 2, written)) AS written, arg_max(n, (written % 2, written)) AS n_chars FROM p GROUP BY url""",
    "ranked_bucket_table": SQL["ranked_pages"],
    "rank_slices_written": SQL["ranked_pages"],
    "rank_lines": _with(P_BASE, _rounds(1), RANKED) + " SELECT url || ' has rank: ' || CAST(round(rank * 1000) AS BIGINT) || '.' AS value FROM rk",
    "ranked_links_export": REQUEST + """, tt AS (SELECT url FROM found ORDER BY rank DESC, url LIMIT 100)
SELECT lk.url, any_value(pg.text) AS plaintext, count(*) AS n_links, CAST(sum(link) AS BIGINT) AS sum_links
FROM lk JOIN tt USING (url) JOIN pg USING (url) GROUP BY lk.url""",
    "graph_written": REQUEST + " SELECT source, target, value FROM edges",
    "saved_analysis": BATCH + " SELECT url, rank, total_links FROM arows",
    "cluster_nearest": BATCH + _nearest() + " SELECT url, total_links, rank, label FROM lab",
    "cluster_means": BATCH + _nearest() + f""" SELECT label, count(*) AS n, {_r6("avg(total_links)")} AS total_links, {_r6("avg(rank)")} AS rank
FROM lab GROUP BY label""",
    "pages_numbered": "SELECT page_id, url, length(html) AS n_chars, row_number() OVER (ORDER BY url, page_id) - 1 AS row_idx FROM pages",
    "paths_with_word": INDEX_LINES + " SELECT DISTINCT filename AS path FROM idx WHERE valid AND contains(filename, 'segment-3')",
    "index_labels": f"""WITH p AS (SELECT page_id, url, {HOST_SQL} AS host FROM pages)
SELECT page_id,
  url_encode(replace(trim(regexp_replace(url, '^(https?:)?//', ''), '/'), '/', '-')) || '-' AS exact_label,
  'prefix-' || url_encode(replace(rtrim(url, '/'), '/', '-')) || '-' AS prefix_label,
  'domain-' || url_encode(host) || '-' AS domain_label,
  lpad(CAST(page_id % 100 AS VARCHAR), 3, '0') AS page_label FROM p""",
    "dirty_lines": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN
  len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: starts_with(x, '/'))) END AS n FROM pages)
SELECT count(*) FILTER (page_id % 7 <> 0 AND n IS NOT NULL) AS n_pages, CAST(sum(n) FILTER (page_id % 7 <> 0) AS BIGINT) AS n_links,
  count(*) FILTER (page_id % 7 = 0) AS n_rejected FROM p""",
    "escaped_text": f"""SELECT page_id, regexp_replace(chr(10) || url || 'A' || regexp_replace(replace(html, '<p>', '<p>A' || chr(9)), '{TAG}', '', 'g'),
       '{NON_ASCII}', '', 'g') AS plaintext FROM pages""",
    "scatter_points": BATCH + f""" SELECT url, total_links, rank, {_r6('log10(rank)')} AS log_rank
FROM arows WHERE total_links BETWEEN 2 AND 500 AND rank BETWEEN 2 AND 500""",
})
