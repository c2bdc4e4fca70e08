"""The bindings as DuckDB common table expressions, shared by the oracle queries."""

from __future__ import annotations

from ..plans.bindings import NATION_COUNTRIES

_COUNTRY_LIST = "[" + ", ".join(f"'{c}'" for c in NATION_COUNTRIES) + "]"
_SECTION = "['Introduction', 'Methods', 'Results', 'Discussion', NULL][l_linenumber % 5 + 1]"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "order_works": (
        """SELECT 'O' || o_orderkey AS work_id, 'Order ' || o_orderkey AS title,
                  n_name || '/' || c_mktsegment AS venue, year(o_orderdate) AS year,
                  '10.5555/o' || o_orderkey AS doi, o_orderstatus = 'P' AS is_retracted
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
        (),
    ),
    "part_works": (
        """SELECT 'P' || p_partkey AS work_id, p_name AS title, NULL::VARCHAR AS venue, NULL::BIGINT AS year,
                  '10.5555/p' || p_partkey AS doi, p_size = 13 AS is_retracted FROM part""",
        (),
    ),
    "all_works": ("SELECT * FROM order_works UNION ALL SELECT * FROM part_works", ("order_works", "part_works")),
    "authorships": (
        "SELECT 'O' || l_orderkey AS work_id, s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        (),
    ),
    "affiliations": (
        f"""SELECT 'O' || l_orderkey AS work_id,
                   'Dept ' || s_suppkey || ', Univ ' || s_nationkey || ', ' || {_COUNTRY_LIST}[s_nationkey % 25 + 1] AS affiliation
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
        (),
    ),
    "extracted": (
        """SELECT DISTINCT 'O' || l.l_orderkey AS citing_work_id, 'O' || f.first_order AS cited_work_id,
                  'extracted' AS source, NULL::BOOLEAN AS is_influential
           FROM lineitem l JOIN (
               SELECT l_partkey, arg_min(l_orderkey, (epoch_us(o_orderdate), l_orderkey)) AS first_order
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) f USING (l_partkey)
           WHERE l.l_orderkey <> f.first_order""",
        (),
    ),
    "bibliographic": (
        """SELECT 'O' || o.o_orderkey AS citing_work_id, 'O' || a.anchor AS cited_work_id,
                  'bibliographic' AS source,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN true WHEN o_orderpriority = '5-LOW' THEN NULL
                       ELSE false END AS is_influential
           FROM orders o JOIN (
               SELECT o_custkey, year(o_orderdate) AS y,
                      arg_min(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS anchor
               FROM orders GROUP BY 1, 2) a
             ON a.o_custkey = o.o_custkey AND year(o.o_orderdate) - a.y BETWEEN 0 AND 2
           WHERE o.o_orderkey <> a.anchor""",
        (),
    ),
    "edges": ("SELECT * FROM extracted UNION ALL SELECT * FROM bibliographic", ("extracted", "bibliographic")),
    "pairs": (
        """SELECT citing_work_id, cited_work_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
                  bool_or(is_influential) AS is_influential
           FROM edges GROUP BY 1, 2""",
        ("edges",),
    ),
    "degrees": (
        "SELECT cited_work_id AS work_id, count(*) AS citation_count FROM pairs GROUP BY 1",
        ("pairs",),
    ),
    "links": (
        """SELECT citing_work_id,
                  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS cited_corpus_id,
                  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '10.5555/o' || o_orderkey END AS cited_doi,
                  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN o_orderkey::VARCHAR END AS cited_pmid,
                  'Order ' || o_orderkey AS cited_title,
                  CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate) END AS cited_year,
                  coalesce(is_influential, false) AS is_influential
           FROM bibliographic JOIN orders ON cited_work_id = 'O' || o_orderkey""",
        ("bibliographic",),
    ),
    "lines": (
        """SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity)::BIGINT,
                    round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT,
                    round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS k
           FROM lineitem""",
        (),
    ),
    "versions": ("SELECT 'V' || o_orderkey AS version_id, 'O' || o_orderkey AS work_id FROM orders", ()),
    "passages": (
        f"""SELECT 'G' || k AS passage_id, 'V' || l_orderkey AS paper_version_id, {_SECTION} AS section,
                   'ordered ' || l_quantity::INT || ' of part ' || l_partkey AS verbatim_text
            FROM lines""",
        ("lines",),
    ),
    "occurrences": (
        """SELECT 'C' || k AS occurrence_id, 'G' || k AS passage_id,
                  CASE WHEN l_linenumber % 2 = 0 THEN 'reported_result' ELSE 'background_assertion' END AS occurrence_type
           FROM lines""",
        ("lines",),
    ),
    "interpretations": (
        """SELECT 'I' || k AS interpretation_id, 'C' || k AS claim_occurrence_id, p_name || ' ' || p_type AS normalized_text,
                  ['definite', 'probable', 'possible', 'speculative', 'other'][l_linenumber % 5 + 1] AS certainty
           FROM lines JOIN part ON l_partkey = p_partkey""",
        ("lines",),
    ),
    "relations": (
        f"""SELECT 'R' || k AS assertion_id, 'C' || k AS citing_occurrence_id, 'G' || k AS evidence_passage_id,
                   'O' || l_orderkey AS citing_work_id,
                   CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN NULL ELSE 'P' || l_partkey END AS cited_work_id,
                   CASE WHEN l_linestatus = 'F' THEN 'I' || target_k END AS target_interpretation_id,
                   CASE WHEN l_discount = 0 THEN NULL ELSE
                        ['background', 'method', 'direct_evidence', 'comparison'][l_linenumber % 4 + 1] END AS function,
                   CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'support'
                        WHEN l_returnflag = 'R' THEN 'contradict' ELSE 'neutral' END AS stance,
                   CASE WHEN l_linestatus = 'F' THEN 'claim_resolved' ELSE 'paper_resolved' END AS resolution,
                   CASE WHEN l_tax > 0.02 THEN l_tax * 10 END AS target_link_score,
                   greatest(l_discount * 10, l_tax * 10, 0.25) AS stance_confidence,
                   {_SECTION} AS section, l_shipdate AS stated_at
            FROM lines JOIN (SELECT l_partkey, min(k) AS target_k FROM lines GROUP BY 1) USING (l_partkey)""",
        ("lines",),
    ),
    "statements": (
        """SELECT s.*, year(o_orderdate) AS year FROM (
               SELECT r.*, cited_work_id AS subject_id FROM relations r WHERE cited_work_id IS NOT NULL
               UNION
               SELECT r.*, 'O' || l_orderkey AS subject_id
               FROM relations r JOIN lines ON target_interpretation_id = 'I' || k) s
           LEFT JOIN orders ON citing_work_id = 'O' || o_orderkey""",
        ("relations", "lines"),
    ),
    "sets": (
        """SELECT 'collection' AS kind, 'S' || n_nationkey AS set_id, 'U' || n_regionkey AS owner_id, n_name AS name,
                  n_nationkey % 5 <> 0 AS is_watched FROM nation""",
        (),
    ),
    "members": (
        """SELECT DISTINCT 'S' || s_nationkey AS set_id, 'P' || l_partkey AS work_id
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
        (),
    ),
    "revisions": (
        """SELECT 'E' || event_id AS interpretation_id,
                  'U' || user_id || '@' || strftime(ts, '%Y%m%d') AS claim_occurrence_id,
                  CASE WHEN event_type = 'error' AND event_id <> first_id THEN 'E' || first_id END AS parent_id,
                  event_type || ' ' || json_extract_string(props, '$.k') AS normalized_text,
                  ts AS created_at, event_type, value
           FROM (SELECT *, arg_min(event_id, (epoch_us(ts), event_id)) OVER (PARTITION BY user_id, ts::DATE) AS first_id FROM events)""",
        (),
    ),
    "sentences": (
        r"""SELECT 'I' || doc_id || '.' || (p - 1) || '.' || (s - 1) AS interpretation_id, 'D' || doc_id AS work_id,
                   lang AS section, source AS venue, p - 1 AS paragraph, s - 1 AS sentence, txt AS text
            FROM (
              SELECT doc_id, lang, source, p, unnest(parts) AS txt, unnest(generate_series(1, len(parts))) AS s
              FROM (
                SELECT doc_id, lang, source, p, list_filter(string_split(
                         regexp_replace(trim(body, E' \t\n\r\f'), '([.!?])\s+([A-Z(\[])', E'\\1\x01\\2', 'g'), E'\x01'),
                         lambda x: x <> '') AS parts
                FROM (SELECT doc_id, lang, source, unnest(ps) AS body, unnest(generate_series(1, len(ps))) AS p
                      FROM (SELECT *, string_split(text, E'\n') AS ps FROM documents))))""",
        (),
    ),
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` clause for the named expressions (dependencies included) before ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][1]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered)
    extra = body.lstrip()
    if extra.startswith(","):  # further expressions follow
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{extra}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"
