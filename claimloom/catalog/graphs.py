"""Graph, discovery and snowball queries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import graph as G
from ..operators.citations import citation_pairs
from ..plans import bindings as B
from ..plans.lineage import stage
from .ctes import with_ctes


def _pairs(t):
    return citation_pairs(*B.edge_sets(t))


def _plain(edges):
    return edges.select(
        "citing_work_id", "cited_work_id", F.array_join("sources", ",").alias("sources"), "is_influential"
    )


def paper_graph(t):
    nodes, _ = G.first_papers(B.order_works(t), 500)
    return _plain(G.induced_edges(nodes, _pairs(t)))


def paper_graph_nodes(t):
    nodes, truncated = G.first_papers(B.order_works(t), 500)
    counted = G.paper_nodes(nodes, _pairs(t))
    return counted.select(
        "work_id", "title", "year", "cited_by_count", "reference_count", truncated.scalar().alias("truncated")
    )


def induced_graph(t):
    """Citation graph of the retracted works."""
    return _plain(G.induced_edges(B.order_works(t).filter("is_retracted"), _pairs(t)))


def graph_envelope(t):
    works = B.order_works(t)
    pairs = _pairs(t)
    nodes, edges = G.paper_envelope(G.citation_degrees(works, pairs), pairs)
    rows = nodes.select("id", "type", "label", F.lit(None).cast("string").alias("source"), F.to_json("data").alias("data"))
    return rows.unionByName(
        edges.select(
            "id", "type", F.col("target").alias("label"), "source",
            F.concat(F.lit("sources="), F.array_join("data.sources", ",")).alias("data"),
        )
    )


def author_edges(t):
    return G.author_edges(B.order_works(t), B.authorships(t))


def claim_network(t):
    return G.claim_network(B.line_relations(t), B.line_interpretations(t))


def claim_network_limited(t):
    return G.claim_network(B.line_relations(t), B.line_interpretations(t), 500)


def one_hop_trace(t):
    claims = B.line_interpretations(t)
    return G.one_hop_trace(claims, B.line_relations(t), claims, B.all_works(t), B.line_passages(t)).withColumn(
        "target_link_score", F.bround("target_link_score", 3)
    )


def _centers(t):
    """The first order of every venue."""
    return B.order_works(t).groupBy("venue").agg(F.min("work_id").alias("work_id")).select("work_id")


#: Works shown around one center; the cut is the feature, and is flagged.
_NEIGHBORHOOD = 250


def neighborhood_k2(t):
    return G.neighborhoods(_centers(t), _pairs(t), 2, _NEIGHBORHOOD)


def _staged_pairs(t):
    """The pairs of citing and cited works, made once for queries that read them several times."""
    return stage(_pairs(t).select("citing_work_id", "cited_work_id"), "pairs")


def neighborhood_edges(t):
    pairs = _staged_pairs(t)
    nodes = G.neighborhoods(_centers(t), pairs, 1, _NEIGHBORHOOD)
    return G.neighborhood_edges(nodes, pairs).groupBy("center").agg(F.count("*").alias("edges"))


def _links(t):
    """Reference lists with positions by (type of id, id)."""
    from pyspark.sql import Window

    order = Window.partitionBy("citing_work_id").orderBy("cited_title")
    return B.reference_links(t).withColumn("position", F.row_number().over(order))


def _identified(t):
    """Orders of even number are in the corpus, each with its identifiers."""
    return t.orders.selectExpr(
        "concat('O', o_orderkey) as work_id",
        "case when o_orderkey % 3 <> 0 then cast(o_orderkey as string) end as s2_corpus_id",
        "concat('10.5555/o', o_orderkey) as doi",
        "cast(o_orderkey as string) as pmid",
        "case when o_orderkey % 7 <> 0 then concat('Local ', o_orderkey) end as title",
        "cast(year(o_orderdate) as int) as year",
    )


def _seed_sets(t):
    """Per customer, its orders that are not pending."""
    return t.orders.filter("o_orderstatus <> 'P'").selectExpr("concat('M', o_custkey) as set_id", "concat('O', o_orderkey) as work_id")


def _discovered(t):
    local = _identified(t).filter("year <> 1997")
    return D.discover(_seed_sets(t), local, _links(t), min_year=1996)


def seed_discovery(t):
    return D.top_candidates(_discovered(t), 3).select(
        "set_id", "work_id", "external_id", "title", "year", "connection_score", "is_influential", "in_corpus", "rank"
    )


def discovery_supporting_seeds(t):
    local = _identified(t)
    return D.supporting_seeds(_seed_sets(t), local, _links(t)).groupBy("set_id", "key").agg(
        F.count("*").alias("seeds"), F.min("seed_work_id").alias("first_seed")
    )


#: Works wanted per seed; the size of the corpus is the feature.
_WORKS_PER_SEED = 2


def _snowball(t):
    """From the retracted orders that nothing cites, in the order of their numbers."""
    pairs = _staged_pairs(t)
    cited = pairs.select(F.col("cited_work_id").alias("work_id"))
    roots = B.order_works(t).filter("is_retracted").join(cited, "work_id", "left_anti")
    seeds = stage(roots.select("work_id", F.substr("work_id", F.lit(2)).cast("long").alias("position")), "seeds")
    links = pairs.select("citing_work_id", "cited_work_id", F.col("cited_work_id").alias("position"))
    return G.snowball(seeds, links, _WORKS_PER_SEED * seeds.count())


def snowball(t):
    return _snowball(t)[0]


def snowball_edges(t):
    return _snowball(t)[1]


def corpus_manifest(t):
    from ..sources.sinks import corpus_manifest as manifest

    return manifest(_snowball(t)[0], _identified(t))


_KG_TERMS = ("p_name", "p_brand", "p_type")


def _terms(t):
    """Each line claims a part name (intervention), brand (comparator) and type (outcome)."""
    rows = B.keyed_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    pairs = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(c).alias("term"))
            for role, c in zip(("intervention", "comparator", "outcome"), _KG_TERMS)
        ]
    )
    return rows.select(F.concat(F.lit("I"), "k").alias("interpretation_id"), F.explode(pairs).alias("t")).select(
        "interpretation_id", "t.*"
    )


def _lexicon(t):
    """Names and types are known entities, and brands with an even number."""
    terms = t.part.select(F.explode(F.array(*_KG_TERMS)).alias("term")).distinct()
    known = ~F.col("term").startswith("Brand#") | F.col("term").rlike("[02468]$")
    return terms.filter(known).select(
        "term",
        F.concat(F.lit("X:"), F.upper("term")).alias("curie"),
        F.col("term").alias("label"),
        F.array(F.lit("entity")).alias("types"),
    )


def _kg(t):
    """Part name affects part type, with sources."""
    return t.part.selectExpr(
        "concat('X:', upper(p_name)) as subject",
        "concat('X:', upper(p_type)) as object",
        "case when p_size % 3 = 0 then null else 'biolink:affects_level_of' end as predicate",
    ).distinct().selectExpr(
        "*",
        "array(named_struct('resource_role', 'primary_knowledge_source', 'resource_id', 'infores:a'), "
        "named_struct('resource_role', 'aggregator_knowledge_source', 'resource_id', 'infores:b')) as sources",
    )


def entity_grounding(t):
    return G.ground_terms(_terms(t), _lexicon(t)).groupBy("role").agg(
        F.count("*").alias("terms"), F.count("curie").alias("resolved"), F.count_distinct("curie").alias("entities")
    )


def entity_kg_edges(t):
    grounded = G.ground_terms(_terms(t), _lexicon(t))
    return G.corroborating_edges(grounded, _kg(t)).select(
        "interpretation_id", "subject", "predicate", "object", "label", "primary_knowledge_source",
        F.array_join("aggregator_knowledge_source", ",").alias("aggregators"),
    )


def grounding_replace(t):
    """Claims of returned lines are grounded again; the others keep their rows."""
    stored = _terms(t).withColumns(
        {"curie": F.lit("old"), "grounding_source": F.when(F.col("role") == "outcome", "manual").otherwise("kg")}
    )
    fresh = G.ground_terms(_terms(t).filter("interpretation_id like '%-R-%'"), _lexicon(t)).select(
        "interpretation_id", "role", "term", "curie"
    )
    out = G.replace_groundings(stored, fresh, "kg")
    return out.groupBy("grounding_source", "role").agg(
        F.count("*").alias("n"), F.count_if(F.col("curie") == "old").alias("old")
    )


_SQL_DISCOVER = """, wl AS (SELECT *, row_number() OVER (PARTITION BY citing_work_id ORDER BY cited_title) AS position FROM links),
   seeds AS (SELECT 'M' || o_custkey AS set_id, 'O' || o_orderkey AS work_id, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
   seed_ids AS (SELECT DISTINCT set_id, v FROM (
       SELECT set_id, unnest([{corpus}, '10.5555/o' || o_orderkey, o_orderkey::VARCHAR]) AS v FROM seeds {where})
       WHERE v IS NOT NULL),
   sl AS (SELECT set_id, wl.*, CASE WHEN cited_corpus_id IS NOT NULL THEN 'cited_corpus_id:' || cited_corpus_id
              WHEN cited_doi IS NOT NULL THEN 'cited_doi:' || cited_doi
              WHEN cited_pmid IS NOT NULL THEN 'cited_pmid:' || cited_pmid END AS key
          FROM seeds JOIN wl ON citing_work_id = work_id
          WHERE NOT EXISTS (SELECT 1 FROM seed_ids s WHERE s.set_id = seeds.set_id AND s.v = cited_corpus_id)
            AND NOT EXISTS (SELECT 1 FROM seed_ids s WHERE s.set_id = seeds.set_id AND s.v = cited_doi)
            AND NOT EXISTS (SELECT 1 FROM seed_ids s WHERE s.set_id = seeds.set_id AND s.v = cited_pmid))"""
_CORPUS = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END"

_SQL_SNOWBALL = f""", l0 AS (SELECT work_id, 0 AS level, row_number() OVER (ORDER BY substring(work_id, 2)::BIGINT) AS ordinal
          FROM order_works WHERE work_id IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'P')
            AND work_id NOT IN (SELECT cited_work_id FROM pairs)),
   n0 AS (SELECT count(*) AS n, {_WORKS_PER_SEED} * count(*) AS target FROM l0),
   w1 AS (SELECT citing_work_id, cited_work_id, ordinal AS po, cited_work_id AS pos FROM pairs JOIN l0 ON citing_work_id = work_id),
   f1 AS (SELECT cited_work_id AS work_id, min((po, pos)) AS pt FROM w1 WHERE cited_work_id NOT IN (SELECT work_id FROM l0) GROUP BY 1),
   l1 AS (SELECT work_id, 1 AS level, (SELECT n FROM n0) + row_number() OVER (ORDER BY pt) AS ordinal, pt FROM f1 QUALIFY ordinal <= (SELECT target FROM n0)),
   w2 AS (SELECT citing_work_id, cited_work_id, ordinal AS po, cited_work_id AS pos FROM pairs JOIN l1 ON citing_work_id = work_id),
   f2 AS (SELECT cited_work_id AS work_id, min((po, pos)) AS pt FROM w2
          WHERE cited_work_id NOT IN (SELECT work_id FROM l0 UNION ALL SELECT work_id FROM l1) GROUP BY 1),
   n1 AS (SELECT (SELECT n FROM n0) + count(*) AS n FROM l1),
   l2 AS (SELECT work_id, 2 AS level, (SELECT n FROM n1) + row_number() OVER (ORDER BY pt) AS ordinal, pt FROM f2 QUALIFY ordinal <= (SELECT target FROM n0)),
   corpus AS (SELECT work_id, level, ordinal FROM l0 UNION ALL SELECT work_id, level, ordinal FROM l1 UNION ALL SELECT work_id, level, ordinal FROM l2)"""

_TERMS_SQL = """, terms AS (SELECT 'I' || k AS interpretation_id, unnest(['intervention', 'comparator', 'outcome']) AS role,
          unnest([p_name, p_brand, p_type]) AS term, l_returnflag FROM lines JOIN part ON l_partkey = p_partkey),
   grounded AS (SELECT *, CASE WHEN NOT starts_with(term, 'Brand#') OR regexp_matches(term, '[02468]$') THEN 'X:' || upper(term) END AS curie FROM terms)"""

ENTRIES = {
    "paper_graph": (
        paper_graph,
        with_ctes(
            "order_works pairs",
            """, n AS (SELECT work_id FROM order_works ORDER BY title NULLS LAST, work_id LIMIT 500)
               SELECT * FROM pairs WHERE citing_work_id IN (SELECT * FROM n) AND cited_work_id IN (SELECT * FROM n)""",
        ),
    ),
    "paper_graph_nodes": (
        paper_graph_nodes,
        with_ctes(
            "order_works pairs",
            """, n AS (SELECT * FROM order_works ORDER BY title NULLS LAST, work_id LIMIT 500)
               SELECT work_id, title, year, (SELECT count(*) FROM pairs WHERE cited_work_id = work_id) AS cited_by_count,
                 (SELECT count(*) FROM pairs WHERE citing_work_id = work_id) AS reference_count,
                 (SELECT count(*) > 500 FROM order_works) AS truncated FROM n""",
        ),
    ),
    "induced_graph": (
        induced_graph,
        with_ctes(
            "order_works pairs",
            """, n AS (SELECT work_id FROM order_works WHERE is_retracted)
               SELECT * FROM pairs WHERE citing_work_id IN (SELECT * FROM n) AND cited_work_id IN (SELECT * FROM n)""",
        ),
    ),
    "graph_envelope": (
        graph_envelope,
        with_ctes(
            "order_works pairs",
            """SELECT work_id AS id, 'paper' AS type, title AS label, NULL AS source,
                 '{"year":' || year || ',"cited_by_count":' || coalesce(i.n, 0) || ',"reference_count":' || coalesce(o.n, 0) || '}' AS data
               FROM order_works LEFT JOIN (SELECT cited_work_id AS w, count(*) n FROM pairs GROUP BY 1) i ON i.w = work_id
               LEFT JOIN (SELECT citing_work_id AS w, count(*) n FROM pairs GROUP BY 1) o ON o.w = work_id
               UNION ALL SELECT 'cites:' || citing_work_id || '->' || cited_work_id, 'cites', cited_work_id, citing_work_id, 'sources=' || sources FROM pairs""",
        ),
    ),
    "author_edges": (
        author_edges,
        with_ctes(
            "order_works authorships",
            """SELECT DISTINCT 'author_' || substring(sha1(lower(trim(author))), 1, 16) AS author_id, work_id, trim(author) AS label
               FROM authorships JOIN order_works USING (work_id)""",
        ),
    ),
    "claim_network": (
        claim_network,
        with_ctes(
            "relations",
            """SELECT assertion_id, 'I' || substring(citing_occurrence_id, 2) AS source_claim_id,
                 target_interpretation_id AS target_claim_id, function, stance, 'proposed' AS status
               FROM relations WHERE resolution = 'claim_resolved'""",
        ),
    ),
    "claim_network_limited": (
        claim_network_limited,
        with_ctes(
            "relations",
            """, e AS (SELECT assertion_id, 'I' || substring(citing_occurrence_id, 2) AS source_claim_id,
                 target_interpretation_id AS target_claim_id, function, stance, 'proposed' AS status
               FROM relations WHERE resolution = 'claim_resolved'),
               seen AS (SELECT claim, min(assertion_id) AS a FROM (SELECT assertion_id, source_claim_id AS claim FROM e
                        UNION ALL SELECT assertion_id, target_claim_id FROM e) GROUP BY 1 ORDER BY a, claim LIMIT 500)
               SELECT * FROM e WHERE assertion_id <= (SELECT max(a) FROM seen)""",
        ),
    ),
    "one_hop_trace": (
        one_hop_trace,
        with_ctes(
            "interpretations relations passages all_works",
            """SELECT i.interpretation_id, assertion_id, function, stance, resolution,
                 round_even(target_link_score, 3) AS target_link_score, tc.interpretation_id AS target_claim_id,
                 tc.normalized_text AS target_claim_text, w.work_id AS target_work_id, w.title AS target_title,
                 p.section AS evidence_section, p.verbatim_text AS evidence_text, resolution = 'paper_resolved' AS paper_level
               FROM interpretations i JOIN relations r ON citing_occurrence_id = claim_occurrence_id
               LEFT JOIN interpretations tc ON resolution = 'claim_resolved' AND tc.interpretation_id = target_interpretation_id
               LEFT JOIN all_works w ON w.work_id = cited_work_id LEFT JOIN passages p ON passage_id = evidence_passage_id""",
        ),
    ),
    "neighborhood_k2": (
        neighborhood_k2,
        with_ctes(
            "order_works pairs",
            """, c AS (SELECT min(work_id) AS center FROM order_works GROUP BY venue),
               adj AS (SELECT citing_work_id AS src, cited_work_id AS dst FROM pairs UNION SELECT cited_work_id, citing_work_id FROM pairs),
               h1 AS (SELECT center, dst AS node, row_number() OVER (PARTITION BY center ORDER BY dst) AS rn
                      FROM c JOIN adj ON src = center),
               k1 AS (SELECT center, node FROM h1 WHERE rn <= 249),
               cut1 AS (SELECT DISTINCT center FROM h1 WHERE rn > 249),
               v1 AS (SELECT center, center AS node, 0 AS hop FROM c UNION ALL SELECT center, node, 1 FROM k1),
               room AS (SELECT center, 250 - count(*) AS room FROM v1 GROUP BY 1),
               h2 AS (SELECT center, node, row_number() OVER (PARTITION BY center ORDER BY node) AS rn FROM (
                        SELECT DISTINCT k1.center, dst AS node FROM k1 JOIN adj ON src = k1.node
                        WHERE k1.center NOT IN (SELECT center FROM cut1)) x
                      WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.center = x.center AND v1.node = x.node)),
               cut2 AS (SELECT DISTINCT center FROM h2 JOIN room USING (center) WHERE rn > room)
               SELECT a.center, node AS work_id, hop,
                 a.center IN (SELECT center FROM cut1) OR a.center IN (SELECT center FROM cut2) AS truncated
               FROM (SELECT * FROM v1 UNION ALL SELECT h2.center, node, 2 FROM h2 JOIN room USING (center) WHERE rn <= room) a""",
        ),
    ),
    "neighborhood_edges": (
        neighborhood_edges,
        with_ctes(
            "order_works pairs",
            """, c AS (SELECT min(work_id) AS center FROM order_works GROUP BY venue),
               adj AS (SELECT citing_work_id AS src, cited_work_id AS dst FROM pairs UNION SELECT cited_work_id, citing_work_id FROM pairs),
               h1 AS (SELECT center, dst AS node, row_number() OVER (PARTITION BY center ORDER BY dst) AS rn FROM c JOIN adj ON src = center),
               v AS (SELECT center, center AS node FROM c UNION ALL SELECT center, node FROM h1 WHERE rn <= 249)
               SELECT a.center, count(*) AS edges FROM pairs JOIN v a ON a.node = citing_work_id
               JOIN v b ON b.center = a.center AND b.node = cited_work_id GROUP BY 1""",
        ),
    ),
    "seed_discovery": (
        seed_discovery,
        with_ctes(
            "links",
            _SQL_DISCOVER.format(corpus=_CORPUS, where="JOIN orders USING (o_orderkey) WHERE year(o_orderdate) <> 1997")
            + """, cand AS (SELECT set_id, key, count(DISTINCT citing_work_id) AS connection_score, bool_or(is_influential) AS is_influential,
                   arg_min({'c': cited_corpus_id, 'd': cited_doi, 'p': cited_pmid}, (citing_work_id, position)) AS ids,
                   arg_min(cited_title, (citing_work_id, position)) AS lt,
                   arg_min(cited_year, (citing_work_id, position)) FILTER (cited_year IS NOT NULL) AS ly
                 FROM sl WHERE key IS NOT NULL GROUP BY 1, 2),
               full_c AS (SELECT cand.*, o.o_orderkey, o_orderkey IS NOT NULL AS in_corpus, coalesce(ly, year(o_orderdate)) AS year,
                   coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN 'Local ' || o_orderkey END, lt) AS title
                 FROM cand LEFT JOIN orders o ON year(o_orderdate) <> 1997 AND o.o_orderkey = CASE
                   WHEN ids.c IS NOT NULL THEN ids.c::BIGINT WHEN ids.d IS NOT NULL THEN substring(ids.d, 10)::BIGINT ELSE ids.p::BIGINT END),
               ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY connection_score DESC, is_influential DESC,
                                    lower(coalesce(title, '')), key) AS rank
                 FROM full_c WHERE year IS NULL OR year >= 1996)
               SELECT set_id, 'O' || o_orderkey AS work_id, coalesce('CorpusId:' || ids.c, 'DOI:' || ids.d, 'PMID:' || ids.p) AS external_id,
                 title, year, connection_score, is_influential, in_corpus, rank FROM ranked WHERE rank <= 3""",
        ),
    ),
    "discovery_supporting_seeds": (
        discovery_supporting_seeds,
        with_ctes(
            "links",
            _SQL_DISCOVER.format(corpus=_CORPUS, where="")
            + """ SELECT set_id, key, count(DISTINCT citing_work_id) AS seeds, min(citing_work_id) AS first_seed
               FROM sl WHERE key IS NOT NULL GROUP BY 1, 2""",
        ),
    ),
    "snowball": (snowball, with_ctes("order_works pairs", _SQL_SNOWBALL + " SELECT * FROM corpus")),
    "snowball_edges": (
        snowball_edges,
        with_ctes(
            "order_works pairs",
            _SQL_SNOWBALL
            + """, done1 AS (SELECT n >= (SELECT target FROM n0) AS d FROM n1)
               SELECT DISTINCT citing_work_id, cited_work_id FROM w1
                 WHERE NOT (SELECT d FROM done1) OR (po, pos) <= (SELECT max(pt) FROM l1)
               UNION SELECT DISTINCT citing_work_id, cited_work_id FROM w2
                 WHERE NOT (SELECT d FROM done1) AND (po, pos) <= (SELECT max(pt) FROM l2)""",
        ),
    ),
    "corpus_manifest": (
        corpus_manifest,
        with_ctes(
            "order_works pairs",
            _SQL_SNOWBALL
            + f""" SELECT work_id, {_CORPUS} AS s2_corpus_id, '10.5555/o' || o_orderkey AS doi, o_orderkey::VARCHAR AS pmid,
                 CASE WHEN o_orderkey % 7 <> 0 THEN 'Local ' || o_orderkey END AS title, year(o_orderdate) AS year, level, ordinal
               FROM corpus JOIN orders ON work_id = 'O' || o_orderkey""",
        ),
    ),
    "entity_grounding": (
        entity_grounding,
        with_ctes(
            "lines",
            _TERMS_SQL
            + " SELECT role, count(*) AS terms, count(curie) AS resolved, count(DISTINCT curie) AS entities FROM grounded GROUP BY 1",
        ),
    ),
    "entity_kg_edges": (
        entity_kg_edges,
        with_ctes(
            "lines",
            """, kg AS (SELECT DISTINCT 'X:' || upper(p_name) AS subject, 'X:' || upper(p_type) AS object,
                   CASE WHEN p_size % 3 = 0 THEN 'biolink:related_to' ELSE 'biolink:affects_level_of' END AS predicate FROM part)
               SELECT 'I' || k AS interpretation_id, subject, predicate, object,
                 replace(split_part(predicate, ':', 2), '_', ' ') AS label, 'infores:a' AS primary_knowledge_source, 'infores:b' AS aggregators
               FROM lines JOIN part ON l_partkey = p_partkey JOIN kg ON subject = 'X:' || upper(p_name) AND object = 'X:' || upper(p_type)""",
        ),
    ),
    "grounding_replace": (
        grounding_replace,
        with_ctes(
            "lines",
            _TERMS_SQL
            + """, s AS (SELECT CASE WHEN role = 'outcome' THEN 'manual' ELSE 'kg' END AS grounding_source, role, true AS old, l_returnflag FROM grounded)
               SELECT grounding_source, role, count(*) AS n, count(*) FILTER (old) AS old FROM (
                 SELECT grounding_source, role, old FROM s WHERE NOT (grounding_source = 'kg' AND l_returnflag = 'R')
                 UNION ALL SELECT 'kg', role, false FROM grounded WHERE l_returnflag = 'R') GROUP BY 1, 2""",
        ),
    ),
}
