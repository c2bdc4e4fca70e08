"""Identifier, backfill, integrity and member-intake queries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions.values import cosine
from ..operators import resolution as R
from ..plans import bindings as B
from ..sources import sinks, tables
from .ctes import with_ctes

# --- identifiers -----------------------------------------------------------------------------

_RAW = (
    "element_at(array(concat('https://doi.org/10.1234/ABC', o_orderkey, '.'), concat('doi:10.55555/x;', o_orderkey, ';,'), "
    "concat('10.12/', o_orderkey), concat('pmid:', o_orderkey), cast(o_orderkey as string), "
    "cast(1400 + o_orderkey % 800 as string), concat('HTTP://DX.DOI.ORG/10.1000/', o_orderkey, ':'), "
    "concat('  10.99999/Y(', o_orderkey, ') '), concat('PMID 12', o_orderkey), concat('CorpusID:', o_orderkey), "
    "concat('pmc', o_orderkey), 'arxiv:'), cast(o_orderkey % 12 as int) + 1)"
)
_RAW_SQL = (
    "['https://doi.org/10.1234/ABC' || o_orderkey || '.', 'doi:10.55555/x;' || o_orderkey || ';,', '10.12/' || o_orderkey, "
    "'pmid:' || o_orderkey, o_orderkey::VARCHAR, (1400 + o_orderkey % 800)::VARCHAR, 'HTTP://DX.DOI.ORG/10.1000/' || o_orderkey || ':', "
    "'  10.99999/Y(' || o_orderkey || ') ', 'PMID 12' || o_orderkey, 'CorpusID:' || o_orderkey, 'pmc' || o_orderkey, 'arxiv:'][o_orderkey % 12 + 1]"
)


def identifier_normalize(t):
    raw = t.orders.selectExpr("o_orderkey", f"{_RAW} as raw")
    token = F.col("raw")
    return raw.select(
        "o_orderkey",
        I.normalize_doi(token).alias("doi"),
        I.pmid_from_token(token).alias("pmid"),
        I.identifier_kind(token).alias("kind"),
        I.doi_in_text(F.concat(F.lit("see <"), token, F.lit(">."))).alias("doi_in_text"),
        I.normalize_paper_id(token).alias("paper_id"),
        I.normalize_pmcid(token).alias("pmcid"),
    )


def pasted_identifiers(t):
    """Each customer pastes one text naming all raw tokens of one order a line."""
    pasted = t.orders.selectExpr(
        "concat('S', o_orderkey) as set_id", f"concat('Title, ', {_RAW}, '\\n', {_RAW}, ' 2021,x ', o_custkey) as csv_text"
    )
    return R.pasted_identifiers(pasted).select("set_id", "kind", "value", "position")


# --- works with gaps and bulk records ------------------------------------------------------------


def _gappy_works(t):
    return t.orders.selectExpr(
        "concat('O', o_orderkey) as work_id",
        "case when o_orderkey % 3 = 0 then cast(o_orderkey as string) end as s2_corpus_id",
        "case when o_orderkey % 3 = 1 then concat('10.5555/O', o_orderkey) end as doi",
        "case when o_orderkey % 3 = 2 then cast(o_orderkey as string) end as pmid",
        "case when o_orderkey % 4 <> 0 then concat('Held ', o_orderkey) end as title",
        "case when o_orderkey % 6 = 0 then array('Known Person') else cast(array() as array<string>) end as authors",
        "case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then null else o_orderpriority end as venue",
        "case when o_orderkey % 2 = 0 then cast(year(o_orderdate) as int) end as year",
        "cast(null as string) as tldr",
        "case when o_orderkey % 2 = 0 then 'held abstract' end as abstract",
        "case when o_orderkey % 7 = 0 then o_orderstatus = 'F' end as is_retracted",
        "cast(null as string) as integrity_notice",
    )


def _records(t):
    """Two records per order, the second without a venue or title, and unknown papers."""
    base = t.orders.selectExpr(
        "o_orderkey as corpusid",
        "named_struct('DOI', concat('10.5555/o', o_orderkey), 'PubMed', cast(o_orderkey as string)) as externalids",
        "concat('Bulk ', o_orderkey) as title",
        "array(named_struct('authorId', '1', 'name', concat('Author ', o_custkey)), named_struct('authorId', '2', 'name', '')) as authors",
        "case when o_orderkey % 10 = 0 then '' else concat('Venue ', o_custkey % 7) end as venue",
        "cast(year(o_orderdate) as int) as year",
        "o_custkey",
    )
    first = base.selectExpr("format_string('%010d', corpusid * 2) as record_id", "*")
    second = base.selectExpr(
        "format_string('%010d', corpusid * 2 + 1) as record_id",
        "corpusid + 100000000 as corpusid",
        "externalids",
        "cast(null as string) as title",
        "authors",
        "concat('Late ', o_custkey % 7) as venue",
        "1900 as year",
        "o_custkey",
    )
    return first.unionByName(second)


_SHOWN = ["work_id", "s2_corpus_id", "doi", "pmid", "title", "venue", "year"]


def backfill_papers(t):
    out = R.backfill_papers(_gappy_works(t), _records(t))
    return out.select(*_SHOWN, F.array_join("authors", "|").alias("authors"), F.array_join("filled", ",").alias("filled"))


def backfill_report(t):
    return R.fill_report(R.backfill_papers(_gappy_works(t), _records(t)))


def backfill_passes(t):
    """Papers first, then abstracts: corpus ids filled by the first pass match in the second."""
    abstracts = t.orders.selectExpr(
        "format_string('%010d', o_orderkey) as record_id", "o_orderkey as corpusid",
        "case when o_orderkey % 11 <> 0 then concat('Abstract ', o_orderkey) end as abstract",
    )
    tldrs = t.orders.selectExpr(
        "format_string('%010d', o_orderkey) as record_id", "o_orderkey as corpusid", "concat('TLDR ', o_orderpriority) as text"
    )
    works, _ = R.backfill(_gappy_works(t), {"papers": _records(t), "abstracts": abstracts, "tldrs": tldrs})
    return works.select("work_id", "s2_corpus_id", "tldr", "abstract")


def identifier_resolution(t):
    records = _records(t).select("record_id", "corpusid", "externalids")
    keys = {"corpus": F.col("corpusid"), "doi": F.col("externalids.DOI"), "pmid": F.col("externalids.PubMed")}
    return R.resolve(records, "record_id", keys, _gappy_works(t)).select("record_id", "work_id")


def _bulk_citations(t):
    return B.bibliographic_edges(t).selectExpr(
        "cast(substring(citing_work_id, 2) as long) as citingcorpusid",
        "cast(substring(cited_work_id, 2) as long) as citedcorpusid",
        "is_influential as isinfluential",
        "cast(array() as array<string>) as intents",
        "cast(array() as array<string>) as contexts",
    )


def insert_absent_edges(t):
    """Bulk citations between known works that the store does not hold yet."""
    works = _gappy_works(t).filter("s2_corpus_id is not null")
    held = B.bibliographic_edges(t).filter("is_influential").withColumn("source", F.lit("bulk"))
    offered = R.edges_between_known(works, _bulk_citations(t))
    return R.new_edges(held, offered, "bulk").select("citing_work_id", "cited_work_id", "isinfluential", "source")


def enrich_snapshot(t):
    papers = _records(t).filter("title is not null").selectExpr(
        "record_id", "cast(corpusid as string) as corpus_id", "externalids.DOI as doi", "externalids.PubMed as pmid",
        "title", "transform(filter(authors, a -> a.name <> ''), a -> a.name) as authors", "venue", "year",
        "concat('Short ', o_custkey) as tldr", "cast(null as string) as abstract",
    )
    out = R.enrich_from_snapshot(_gappy_works(t), papers)
    return out.select(*_SHOWN, "tldr", F.array_join("filled", ",").alias("filled"))


def _messages(t):
    """Editorial records of two thirds of the orders."""
    return t.orders.filter("o_orderpriority <> '5-LOW'").selectExpr(
        "concat('https://doi.org/10.5555/O', o_orderkey) as doi",
        "case when o_orderstatus = 'F' then array(named_struct('type', 'Correction', 'label', cast(null as string)), "
        "named_struct('type', 'retraction', 'label', 'Retraction')) "
        "when o_orderstatus = 'O' then array(named_struct('type', 'new_thing', 'label', 'ignored')) "
        "else cast(null as array<struct<type:string,label:string>>) end as update_to",
        "array(case when o_orderkey % 10 = 1 then ' Retracted: paper' else 'Paper' end) as title",
    )


def integrity_check(t):
    return R.check_integrity(_gappy_works(t), _messages(t))


def integrity_unchecked(t):
    return R.check_integrity(_gappy_works(t), _messages(t), only_unchecked=True).groupBy("is_retracted", "integrity_notice").agg(
        F.count("*").alias("n"), F.count_if("changed").alias("changed")
    )


def reference_metadata(t):
    """Line mentions of parts, matched to the reference list of their order by DOI or PMID."""
    lines = B.keyed_lines(t)
    mentions = lines.selectExpr(
        "concat('N', k) as mention_id", "concat('O', l_orderkey) as citing_work_id",
        "case when l_tax > 0 then concat('P', l_partkey) end as cited_work_id",
    )
    parts = t.part.selectExpr(
        "concat('P', p_partkey) as work_id", "case when p_partkey % 2 = 0 then concat('10.5555/p', p_partkey) end as doi",
        "cast(p_partkey as string) as pmid", "cast(null as string) as s2_corpus_id",
    )
    links = lines.filter("l_returnflag <> 'R'").selectExpr(
        "concat('O', l_orderkey) as citing_work_id", "k as position",
        "case when l_partkey % 4 = 0 then concat('10.5555/p', l_partkey) end as cited_doi",
        "case when l_partkey % 4 <> 0 then cast(l_partkey as string) end as cited_pmid",
        "cast(null as string) as cited_corpus_id",
        "array(l_linestatus) as intents", "array(k) as contexts", "l_linestatus = 'F' as is_influential",
    )
    return R.attach_reference_metadata(mentions, parts, links).select(
        "mention_id", "provider", F.col("s2_intents")[0].alias("intent"), F.col("contexts")[0].alias("context"), "is_influential"
    )


def _intake(t):
    pasted = t.orders.selectExpr("concat('S', o_custkey % 25) as set_id", f"{_RAW} as csv_text")
    works = t.part.selectExpr(
        "concat('P', p_partkey) as work_id",
        "case when p_partkey % 2 = 0 then concat('10.1234/ABC', p_partkey) end as doi",
        "cast(p_partkey as string) as pmid",
    )
    members = t.part.selectExpr("concat('S', p_partkey % 25) as set_id", "concat('P', p_partkey) as work_id")
    return R.intake_members(R.pasted_identifiers(pasted), works, members)


def member_intake(t):
    return _intake(t)["added"].withColumn("stub", F.col("work_id").startswith("work_")).groupBy("set_id", "stub").agg(
        F.count("*").alias("added"), F.min(F.when(~F.col("stub"), F.col("work_id"))).alias("first_known")
    )


def member_intake_stubs(t):
    return _intake(t)["stubs"].select("doi", "pmid", "availability_state")


def member_removal(t):
    members = B.set_members(t).select("set_id", "work_id")
    removals = t.part.selectExpr("concat('S', p_size % 25) as set_id", "concat('P', p_partkey) as work_id")
    remaining, removed = R.remove_members(members, removals)
    return remaining.withColumn("state", F.lit("remaining")).unionByName(removed.withColumn("state", F.lit("removed")))


def reference_expansion(t):
    """Reference lists materialised as edges, with stubs for unknown works."""
    from .graphs import _identified, _links

    finished = t.orders.filter("o_orderstatus = 'F'").selectExpr("concat('O', o_orderkey) as work_id")
    works = _identified(t).join(finished, "work_id", "left_semi")
    resolved, stubs = R.stub_works(_links(t), works)
    edges = R.new_edges(
        resolved.limit(0).select("citing_work_id", "cited_work_id").withColumn("source", F.lit("references")),
        resolved.filter("citing_work_id <> cited_work_id"),
        "references",
    )
    state = stubs.select(F.col("work_id").alias("cited_work_id"), F.col("title").alias("stub_title"), F.col("year").alias("stub_year"))
    return edges.join(state, "cited_work_id", "left").select(
        "citing_work_id", "cited_title", F.col("stub_title").isNotNull().alias("is_stub"), "stub_title", "stub_year",
        F.when(F.col("stub_title").isNull(), F.col("cited_work_id")).alias("known_work_id"),
    )


# --- releases and lookups --------------------------------------------------------------------------


def release_diff(t):
    base = t.orders.selectExpr("o_orderkey as corpusid", "o_orderstatus as title", "cast(year(o_orderdate) as int) as year")
    updates = t.lineitem.selectExpr(
        "l_orderkey + (case when l_returnflag = 'R' then 10000000 else 0 end) as corpusid",
        "concat(l_returnflag, l_linestatus) as title", "l_linenumber as year",
        f"{B.LINE_KEY} as seq",
    )
    deletes = t.orders.filter("o_orderstatus = 'P'").selectExpr("o_orderkey as corpusid")
    return tables.apply_release_diff(base, updates, deletes, "corpusid", "seq")


def corpus_lookup(t):
    """Records of every order that has a returned line."""
    wanted = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.keyed_lookup(t.orders, "o_orderkey", wanted).select("o_orderkey", "o_custkey", "o_totalprice")


def reference_snapshot(t):
    """Nested reference lists (JSON text of each order) read back as link rows."""
    lists = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_partkey").alias("p"), F.max("l_linestatus").alias("s"))
    nested = (
        lists.groupBy(F.concat(F.lit("O"), "l_orderkey").alias("paper_id"))
        .pivot("l_returnflag", ["A", "N", "R"])
        .agg(F.min("p"))
    )
    item = lambda c: (
        f"named_struct('citedPaper', named_struct('externalIds', named_struct('CorpusId', {c}, 'DOI', "
        f"case when {c} % 2 = 0 then concat('10.1/', {c}) end), 'title', concat('Part ', {c})), 'isInfluential', {c} % 5 = 0)"
    )
    text = nested.selectExpr(
        "to_json(named_struct('paper_id', paper_id, 'references', filter(array("
        + ", ".join(f"case when {c} is not null then {item(c)} end" for c in ("A", "N", "R"))
        + "), x -> x is not null))) as line"
    )
    snapshot = text.select(F.from_json("line", tables.REFERENCE_SCHEMA).alias("d")).select("d.*")
    return tables.reference_links(snapshot).select(
        "paper_id", "position", "cited_corpus_id", "cited_doi", "cited_title", "is_influential"
    )


# --- exports ----------------------------------------------------------------------------------------


def member_export(t):
    rows = B.set_members(t).join(B.part_works(t), "work_id").selectExpr(
        "set_id", "work_id", "element_at(array(title, concat('=', title), concat('@', title), concat('-', title)), "
        "cast(length(work_id) % 4 as int) + 1) as title", "doi", "year"
    )
    return sinks.member_export(rows, ["set_id", "work_id", "title", "doi", "year"])


def member_identifiers(t):
    rows = B.set_members(t).join(_part_ids(t), "work_id")
    return sinks.identifier_list(rows)


def _part_ids(t):
    return t.part.selectExpr(
        "concat('P', p_partkey) as work_id", "case when p_partkey % 2 = 0 then concat('10.5555/p', p_partkey) end as doi",
        "case when p_partkey % 3 = 0 then cast(p_partkey as string) else '' end as pmid",
    )


_PREFIX = r"(?i)^(doi:|https?://(dx\.)?doi\.org/)"
_DOI_SQL = f"""CASE WHEN regexp_full_match(regexp_replace(regexp_replace(trim(raw), '{_PREFIX}', ''), '[.,;:]+$', ''), '10\\.\\d{{4,9}}/\\S+')
     THEN lower(regexp_replace(regexp_replace(trim(raw), '{_PREFIX}', ''), '[.,;:]+$', '')) END"""
_PMID_SQL = r"""CASE WHEN regexp_full_match(raw, '(?i)pmid:?\s*\d{1,8}') THEN regexp_extract(raw, '(\d+)$', 1)
     WHEN regexp_full_match(raw, '\d{1,8}') AND NOT (length(raw) = 4 AND raw::INT BETWEEN 1500 AND 2099) THEN raw END"""
_WORKS_SQL = """works AS (SELECT 'O' || o_orderkey AS work_id, o_orderkey AS ok,
     CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR END AS s2_corpus_id,
     CASE WHEN o_orderkey % 3 = 1 THEN '10.5555/O' || o_orderkey END AS doi,
     CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey::VARCHAR END AS pmid,
     CASE WHEN o_orderkey % 4 <> 0 THEN 'Held ' || o_orderkey END AS title,
     CASE WHEN o_orderkey % 6 = 0 THEN 'Known Person' ELSE '' END AS authors,
     CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS venue,
     CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS year,
     CASE WHEN o_orderkey % 2 = 0 THEN 'held abstract' END AS abstract,
     CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus = 'F' END AS is_retracted,
     o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders)"""
# a corpus-keyed work takes the first record only; the others match both, the first one leading
_FILLED_SQL = """filled AS (SELECT *, s2_corpus_id IS NULL AS f1, doi IS NULL AS f2, pmid IS NULL AS f3, title IS NULL AS f4,
     authors = '' AS f5,
     coalesce(venue, '') = '' AND (ok % 10 <> 0 OR ok % 3 <> 0) AS f6, year IS NULL AS f7,
     CASE WHEN ok % 10 = 0 THEN 'Late ' || o_custkey % 7 ELSE 'Venue ' || o_custkey % 7 END AS new_venue FROM works)"""
_FILLED_NAMES = """array_to_string(list_filter([CASE WHEN f1 THEN 's2_corpus_id' END, CASE WHEN f2 THEN 'doi' END, CASE WHEN f3 THEN 'pmid' END,
     CASE WHEN f4 THEN 'title' END, CASE WHEN f5 THEN 'authors' END, CASE WHEN f6 THEN 'venue' END, CASE WHEN f7 THEN 'year' END], lambda x: x IS NOT NULL), ',')"""

ENTRIES = {
    "identifier_normalize": (
        identifier_normalize,
        f"""WITH r AS (SELECT o_orderkey, {_RAW_SQL} AS raw FROM orders),
            n AS (SELECT *, {_DOI_SQL} AS doi, {_PMID_SQL} AS pmid FROM r)
            SELECT o_orderkey, doi, pmid,
              CASE WHEN doi IS NOT NULL THEN 'doi' WHEN pmid IS NOT NULL THEN 'pmid' WHEN regexp_full_match(raw, '\\d+') THEN 'ambiguous' END AS kind,
              nullif(lower(regexp_replace(regexp_extract(raw, '(?i)10\\.\\d{{4,9}}/[^\\s"''{{}}<>,;]+', 0), '[.,;:]+$', '')), '') AS doi_in_text,
              CASE WHEN NOT contains(trim(raw), ':') THEN trim(raw)
                   WHEN upper(split_part(trim(raw), ':', 1)) IN ('DOI', 'PMID', 'PMCID', 'CORPUSID', 'ARXIV', 'MAG', 'ACL', 'URL')
                        AND regexp_replace(trim(raw), '^[^:]*:', '') <> ''
                   THEN CASE WHEN upper(split_part(trim(raw), ':', 1)) = 'CORPUSID' THEN 'CorpusId' ELSE upper(split_part(trim(raw), ':', 1)) END
                        || ':' || regexp_replace(trim(raw), '^[^:]*:', '') END AS paper_id,
              nullif(regexp_extract(upper(trim(raw)), '^(?:PMC)?(\\d+)$', 1), '') AS pmcid
            FROM n""",
    ),
    "pasted_identifiers": (
        pasted_identifiers,
        f"""WITH p AS (SELECT 'S' || o_orderkey AS set_id, 'Title, ' || {_RAW_SQL} || E'\\n' || {_RAW_SQL} || ' 2021,x ' || o_custkey AS txt FROM orders),
            s AS (SELECT set_id, list_filter(regexp_split_to_array(txt, '[\\s,]+'), lambda x: x <> '') AS toks FROM p),
            k AS (SELECT set_id, unnest(toks) AS raw, unnest(generate_series(1, len(toks))) - 1 AS position FROM s),
            n AS (SELECT *, {_DOI_SQL} AS doi, {_PMID_SQL} AS pmid FROM k)
            SELECT set_id, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN pmid IS NOT NULL THEN 'pmid' ELSE 'ambiguous' END AS kind,
                   coalesce(doi, pmid, raw) AS value, min(position) AS position
            FROM n WHERE doi IS NOT NULL OR pmid IS NOT NULL OR regexp_full_match(raw, '\\d+') GROUP BY 1, 2, 3""",
    ),
    "backfill_papers": (
        backfill_papers,
        f"""WITH {_WORKS_SQL}, {_FILLED_SQL}
            SELECT work_id, coalesce(s2_corpus_id, ok::VARCHAR) AS s2_corpus_id, coalesce(doi, '10.5555/o' || ok) AS doi,
              coalesce(pmid, ok::VARCHAR) AS pmid, coalesce(title, 'Bulk ' || ok) AS title,
              CASE WHEN f5 THEN 'Author ' || o_custkey ELSE authors END AS authors,
              CASE WHEN f6 THEN new_venue ELSE venue END AS venue, coalesce(year, year(o_orderdate)) AS year, {_FILLED_NAMES} AS filled
            FROM filled""",
    ),
    "backfill_report": (
        backfill_report,
        f"""WITH {_WORKS_SQL}, {_FILLED_SQL}
            SELECT field, count(*) AS works_filled FROM (SELECT unnest(string_split({_FILLED_NAMES}, ',')) AS field FROM filled)
            WHERE field <> '' GROUP BY 1""",
    ),
    "backfill_passes": (
        backfill_passes,
        f"""WITH {_WORKS_SQL}
            SELECT work_id, ok::VARCHAR AS s2_corpus_id, 'TLDR ' || o_orderpriority AS tldr,
              coalesce(abstract, CASE WHEN ok % 11 <> 0 THEN 'Abstract ' || ok END) AS abstract FROM works""",
    ),
    "identifier_resolution": (
        identifier_resolution,
        f"""WITH {_WORKS_SQL}
            SELECT printf('%010d', ok * 2) AS record_id, work_id FROM works
            UNION ALL SELECT printf('%010d', ok * 2 + 1), work_id FROM works WHERE ok % 3 <> 0""",
    ),
    "insert_absent_edges": (
        insert_absent_edges,
        with_ctes(
            "bibliographic",
            """SELECT citing_work_id, cited_work_id, is_influential AS isinfluential, 'bulk' AS source FROM bibliographic
               WHERE NOT coalesce(is_influential, false) AND substring(citing_work_id, 2)::BIGINT % 3 = 0 AND substring(cited_work_id, 2)::BIGINT % 3 = 0""",
        ),
    ),
    "enrich_snapshot": (
        enrich_snapshot,
        f"""WITH {_WORKS_SQL},
            e AS (SELECT *, abstract IS NULL AS todo, coalesce(venue, '') = '' AND ok % 10 <> 0 AS f6 FROM works)
            SELECT work_id, CASE WHEN todo THEN ok::VARCHAR ELSE s2_corpus_id END AS s2_corpus_id,
              CASE WHEN todo THEN coalesce(doi, '10.5555/o' || ok) ELSE doi END AS doi, CASE WHEN todo THEN ok::VARCHAR ELSE pmid END AS pmid,
              CASE WHEN todo THEN coalesce(title, 'Bulk ' || ok) ELSE title END AS title,
              CASE WHEN todo AND f6 THEN 'Venue ' || o_custkey % 7 ELSE venue END AS venue,
              CASE WHEN todo THEN coalesce(year, year(o_orderdate)) ELSE year END AS year,
              CASE WHEN todo THEN 'Short ' || o_custkey END AS tldr,
              CASE WHEN todo THEN array_to_string(list_filter([CASE WHEN s2_corpus_id IS NULL THEN 's2_corpus_id' END, CASE WHEN doi IS NULL THEN 'doi' END,
                CASE WHEN pmid IS NULL THEN 'pmid' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN authors = '' THEN 'authors' END,
                CASE WHEN f6 THEN 'venue' END, CASE WHEN year IS NULL THEN 'year' END, 'tldr'], lambda x: x IS NOT NULL), ',') ELSE '' END AS filled
            FROM e""",
    ),
    "integrity_check": (
        integrity_check,
        f"""WITH {_WORKS_SQL}, m AS (SELECT *, doi IS NOT NULL AND o_orderpriority <> '5-LOW' AS seen,
              o_orderstatus = 'F' OR ok % 10 = 1 AS r,
              CASE WHEN o_orderstatus = 'F' THEN 'Correction' WHEN ok % 10 = 1 THEN 'Retracted' END AS n FROM works WHERE doi IS NOT NULL)
            SELECT work_id, doi, true AS checked, CASE WHEN seen THEN r ELSE is_retracted END AS is_retracted,
              CASE WHEN seen THEN n END AS integrity_notice,
              seen AND (is_retracted IS DISTINCT FROM r OR n IS NOT NULL) AS changed, CASE WHEN NOT seen THEN 'no record' END AS skipped_reason
            FROM m""",
    ),
    "integrity_unchecked": (
        integrity_unchecked,
        f"""WITH {_WORKS_SQL}, m AS (SELECT o_orderpriority <> '5-LOW' AS seen, o_orderstatus = 'F' OR ok % 10 = 1 AS r,
              CASE WHEN o_orderstatus = 'F' THEN 'Correction' WHEN ok % 10 = 1 THEN 'Retracted' END AS n
              FROM works WHERE doi IS NOT NULL AND is_retracted IS NULL)
            SELECT CASE WHEN seen THEN r END AS is_retracted, CASE WHEN seen THEN n END AS integrity_notice, count(*) AS n,
              count(*) FILTER (seen) AS changed FROM m GROUP BY 1, 2""",
    ),
    "reference_metadata": (
        reference_metadata,
        with_ctes(
            "lines",
            """, best AS (SELECT l_orderkey, l_partkey, arg_max({'s': l_linestatus, 'k': k}, k) AS b FROM lines
                 WHERE l_returnflag <> 'R' GROUP BY 1, 2)
               SELECT 'N' || k AS mention_id, 's2' AS provider, b.s AS intent, b.k AS context, b.s = 'F' AS is_influential
               FROM lines JOIN best USING (l_orderkey, l_partkey) WHERE l_tax > 0""",
        ),
    ),
    "member_intake": (
        member_intake,
        f"""WITH r AS (SELECT 'S' || o_custkey % 25 AS set_id, unnest(list_filter(regexp_split_to_array({_RAW_SQL}, '[\\s,]+'), lambda x: x <> '')) AS raw FROM orders),
            n AS (SELECT DISTINCT set_id, {_DOI_SQL} AS doi, CASE WHEN {_DOI_SQL} IS NULL THEN {_PMID_SQL} END AS pmid FROM r),
            w AS (SELECT set_id, doi, n.pmid, p_partkey FROM n LEFT JOIN part ON
                  (doi IS NOT NULL AND p_partkey % 2 = 0 AND lower('10.1234/ABC' || p_partkey) = doi) OR (n.pmid IS NOT NULL AND p_partkey::VARCHAR = n.pmid)
                  WHERE doi IS NOT NULL OR n.pmid IS NOT NULL),
            a AS (SELECT DISTINCT set_id, coalesce('P' || p_partkey, 'stub ' || coalesce(doi, pmid)) AS work_id, p_partkey IS NULL AS stub FROM w
                  WHERE p_partkey IS NULL OR 'S' || p_partkey % 25 <> set_id)
            SELECT set_id, stub, count(*) AS added, min(work_id) FILTER (NOT stub) AS first_known FROM a GROUP BY 1, 2""",
    ),
    "member_intake_stubs": (
        member_intake_stubs,
        f"""WITH r AS (SELECT unnest(list_filter(regexp_split_to_array({_RAW_SQL}, '[\\s,]+'), lambda x: x <> '')) AS raw FROM orders),
            n AS (SELECT DISTINCT {_DOI_SQL} AS doi, CASE WHEN {_DOI_SQL} IS NULL THEN {_PMID_SQL} END AS pmid FROM r)
            SELECT doi, n.pmid, 'metadata_stub' AS availability_state FROM n
            WHERE (doi IS NOT NULL AND doi NOT IN (SELECT lower('10.1234/ABC' || p_partkey) FROM part WHERE p_partkey % 2 = 0))
               OR (n.pmid IS NOT NULL AND n.pmid NOT IN (SELECT p_partkey::VARCHAR FROM part))""",
    ),
    "member_removal": (
        member_removal,
        with_ctes(
            "members",
            """SELECT set_id, work_id, CASE WHEN p_size % 25 = substring(set_id, 2)::INT THEN 'removed' ELSE 'remaining' END AS state
               FROM members JOIN part ON work_id = 'P' || p_partkey""",
        ),
    ),
    "reference_expansion": (
        reference_expansion,
        with_ctes(
            "links",
            """, l AS (SELECT *, o_orderkey AS k, o_orderstatus = 'F' AS known FROM links JOIN orders ON cited_title = 'Order ' || o_orderkey
                 WHERE coalesce(cited_corpus_id, cited_doi, cited_pmid) IS NOT NULL)
               SELECT citing_work_id, cited_title, NOT known AS is_stub, CASE WHEN NOT known THEN cited_title END AS stub_title,
                 CASE WHEN NOT known THEN cited_year END AS stub_year, CASE WHEN known THEN 'O' || k END AS known_work_id FROM l""",
        ),
    ),
    "release_diff": (
        release_diff,
        with_ctes(
            "lines",
            """, u AS (SELECT l_orderkey + CASE WHEN l_returnflag = 'R' THEN 10000000 ELSE 0 END AS corpusid,
                   arg_max({'t': l_returnflag || l_linestatus, 'y': l_linenumber}, k) AS r FROM lines GROUP BY 1),
               d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
               SELECT o_orderkey AS corpusid, o_orderstatus AS title, year(o_orderdate) AS year FROM orders
                 WHERE o_orderkey NOT IN (SELECT corpusid FROM u) AND o_orderkey NOT IN (FROM d)
               UNION ALL SELECT corpusid, r.t, r.y FROM u WHERE corpusid NOT IN (FROM d)""",
        ),
    ),
    "corpus_lookup": (
        corpus_lookup,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "reference_snapshot": (
        reference_snapshot,
        """WITH g AS (SELECT l_orderkey, l_returnflag, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS position FROM g)
           SELECT 'O' || l_orderkey AS paper_id, position, p::VARCHAR AS cited_corpus_id, CASE WHEN p % 2 = 0 THEN '10.1/' || p END AS cited_doi,
             'Part ' || p AS cited_title, p % 5 = 0 AS is_influential FROM r""",
    ),
    "member_export": (
        member_export,
        with_ctes(
            "members",
            """SELECT set_id, work_id, ['', '''=', '''@', '''-'][length(work_id) % 4 + 1] || p_name AS title,
                 '10.5555/p' || p_partkey AS doi, '' AS year FROM members JOIN part ON work_id = 'P' || p_partkey""",
        ),
    ),
    "member_identifiers": (
        member_identifiers,
        with_ctes(
            "members",
            """SELECT DISTINCT v AS value FROM (SELECT unnest([CASE WHEN p_partkey % 2 = 0 THEN '10.5555/p' || p_partkey END,
                 CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END]) AS v FROM members JOIN part ON work_id = 'P' || p_partkey) WHERE v IS NOT NULL""",
        ),
    ),
}
