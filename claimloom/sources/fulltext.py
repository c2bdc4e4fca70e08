"""Full-text XML papers in bulk: metadata, references, sentence passages, citations.

Python only flattens the mixed content of a document, which column functions cannot do
without losing text order; sentences and marker placement are column work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import content_hash
from ..functions.text import sentences_with_offsets

#: Documents turned into one output batch.
_SLICE = 64

FLAT_SCHEMA = (
    "doc_id string, artifact_hash string, parse_status string, title string, venue string, year int, doi string, pmid string, "
    "authors array<string>, refs array<struct<rid:string,label:string,title:string,doi:string,pmid:string,year:int>>, "
    "paragraphs array<struct<section:string,text:string,start:int,marks:array<struct<marker:string,rid:string,at:int>>>>"
)


class _Refused(Exception):
    """The document declares an entity; expanding those is how an XML file attacks its reader."""


@dataclass
class _Section:
    """A section under construction; its title may come after its paragraphs."""

    parent: _Section | None
    titled: bool = False
    title: str | None = None

    def name(self) -> str | None:
        at: _Section | None = self
        while at is not None and at.title is None:
            at = at.parent
        return at.title if at is not None else None


@dataclass
class _Open:
    """An element that has not ended yet."""

    name: str
    attrs: dict[str, str]
    text_from: int | None = None  # first piece of its text, if anything wants it
    in_meta: bool = False
    section: _Section | None = None
    paragraph: bool = False
    record: dict | None = None  # a reference or contributor that it is


#: Elements whose text some field is made of.
_WITH_TEXT = {"article-title", "journal-title", "article-id", "pub-id", "year", "surname", "given-names", "label", "title"}


class _PaperReader:
    """One pass over the start, text and end events of a document, with a stack of open elements.

    Text is kept once, as the pieces the parser hands over; a field is the join of the pieces
    between its start and end. Nesting costs stack, not recursion.
    """

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.pieces: list[str] = []
        self.wanted = 0  # open elements that collect text
        self.head: dict = dict.fromkeys(("title", "venue", "year", "doi", "pmid"))
        self.outer_venue: list[str | None] = []
        self.authors: list[str] = []
        self.refs: list[dict] = []
        self.records: list[dict] = []  # open references and contributors
        self.paragraphs: list[tuple[_Section, str, list[dict]]] = []
        self.meta_seen = self.body_seen = False
        self.rendered: list[str] | None = None  # the open paragraph
        self.length, self.marks = 0, []
        self.citation: list | None = None  # depth, rid, own text, whether a child has begun
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text
        self.parser.EntityDeclHandler = self.refuse

    def refuse(self, *_: object) -> None:
        raise _Refused

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name = tag.rpartition("}")[2]
        above = self.stack[-1] if self.stack else None
        el = _Open(name, attrs, in_meta=above is not None and above.in_meta)
        self.stack.append(el)
        if self.citation is not None:
            self.citation[3] = True
        elif self.rendered is not None and name == "xref" and attrs.get("ref-type") == "bibr":
            self.citation = [len(self.stack), attrs.get("rid"), [], False]
        if name == "article-meta" and not self.meta_seen:
            self.meta_seen = el.in_meta = True
        elif name == "body" and not self.body_seen:
            self.body_seen, el.section = True, _Section(None)
        elif above is not None and above.section is not None:
            if name == "sec":
                el.section = _Section(above.section)
            elif name == "p" and self.rendered is None:
                el.paragraph, self.rendered, self.length, self.marks = True, [], 0, []
        if name == "ref" and attrs.get("id"):
            el.record = {"rid": attrs["id"], "label": None, "title": None, "doi": None, "pmid": None, "year": None}
            self.refs.append(el.record)
        elif name == "contrib" and el.in_meta:
            el.record = {"surname": None, "given-names": None}
        if el.record is not None:
            self.records.append(el.record)
        if name in _WITH_TEXT:
            el.text_from = len(self.pieces)
            self.wanted += 1

    def text(self, data: str) -> None:
        if self.wanted:
            self.pieces.append(data)
        if self.citation is not None:
            if not self.citation[3]:
                self.citation[2].append(data)
        elif self.rendered is not None:
            self.rendered.append(data)
            self.length += len(data)

    def end(self, _: str) -> None:
        el = self.stack.pop()
        if el.text_from is not None:
            self.field(el, "".join(self.pieces[el.text_from :]).strip() or None)
            self.wanted -= 1
            if not self.wanted:
                self.pieces.clear()
        if self.citation is not None and self.citation[0] == len(self.stack) + 1:
            marker = "".join(self.citation[2]).strip() or "?"
            self.marks.append({"marker": marker, "rid": self.citation[1], "at": self.length})
            self.rendered.append(marker)
            self.length += len(marker)
            self.citation = None
        if el.paragraph:
            body = "".join(self.rendered).strip()
            if body:
                self.paragraphs.append((self.stack[-1].section, body, self.marks))
            self.rendered = None
        if el.record is not None:
            self.records.pop()
            if el.name == "contrib":
                full = " ".join(p for p in (el.record["given-names"], el.record["surname"]) if p)
                self.authors += [full] if full else []

    def field(self, el: _Open, value: str | None) -> None:
        """Put the text of a finished element where it belongs."""
        kind = el.attrs.get("pub-id-type")
        year = int(value) if el.name == "year" and value and value.isdecimal() and len(value) < 10 else None
        if el.name == "title" and self.stack and (section := self.stack[-1].section) is not None and section.parent is not None and not section.titled:
            section.titled, section.title = True, value
        if el.name == "journal-title":
            self.outer_venue.append(value)
        if el.in_meta:
            first = {"article-title": "title", "journal-title": "venue"}.get(el.name)
            if el.name in ("article-id", "pub-id"):
                first = {"doi": "doi", "pmid": "pmid"}.get(kind or el.attrs.get("article-id-type", ""))
            if first and self.head[first] is None:
                self.head[first] = value
            if year is not None and self.head["year"] is None:
                self.head["year"] = year
        for record in self.records:
            if "rid" not in record:
                if el.name in record:
                    record[el.name] = value
            elif el.name == "label":
                record["label"] = value
            elif el.name == "article-title":
                record["title"] = record["title"] or value
            elif el.name == "pub-id" and kind in ("doi", "pmid"):
                record[kind] = value
            elif year is not None:
                record["year"] = year

    def result(self) -> dict | None:
        if self.head["venue"] is None and self.meta_seen and self.outer_venue:
            self.head["venue"] = self.outer_venue[0]
        if not self.paragraphs and self.head["title"] is None:
            return None
        starts = accumulate((len(text) + 1 for _, text, _ in self.paragraphs), initial=0)
        made = [{"section": s.name(), "text": text, "start": at, "marks": marks} for (s, text, marks), at in zip(self.paragraphs, starts, strict=False)]
        return {**self.head, "authors": self.authors, "refs": self.refs, "paragraphs": made}


def flatten_document(xml: str | None) -> dict | None:
    """One document as a nested record, or None when it is not a readable paper.

    Of a field repeated in the metadata the first counts, in a reference the last (but for its title).
    """
    reader = _PaperReader()
    try:
        reader.parser.Parse(xml or "", True)
    except (expat.ExpatError, _Refused):
        return None
    return reader.result()


def _arrow_schema() -> pa.Schema:
    text, number = pa.string(), pa.int32()
    reference = pa.struct([(c, text) for c in ("rid", "label", "title", "doi", "pmid")] + [("year", number)])
    mark = pa.struct([("marker", text), ("rid", text), ("at", number)])
    paragraph = pa.struct([("section", text), ("text", text), ("start", number), ("marks", pa.list_(mark))])
    return pa.schema(
        [("doc_id", text), ("artifact_hash", text), ("parse_status", text), ("title", text), ("venue", text), ("year", number), ("doi", text)]
        + [("pmid", text), ("authors", pa.list_(text)), ("refs", pa.list_(reference)), ("paragraphs", pa.list_(paragraph))]
    )


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, empty = _arrow_schema(), {"authors": [], "refs": [], "paragraphs": []}
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            rows = []
            for row in batch.slice(start, _SLICE).to_pylist():
                record = flatten_document(row.pop("xml"))
                rows.append({**row, "parse_status": "parsed" if record else "failed", **(record or empty)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_papers(documents: DataFrame) -> DataFrame:
    """One nested row per ``(doc_id, xml)``; unreadable documents come out as ``failed``."""
    hashed = documents.select("doc_id", content_hash(F.col("xml")).alias("artifact_hash"), "xml")
    return hashed.mapInArrow(_flatten_batches, FLAT_SCHEMA)


def paper_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parse_status = 'parsed'").select(
        "doc_id", "title", "venue", "year", "doi", "pmid", "authors", "artifact_hash"
    )


def reference_rows(parsed: DataFrame) -> DataFrame:
    """References by id; of a repeated id the last entry counts."""
    rows = parsed.select("doc_id", F.posexplode("refs").alias("position", "r")).select("doc_id", "position", "r.*")
    return (
        rows.groupBy("doc_id", "rid")
        .agg(F.max_by(F.struct("label", "title", "doi", "pmid", "year"), "position").alias("r"))
        .select("doc_id", "rid", "r.*")
    )


def passage_rows(parsed: DataFrame) -> DataFrame:
    """One row per sentence with document offsets and the citations that start in it.

    A paragraph begins where the paragraphs before it and one separator each end.
    """
    paragraphs = parsed.select("doc_id", F.posexplode("paragraphs").alias("_p", "p")).select(
        "doc_id", "_p", "p.section", "p.marks", F.col("p.start").alias("_at"), sentences_with_offsets(F.col("p.text")).alias("_s")
    )
    sentences = paragraphs.select("doc_id", "_p", "section", "marks", "_at", F.posexplode("_s").alias("_n", "s"))
    begin, body = F.col("s.offset"), F.col("s.text")
    inside = F.filter("marks", lambda m: (m["at"] >= begin) & (m["at"] < begin + F.length(body)))
    return sentences.select(
        "doc_id",
        "section",
        (F.col("_p") + 1).alias("paragraph"),
        (F.col("_n") + 1).alias("sentence"),
        (F.col("_at") + begin).alias("char_start"),
        (F.col("_at") + begin + F.length(body)).alias("char_end"),
        body.alias("text"),
        F.transform(
            inside, lambda m: F.struct(m["marker"].alias("marker"), m["rid"].alias("rid"), (m["at"] - begin).alias("offset"))
        ).alias("citations"),
    )


def evidence(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables an ingest starts from."""
    return {"papers": paper_rows(parsed), "references": reference_rows(parsed), "passages": passage_rows(parsed)}
