"""RDF files as triples: N-Triples by lines, Turtle, RDF/XML and JSON-LD one file per task; OWL label indexes."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "g string, s string, p string, o string, o_kind string, o_lang string, o_dtype string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dtype>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?))(?=[\s;,.\])]|$)
    |(?P<bnode>_:[\w][\w.-]*(?<!\.))
    |(?P<name>(?:[A-Za-z_][\w.-]*(?<!\.))?:(?:[\w:%\\-](?:[\w:%.\\~!$&'()*+,;=/?@-]*[\w:%\\-])?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>[;,.\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def unescape(s: str) -> str:
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), s)


class Turtle:
    """Triples of a Turtle text. Blank nodes get names that follow from the file and their place."""

    def __init__(self, text: str, source: str = ""):
        self.tokens = self._tokens(text)
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.salt = hashlib.md5(source.encode()).hexdigest()[:8]
        self.blank = 0
        self.out: list[tuple] = []
        self.graph: str | None = None
        self.inside = False  # a graph of TriG
        self.graphs: list[str | None] = []

    @staticmethod
    def _tokens(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't be read at {at}: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m.group()))
        return out

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self, want: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if want and text != want:
            raise ValueError(f"{want!r} expected, {text!r} found")
        self.at += 1
        return kind, text

    def fresh(self) -> tuple:
        self.blank += 1
        return f"b{self.salt}{self.blank}", "bnode", None, None

    def iri(self, text: str) -> str:
        inner = unescape(text[1:-1])
        return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s[0], p, *o))
        self.graphs.append(self.graph)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.next()
                if text.lower().lstrip("@") == "prefix":
                    name = self.next()[1][:-1]
                    self.prefixes[name] = self.iri(self.next()[1])
                else:
                    self.base = self.iri(self.next()[1])
                if text[0] == "@":
                    self.next(".")
                continue
            if text == "}" and self.inside:
                self.next()
                self.graph, self.inside = None, False
                continue
            if text == "{" or self.tokens[self.at + 1 : self.at + 2] == [("mark", "{")]:
                self.graph = None if text == "{" else self.term()[0]
                self.next("{")
                self.inside = True
                continue
            s = self.term()
            if not (text == "[" and self.peek()[1] in ".}"):
                self.properties(s, ".")
            # The last statement of a graph needs no full stop.
            if not (self.inside and self.peek()[1] == "}"):
                self.next(".")
        return self.out

    def properties(self, s: tuple, end: str) -> None:
        while self.peek()[1] != end and not (self.inside and self.peek()[1] == "}"):
            kind, text = self.next()
            p = RDF + "type" if text == "a" else self.iri(text) if kind == "iri" else self.expand(text)
            while True:
                self.emit(s, p, self.term())
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()

    def expand(self, name: str) -> str:
        prefix, local = name.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term(self) -> tuple:
        kind, text = self.next()
        if kind == "iri":
            return self.iri(text), "iri", None, None
        if kind == "name":
            return self.expand(text), "iri", None, None
        if kind == "bnode":
            return f"b{self.salt}_{text[2:]}", "bnode", None, None
        if kind in ("text", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return value, "literal", self.next()[1][1:], None
            if self.peek()[0] == "dtype":
                self.next()
                return value, "literal", None, self.term()[0]
            return value, "literal", None, None
        if kind == "number":
            return text, "literal", None, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if kind == "word" and text != "a":
            return text, "literal", None, XSD + "boolean"
        if text == "[":
            node = self.fresh()
            self.properties(node, "]")
            self.next("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.next(")")
            rest: tuple = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.emit(node, RDF + "first", item)
                self.emit(node, RDF + "rest", rest)
                rest = node
            return rest
        raise ValueError(f"no term: {text!r}")


def rdf_xml(text: str, source: str = "") -> list[tuple]:
    """Triples of RDF/XML: node elements, typed nodes, literals with language or datatype, resources, nested nodes."""
    salt, out, count = hashlib.md5(source.encode()).hexdigest()[:8], [], [0]
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    lang_key = "{http://www.w3.org/XML/1998/namespace}lang"

    def node(e: ET.Element, lang: str | None) -> tuple:
        lang = e.get(lang_key, lang)
        about, ident, blank = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID"), e.get(f"{{{RDF}}}nodeID")
        if about is not None or ident is not None:
            me = (about if about is not None else "#" + ident, "iri", None, None)
        else:
            count[0] += 1
            me = (f"b{salt}_{blank}" if blank else f"b{salt}{count[0]}", "bnode", None, None)
        if name(e.tag) != RDF + "Description":
            out.append((me[0], RDF + "type", name(e.tag), "iri", None, None))
        for key, value in e.attrib.items():
            if not key.startswith(f"{{{RDF}}}") and key != lang_key and key[0] == "{":
                out.append((me[0], name(key), value, "literal", lang, None))
        for prop in e:
            own = prop.get(lang_key, lang)
            resource, ref = prop.get(f"{{{RDF}}}resource"), prop.get(f"{{{RDF}}}nodeID")
            if resource is not None:
                o = (resource, "iri", None, None)
            elif ref is not None:
                o = (f"b{salt}_{ref}", "bnode", None, None)
            elif len(prop):
                o = node(prop[0], own)
            else:
                dtype = prop.get(f"{{{RDF}}}datatype")
                o = (prop.text or "", "literal", None if dtype else own, dtype)
            out.append((me[0], name(prop.tag), *o))
        return me

    root = ET.fromstring(text)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, root.get(lang_key))
    return out


def json_ld(text: str, source: str = "") -> list[tuple]:
    """Triples of JSON-LD with a flat context: prefixes, terms, @vocab, @id, @type, @value and @language."""
    salt, out, count = hashlib.md5(source.encode()).hexdigest()[:8], [], [0]
    doc = json.loads(text)
    context = doc.get("@context", {}) if isinstance(doc, dict) else {}
    context = {k: v["@id"] if isinstance(v, dict) else v for k, v in context.items() if isinstance(v, str) or isinstance(v, dict) and "@id" in v} if isinstance(context, dict) else {}

    def expand(term: str, vocab: bool) -> str:
        if term in context and not term.startswith("@"):
            return expand(context[term], False)
        prefix, _, local = term.partition(":")
        if local and not local.startswith("//") and prefix in context:
            return context[prefix] + local
        return term if ":" in term or not vocab else context.get("@vocab", "") + term

    def node(x: dict) -> tuple:
        if "@id" in x:
            me = (expand(x["@id"], False), "iri", None, None)
        else:
            count[0] += 1
            me = (f"b{salt}{count[0]}", "bnode", None, None)
        for key, value in x.items():
            for v in value if isinstance(value, list) else [value]:
                if key == "@type":
                    out.append((me[0], RDF + "type", expand(v, True), "iri", None, None))
                elif not key.startswith("@") and v is not None and (p := expand(key, True)):
                    if isinstance(v, dict) and "@value" in v:
                        o = (str(v["@value"]), "literal", v.get("@language"), expand(v["@type"], True) if "@type" in v else None)
                    elif isinstance(v, dict):
                        o = node(v)
                    else:
                        kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else None
                        o = (json.dumps(v) if kind else str(v), "literal", None, XSD + kind if kind else None)
                    out.append((me[0], p, *o))
        return me

    for x in doc.get("@graph", [doc]) if isinstance(doc, dict) else doc:
        node(x)
    return out


def parse(text: str, source: str, kind: str | None = None) -> list[tuple]:
    """S3. (g, s, p, o, o_kind, o_lang, o_dtype) by ``kind`` (else the file's extension); g is the source, or the named graph of TriG."""
    kind = kind or source.rsplit(".", 1)[-1].lower()
    if kind in ("rdf", "owl", "xml"):
        return [(source, *r) for r in rdf_xml(text, source)]
    if kind in ("jsonld", "json"):
        return [(source, *r) for r in json_ld(text, source)]
    turtle = Turtle(text, source)
    rows = turtle.parse()
    return [(g or source, *r) for g, r in zip(turtle.graphs, rows)]


def read_rdf(spark: SparkSession, *paths: str, kind: str | None = None) -> DataFrame:
    """S3/S4. Distinct triples of files and folders (globs); g is the file. A file that can't be read fails the query by name.

    ``kind`` ('ttl', 'trig', 'rdf', 'jsonld') stands for the extension where files
    have none of their own. N-Triples should be read by ``read_ntriples``, which splits files; other
    formats are one file per task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows = parse(bytes(content).decode("utf-8-sig"), path, kind) if len(content) else []
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load([*paths]).select("path", "content")
    return files.mapInPandas(run, SCHEMA).dropDuplicates(["s", "p", "o", "o_kind", "o_lang", "o_dtype"])


def unescaped(c: Column) -> Column:
    """The text that an escaped literal or iri stands for, in one pass over its escapes; texts without a backslash are left as they are."""
    rule = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)|[^\\]+"
    plain = F.create_map(*(F.lit(x) for kv in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")) for x in kv))
    code = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    one = lambda x: F.when(F.length(x) > 2, code(x)).otherwise(F.coalesce(F.element_at(plain, F.substring(x, 2, 1)), F.substring(x, 2, 1)))
    pieces = F.transform(F.regexp_extract_all(c, F.lit("(?s)" + rule), F.lit(0)), lambda x: F.when(x.startswith("\\"), one(x)).otherwise(x))
    return F.when(c.contains("\\"), F.array_join(pieces, "")).otherwise(c)


def read_ntriples(spark: SparkSession, *paths: str, bad: str = "fail") -> DataFrame:
    """Triples of N-Triples or N-Quads files by lines, with built-in expressions only; files are split.

    Blank lines and comments are no triples. Any other line that is none fails the
    query with its text, or with ``bad='keep'`` becomes a row that holds it in
    ``bad`` and nulls elsewhere.
    """
    rule = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(?:<([^>]*)>\s*)?\.\s*(?:#.*)?$'
    part = lambda i: F.regexp_extract("value", rule, i)
    lines = spark.read.text([*paths]).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    fits = F.col("value").rlike(rule)
    kind = F.when(part(4) != "", "iri").when(part(5) != "", "bnode").otherwise("literal")
    some = lambda i: F.nullif(part(i), F.lit(""))
    obj = F.when(part(4) != "", unescaped(part(4))).when(part(5) != "", part(5)).otherwise(unescaped(part(6)))
    row = F.struct(some(9).alias("g"), F.when(part(1) != "", unescaped(part(1))).otherwise(part(2)).alias("s"), unescaped(part(3)).alias("p"), obj.alias("o"), kind.alias("o_kind"), some(7).alias("o_lang"), some(8).alias("o_dtype"))
    if bad == "keep":
        return lines.select(F.when(fits, row).alias("t"), F.when(~fits, F.col("value")).alias("bad")).select("t.*", "bad")
    return lines.select(F.when(fits, row).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value"))).alias("t")).select("t.*")


# Properties of labels and synonyms.
LABELS = ("http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#prefLabel")
SYNONYMS = tuple("http://www.geneontology.org/formats/oboInOwl#" + x for x in ("hasSynonym", "hasExactSynonym", "hasRelatedSynonym", "hasBroadSynonym", "hasNarrowSynonym"))
SPACES = {"http://www.w3.org/2002/07/owl#Class": "class", "http://www.w3.org/2002/07/owl#ObjectProperty": "property", "http://www.w3.org/2002/07/owl#NamedIndividual": "individual"}


def ontology_index(triples: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """S5/S6. (index (space, label, label_norm, iri, ord), synonyms (syn_norm, canonical, ord)) of an ontology's triples.

    ``mode`` 'first' takes rdfs:label and the plain synonym property only, 'all'
    also skos:prefLabel and the other synonym properties. The order is by iri and
    label; ``ord`` grows in it, with gaps.
    """
    from semloom.functions.text import normalize

    labels, synonyms = (LABELS[:1], SYNONYMS[:1]) if mode == "first" else (LABELS, SYNONYMS)
    kinds = F.create_map(*(F.lit(x) for kv in SPACES.items() for x in kv))
    typed = triples.where(F.col("p") == RDF + "type").select("s", F.element_at(kinds, F.col("o")).alias("space")).where("space is not null").distinct()
    named = triples.where(F.col("p").isin(*labels)).select("s", F.col("o").alias("label"))
    rows = typed.join(named, "s").distinct()
    # The order is that of iri and label; each range of the sorted rows is numbered by itself, after the rows of the ranges before it.
    ranged = rows.select("space", F.col("label"), F.col("s").alias("iri")).repartitionByRange("space", "iri", "label").sortWithinPartitions("space", "iri", "label").withColumn("i", F.monotonically_increasing_id())
    index = ranged.select("space", "label", normalize(F.col("label")).alias("label_norm"), "iri", F.col("i").alias("ord"))
    first = named.groupBy("s").agg(F.min("label").alias("canonical"))
    syn = triples.where(F.col("p").isin(*synonyms)).select("s", F.col("o").alias("syn")).join(first, "s")
    syn = syn.groupBy(normalize(F.col("syn")).alias("syn_norm")).agg(F.min(F.struct("s", "canonical")).alias("b")).select("syn_norm", "b.canonical", F.crc32("syn_norm").alias("ord"))
    return index, syn
