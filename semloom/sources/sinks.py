"""Sinks: delimited text, JSON, workbooks, N-Triples, N-Quads, Turtle, TriG, RDF/XML, JSON-LD (K1-K6, J17)."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.operators.skos import turtle
from semloom.operators.vocabulary import NAMESPACES, iri


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """K1/K6. With a header; ``bom`` puts a byte order mark before the first column's name for spreadsheet programs."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """K5."""
    df.write.mode("overwrite").json(path)


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def expanded(c: Column, prefixes: Mapping[str, str] = NAMESPACES) -> Column:
    """``prefix:name`` in full where the prefix is listed; any other text as it is."""
    prefix = F.regexp_extract(c, r"^([A-Za-z][\w-]*):(?!//)", 1)
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    return F.coalesce(F.concat(F.element_at(known, prefix), F.substring(c, F.length(prefix) + 2, F.length(c))), c)


def is_blank(node: Column) -> Column:
    """Whether a subject is a blank node: marked as one, or without a scheme."""
    return ~node.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | node.startswith("_:")


def ntriples(triples: DataFrame, graph: str | None = None, prefixes: Mapping[str, str] = NAMESPACES) -> DataFrame:
    """K4. One line per triple; with ``graph`` (a column) N-Quads. CURIEs of the prefixes are written in full; an iri without a scheme is an error."""
    full = lambda c: expanded(c, prefixes)
    sound = lambda c: F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^<>\"{}|^`\\\x00-\x20]*$"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.raise_error(F.concat(F.lit("no iri: "), c)))
    blank = lambda c: F.concat(F.lit("_:"), F.regexp_replace(c, "^_:", ""))
    tag = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang"))
    tag = F.coalesce(tag, F.when(F.col("o_dtype") != "", F.concat(F.lit("^^"), sound(full(F.col("o_dtype"))))), F.lit("")) if "o_dtype" in triples.columns else F.coalesce(tag, F.lit(""))
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tag)).when(F.col("o_kind") == "bnode", blank(F.col("o"))).otherwise(sound(full(F.col("o"))))
    subject = F.when(is_blank(F.col("s")), blank(F.col("s"))).otherwise(sound(full(F.col("s"))))
    quad = F.when(F.col(graph).isNotNull(), F.concat(F.lit(" "), sound(full(F.col(graph))))).otherwise("") if graph else F.lit("")
    return triples.select(F.concat(subject, F.lit(" "), sound(full(F.col("p"))), F.lit(" "), obj, quad, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, graph: str | None = None, override: bool = True) -> None:
    """K4. ``override`` False leaves an existing result as it is."""
    ntriples(triples, graph).write.mode("overwrite" if override else "ignore").text(path)


def prefix_header(prefixes: Mapping[str, str]) -> str:
    """J17."""
    return "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes.items())


def _with_head(blocks: DataFrame, head: str, tail: str | None = None) -> DataFrame:
    """The blocks as lines, each partition that has any with the head before its first and the tail after its last."""

    def run(batches):
        import pandas as pd

        first = True
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [head, *b["block"]] if first else b["block"]})
                first = False
        if tail and not first:
            yield pd.DataFrame({"value": [tail]})

    return blocks.mapInPandas(run, "value string")


def write_turtle(triples: DataFrame, path: str, prefixes: Mapping[str, str]) -> None:
    """K3. Blocks in canonical order; every part file begins with the prefixes, so each can be read by itself."""
    blocks = turtle(triples, prefixes).repartitionByRange("class", "s").sortWithinPartitions("class", "s")
    _with_head(blocks, prefix_header({**NAMESPACES, **prefixes})).write.mode("overwrite").text(path)


def write_trig(triples: DataFrame, path: str, prefixes: Mapping[str, str], graph: str = "g") -> None:
    """K4. As Turtle, each subject's block within its graph; triples whose ``graph`` is null stand in the default graph. A graph may open several times, as the format allows."""
    blocks = turtle(triples, prefixes, graph=graph)
    named = F.when(F.col(graph).isNull(), F.col("block")).otherwise(F.concat(F.lit("<"), F.col(graph), F.lit("> {\n"), "block", F.lit("\n}")))
    ordered = blocks.withColumn("block", named).repartitionByRange(graph, "class", "s").sortWithinPartitions(graph, "class", "s")
    _with_head(ordered, prefix_header({**NAMESPACES, **prefixes})).write.mode("overwrite").text(path)


def workbook(rows: Iterable[Sequence[str | None]]) -> bytes:
    """The bytes of an .xlsx workbook with one sheet of texts."""
    ns = "http://schemas.openxmlformats.org/"
    office, package = ns + "officeDocument/2006/relationships", ns + "package/2006/"
    sheet = ["<sheetData>"]
    for i, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row) if v is not None)
        sheet.append(f'<row r="{i}">{cells}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}>" + "".join(sheet) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbooks(df: DataFrame, path: str, rows: int = 100_000) -> DataFrame:
    """K2. Workbooks of up to ``rows`` rows each with the header, all values as texts, in a folder of any file system that executors see; (file, n) of what was written.

    A file is named after its partition and place there, so a task that runs again writes the same files.
    """
    import pandas as pd
    from pyspark import TaskContext

    names = df.columns

    def run(batches):
        import pyarrow.fs as fs

        place, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
        place.create_dir(base, recursive=True)
        held: list[tuple] = []
        count = 0

        def put(part: list[tuple]) -> tuple[str, int]:
            name = f"{base}/part-{TaskContext.get().partitionId():05d}-{count:05d}.xlsx"
            with place.open_output_stream(name) as f:
                f.write(workbook([names, *part]))
            return name, len(part)

        for b in batches:
            held += b.itertuples(index=False, name=None)
            while len(held) > rows:
                yield pd.DataFrame([put(held[:rows])], columns=["file", "n"])
                held, count = held[rows:], count + 1
        if held:
            yield pd.DataFrame([put(held)], columns=["file", "n"])

    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in names))
    return texts.mapInPandas(run, "file string, n long")


def rdf_xml(triples: DataFrame) -> DataFrame:
    """K4. One rdf:Description element per subject, to stand within an rdf:RDF element; predicates have to end in a name."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    ns, name = F.regexp_extract("p", r"^(.*[/#:])([^/#:]+)$", 1), F.regexp_extract("p", r"^(.*[/#:])([^/#:]+)$", 2)
    lang = F.when(F.col("o_lang") != "", F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).otherwise("")
    open_ = F.concat(F.lit("<x:"), name, F.lit(' xmlns:x="'), safe(ns), F.lit('"'))
    body = F.when(F.col("o_kind") == "literal", F.concat(open_, lang, F.lit(">"), safe(F.col("o")), F.lit("</x:"), name, F.lit(">"))).when(F.col("o_kind") == "bnode", F.concat(open_, F.lit(' rdf:nodeID="'), safe(F.regexp_replace("o", "^_:", "")), F.lit('"/>'))).otherwise(F.concat(open_, F.lit(' rdf:resource="'), safe(F.col("o")), F.lit('"/>')))
    about = F.when(F.col("s").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.lit('rdf:about="'), safe(F.col("s")), F.lit('"'))).otherwise(F.concat(F.lit('rdf:nodeID="'), safe(F.col("s")), F.lit('"')))
    return triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(body)), "").alias("b")).select(F.concat(F.lit("<rdf:Description "), about, F.lit(">"), "b", F.lit("</rdf:Description>")).alias("value"))


def write_rdf_xml(triples: DataFrame, path: str) -> None:
    """K4. Every part file is a document of its own."""
    blocks = rdf_xml(triples).withColumnRenamed("value", "block")
    _with_head(blocks, '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', "</rdf:RDF>").write.mode("overwrite").text(path)


def jsonld(triples: DataFrame) -> DataFrame:
    """K4. (s, value): one indented node object per subject, in expanded form."""
    plain = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    is_type = F.col("p") == iri("rdf:type")
    dtype = F.nullif("o_dtype", F.lit("")) if "o_dtype" in triples.columns else F.lit(None).cast("string")
    literal = F.to_json(F.struct(F.col("o").alias("@value"), F.nullif("o_lang", F.lit("")).alias("@language"), dtype.alias("@type")))
    blank = lambda c: F.concat(F.lit("_:"), F.regexp_replace(c, "^_:", ""))
    node = F.when(F.col("o_kind") == "bnode", blank(F.col("o"))).otherwise(F.col("o"))
    obj = F.when(is_type, plain(node)).when(F.col("o_kind") == "literal", literal).otherwise(F.to_json(F.struct(node.alias("@id"))))
    key = F.when(is_type, "@type").otherwise(F.col("p"))
    props = triples.groupBy("s", key.alias("k")).agg(F.array_join(F.array_sort(F.collect_set(obj)), ",\n      ").alias("v"))
    lines = props.groupBy("s").agg(F.array_sort(F.collect_list(F.concat(F.lit("    "), plain(F.col("k")), F.lit(": [\n      "), "v", F.lit("\n    ]")))).alias("lines"))
    subject = F.when(~F.col("s").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("s").startswith("_:"), blank(F.col("s"))).otherwise(F.col("s"))
    return lines.select("s", F.concat(F.lit('  {\n    "@id": '), plain(subject), F.lit(",\n"), F.array_join("lines", ",\n"), F.lit("\n  }")).alias("value"))


def write_jsonld(triples: DataFrame, path: str, prefixes: Mapping[str, str], override: bool = True) -> None:
    """K4. Node objects by subject; every part file is a document with the prefixes as its context."""
    nodes = jsonld(triples).repartitionByRange("s").sortWithinPartitions("s")
    head = '{\n"@context": ' + json.dumps(dict(prefixes), ensure_ascii=False) + ',\n"@graph": ['

    def run(batches):
        import pandas as pd

        first = True
        for b in batches:
            if len(b):
                values = list(b["value"])
                yield pd.DataFrame({"value": [head + "\n" + values[0] if first else "," + values[0], *("," + v for v in values[1:])]})
                first = False
        if not first:
            yield pd.DataFrame({"value": ["]\n}"]})

    nodes.mapInPandas(run, "value string").write.mode("overwrite" if override else "ignore").text(path)
