"""Other sources: delimited text of unknown separator, workbooks, archives, manifests, SBML, contexts, gridded series."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEPARATORS = (",", ";", "\t")


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), breaks: bool = True) -> DataFrame:
    """S1. A table with a header: the first of ``, ; tab`` that cuts it into more than one column; blanks after it and a byte order mark don't count.

    Only the first line is looked at. A file of one column, or without a required column, is an error. Values may hold line
    breaks; for files known to have none, ``breaks=False`` lets Spark split each file among tasks.
    """
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    sep = next((s for s in SEPARATORS if len(line.split(s)) > 1), None)
    if sep is None:
        raise ValueError(f"{path}: no separator found")
    df = spark.read.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, encoding="UTF-8", multiLine=breaks, escape='"')
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return df


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """The cells of a sheet of an .xlsx workbook as texts, empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "A1"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is None:
                    text = None
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                cells[at - 1] = text
            if cells:
                rows.append([cells.get(i) for i in range(max(cells) + 1)])
    return rows


class Workbook(DataSource):
    """S2. ``spark.read.format("workbook").load(path)``: the first sheet (or option ``sheet``) of .xlsx files, header trimmed, all columns texts."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _files(self) -> list[str]:
        place, path = file_system(self.options["path"])
        info = place.get_file_info(path)
        if info.is_file:
            return [path]
        import pyarrow.fs as fs

        return sorted(f.path for f in place.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.lower().endswith(".xlsx"))

    def schema(self) -> str:
        head = workbook_rows(read_bytes(self.options["path"], self._files()[0]), int(self.options.get("sheet", 1)))[0]
        return ", ".join(f"`{(h or f'_c{i}').strip().replace('`', '')}` string" for i, h in enumerate(head))

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self._files(), int(self.options.get("sheet", 1)), len(schema.fields))


def file_system(path: str):
    """(file system, path there) of a path or URI: local, HDFS or an object store, as Arrow knows them."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://|file:", path) else (fs.LocalFileSystem(), path)


def read_bytes(root: str, path: str) -> bytes:
    with file_system(root)[0].open_input_stream(path) as f:
        return f.read()


class WorkbookReader(DataSourceReader):
    def __init__(self, root: str, files: list[str], sheet: int, width: int):
        self.root, self.files, self.sheet, self.width = root, files, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = workbook_rows(read_bytes(self.root, partition.value), self.sheet)
        for row in rows[1:]:
            yield tuple((row + [None] * self.width)[: self.width])


def archive_members(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """S7. (archive, member, content, error) of zip archives, one archive per task, members one by one; an archive that can't be read gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "content", "error"]
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for info in z.infolist():
                            if not info.is_dir() and (only is None or re.search(only, info.filename)):
                                yield pd.DataFrame([(archive, info.filename, z.read(info), None)], columns=columns)
                except Exception as e:
                    yield pd.DataFrame([(archive, None, None, str(e)[:200])], columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, content binary, error string")


def shorten_component(name: Column) -> Column:
    """S7. Short name of a path component: three letters and six digits of its hash."""
    return F.concat(F.lower(F.substring(name, 1, 3)), F.lit("_"), F.substring(F.md5(name), 1, 6))


def manifest_locations(xml: Column) -> Column:
    """S8. Locations of a manifest's contents, leading './' taken off."""
    return F.transform(F.xpath(xml, F.lit('//*[local-name()="content"]/@location')), lambda x: F.regexp_replace(x, r"^[./]+", ""))


def sbml_model_id(xml: Column) -> Column:
    """S10. Id of the first model element, whatever its namespace."""
    return F.xpath_string(xml, F.lit('(//*[local-name()="model"])[1]/@id'))


def sbml_links(models: DataFrame, xml: str, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S9/J8. (external models (id, source), submodels (alias, model_ref), links (target_param, source_param, source_alias)) of SBML texts."""
    at = lambda path: F.xpath(F.col(xml), F.lit(path))
    two = lambda e, a, b, x, y: models.select(*keep, F.inline(F.arrays_zip(at(f'//*[local-name()="{e}"]/@*[local-name()="{a}"]').alias(x), at(f'//*[local-name()="{e}"]/@*[local-name()="{b}"]').alias(y))))
    external, sub = two("externalModelDefinition", "id", "source", "id", "source"), two("submodel", "id", "modelRef", "alias", "model_ref")
    held = '//*[local-name()="parameter"][*[local-name()="replacedBy"] or */*[local-name()="replacedBy"]]'
    links = models.select(*keep, F.inline(F.arrays_zip(at(held + "/@id").alias("target_param"), at(held + '//*[local-name()="replacedBy"]/@*[local-name()="idRef"]').alias("source_param"), at(held + '//*[local-name()="replacedBy"]/@*[local-name()="submodelRef"]').alias("source_alias"))))
    return external, sub, links


def metadata_parameters(members: DataFrame) -> DataFrame:
    """S11. (archive, param_id): distinct ids of parameters in every metadata.json of archives (upper and lower case alike)."""
    docs = members.where(F.lower("member").endswith("metadata.json")).select("archive", F.try_parse_json(F.col("content").cast("string")).alias("v"))
    one = F.try_variant_get("v", "$.modelMath.parameter.id", "string")
    try_ids = F.transform(F.coalesce(F.try_variant_get("v", "$.modelMath.parameter", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.id", "string"))
    return docs.select("archive", F.explode(F.concat(try_ids, F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")))).alias("param_id")).where("param_id <> ''").distinct()


def flatten_context(context: dict) -> list[tuple[str, str, str]]:
    """S15. (scope, key, iri) of a JSON-LD context; contexts of a key hold within it, prefixes are expanded."""
    context = context.get("@context", context)
    prefixes = {k: v for k, v in context.items() if isinstance(v, str) and v[-1:] in "/#:"}
    out, todo = [], [("", context)]
    while todo:
        scope, c = todo.pop()
        for key, v in c.items():
            iri = v.get("@id") if isinstance(v, dict) else v
            if isinstance(iri, str) and not key.startswith("@"):
                p, _, local = iri.partition(":")
                out.append((scope, key, prefixes[p] + local if p in prefixes and not local.startswith("//") else iri))
            if isinstance(v, dict) and isinstance(v.get("@context"), dict):
                todo.append((f"{scope}.{key}" if scope else key, v["@context"]))
    return sorted(out)


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """S15. A context file (configuration, small by nature) as rows."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(flatten_context(json.loads(text)), "scope string, key string, iri string")


def read_grid(spark: SparkSession, path: str, variable: str, first_year: int, last_year: int) -> DataFrame:
    """S12. Rows of a gridded variable and years from Parquet partitioned by variable and year: other folders aren't read."""
    return spark.read.parquet(path).where((F.col("variable") == variable) & F.col("year").between(first_year, last_year))
