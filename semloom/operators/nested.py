"""Nested model metadata as a table of nodes, identified and mapped by rules, and put together again (J1-J10, J18).

A document is walked into one row per value: its path (array places left out),
its node, its parent and its owner, which is the parent of the list for items of
one. Rules that say which object gets
which id are a small table joined on the path; ids are expressions over a node's
own fields. Documents are rebuilt only where a sink asks for them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import hash_id, sanitize_iri, strip_digits
from semloom.operators.vocabulary import Vocabulary
from semloom.session import computed

NODES = "model_id string, node_id long, parent_id long, path string, key string, arr_ix int, kind string, value string, owner_id long"


def _walk(model: str, doc: object) -> Iterator[tuple]:
    """Rows of a document, parents before children, without recursion (documents may be deep)."""
    stack: list[tuple[object, int, str, str, int | None, int]] = [(doc, -1, "", "", None, -1)]
    n = 0
    while stack:
        value, parent, path, key, ix, owner = stack.pop()
        node = n
        n += 1
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}.get(type(value), "null")
        text = None if kind in ("object", "array", "null") else value if kind == "string" else json.dumps(value)
        yield model, node, parent, path, key, ix, kind, text, owner
        if kind == "object":
            stack += [(v, node, f"{path}.{k}" if path else k, k, None, node) for k, v in reversed(value.items())]
        elif kind == "array":
            stack += [(v, node, path, key, i, parent) for i, v in reversed([*enumerate(value)])]


def walk(docs: DataFrame, model_id: str, doc: str) -> DataFrame:
    """Nodes of JSON documents, in document order by ``node_id``; a document that can't be read, or null, gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for model, text in zip(b["model_id"], b["doc"]):
                try:
                    rows += _walk(model, json.loads(text))
                except (TypeError, ValueError):
                    continue
                if len(rows) > 50_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return docs.select(F.col(model_id).cast("string").alias("model_id"), F.col(doc).alias("doc")).mapInPandas(run, NODES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
    return f.astype({"arr_ix": "Int32"}) if len(f) else f


#: Which objects get which kind of id. (path, or last key of array items) to (kind, fields in order, cut).
SECTIONS = ("generalInformation", "scope", "dataBackground", "modelMath")
RULES: Mapping[str, tuple[str, tuple[str, ...], int | None]] = {
    "creator": ("creator", (), None), "author": ("creator", (), None), "reference": ("reference", ("doi", "title"), 50), "modelCategory": ("modelCategory", ("modelClass",), None),
    "product": ("scope/product", ("name",), None), "hazard": ("scope/hazard", ("name",), None), "populationGroup": ("scope/populationGroup", ("name",), None), "parameter": ("parameter", ("id",), None),
    **{k: (f"dataBackground/{k}", ("identifier", "name", "title"), 50) for k in ("study", "studySample", "dietaryAssessmentMethod", "laboratory", "assay")},
    **{k: (f"modelMath/{k}", ("name", "identifier", "id"), 50) for k in ("qualityMeasures", "modelEquation", "exposure")},
}
ANY = ("id", "identifier", "name", "title", "email", "doi")
#: Keys whose ids an ontology may give: (key, field).
FROM_ONTOLOGY = {"product": "name", "hazard": "name", "populationGroup": "name", "modelCategory": "modelClass"}


def identified(nodes: DataFrame, base: str, ontology: DataFrame | None = None) -> DataFrame:
    """J1/X24/X25. (model_id, node_id, path, iri, type) of every object that gets an id.

    Objects of one field get none unless they are array items. The ontology
    ((field, text, iri), as a cascade gives it) comes first for products,
    hazards, groups and categories; then the rule's fields; then the hash of the
    object's scalar fields in the order of their names.
    """
    # An object meets its fields in one aggregation: each value is there once for itself, if it is an object, and once for the object that it is a field of.
    own = F.expr("kind = 'object' and (path <> '' or arr_ix is not null)")
    scalar = ~F.col("kind").isin("object", "array", "null")
    parts = F.array(
        F.when(own, F.struct("node_id", F.struct("path", "arr_ix").alias("self"), F.lit(None).cast("struct<key: string, value: string>").alias("field"))),
        F.when(F.col("arr_ix").isNull(), F.struct(F.col("parent_id").alias("node_id"), F.lit(None).cast("struct<path: string, arr_ix: int>").alias("self"), F.when(scalar, F.struct("key", "value")).alias("field"))),
    )
    held = nodes.select("model_id", F.inline(F.filter(parts, lambda x: x.isNotNull()))).groupBy("model_id", "node_id")
    met = held.agg(F.max("self").alias("self"), F.map_from_entries(F.array_sort(F.collect_list("field"))).alias("f"), F.count_if(F.col("self").isNull()).alias("size"))
    o = met.where("self is not null and (size > 1 or self.arr_ix is not null)").select("model_id", "node_id", "self.path", "self.arr_ix", "f")
    get = lambda name: F.nullif(F.element_at("f", F.lit(name)), F.lit(""))
    last = F.element_at(F.split("path", r"\."), -1)
    content = F.to_json("f")
    model = F.concat(F.lit(base), sanitize_iri(F.col("model_id")))
    section = F.col("path").isin(*SECTIONS) & F.col("arr_ix").isNull()
    # Which kind of id an object gets and from which of its fields; the text is made fit for an IRI once, at the end.
    kind, raw = F.when(section, F.col("path")), F.when(section, None)
    for key, (label, names, cut) in RULES.items():
        kind = kind.when(last == key, label)
        raw = raw.when(last == key, F.coalesce(*(F.substring(get(n), 1, cut) if cut and n != "doi" else get(n) for n in names), F.lit(None).cast("string")))
    kind = kind.otherwise(F.replace("path", F.lit("."), F.lit("/")))
    raw = raw.otherwise(F.coalesce(*(F.substring(get(n), 1, 50) for n in ANY)))
    ruled = section | last.isin(*RULES)
    chosen = computed(o, *o.columns, last.alias("last"), section.alias("section"), kind.alias("k"), raw.alias("raw"), F.concat(hash_id(content), F.when(~ruled & (F.col("arr_ix") > 0), F.concat(F.lit("_"), F.col("arr_ix"))).otherwise("")).alias("hash"))
    name = F.coalesce(F.nullif(sanitize_iri(F.col("raw")), F.lit("")), F.col("hash"))
    o, last, iri = chosen, F.col("last"), F.concat(model, F.lit("/"), F.col("k"), F.when(F.col("section"), "").otherwise(F.concat(F.lit("/"), name)))
    text = F.coalesce(*(F.when(last == k, get(v)) for k, v in FROM_ONTOLOGY.items()))
    out = o.select("model_id", "node_id", "path", iri.alias("minted"), F.when(F.col("path").isin(*SECTIONS), F.col("path")).alias("type"), last.alias("field"), text.alias("text"))
    if ontology is None:
        return out.select("model_id", "node_id", "path", F.col("minted").alias("iri"), "type")
    return out.join(ontology.select("field", "text", "iri"), ["field", "text"], "left").select("model_id", "node_id", "path", F.coalesce("iri", "minted").alias("iri"), "type")


def field_values(nodes: DataFrame, keys: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """J4. (category, field, text): distinct values of the fields of a vocabulary, scalars and items of lists alike."""
    entries = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("field")) for c, ks in keys.items() for k in ks))
    lookup = nodes.sparkSession.range(1).select(F.inline(entries))
    found = nodes.where("kind = 'string' and value <> ''").select(F.col("key").alias("field"), F.col("value").alias("text")).distinct()
    return found.join(F.broadcast(lookup), "field").select("category", "field", "text")


def mapped_values(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """J3. Nodes with ``iri`` where (key or its parent's key, value) is mapped by (field, text, iri)."""
    parents = nodes.select("model_id", F.col("node_id").alias("parent_id"), F.col("key").alias("parent_key"))
    m = mapping.groupBy("field", "text").agg(F.min("iri").alias("iri"))
    joined = nodes.join(parents, ["model_id", "parent_id"], "left")
    own = joined.join(m.select(F.col("field").alias("key"), F.col("text").alias("value"), F.col("iri").alias("own")), ["key", "value"], "left")
    both = own.join(m.select(F.col("field").alias("parent_key"), F.col("text").alias("value"), F.col("iri").alias("by_parent")), ["parent_key", "value"], "left")
    return both.select(*nodes.columns, F.when(F.col("kind") == "string", F.coalesce("own", "by_parent")).alias("iri"))


#: Contexts of up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_CONTEXT = 20_000


def with_context(nodes: DataFrame, context: DataFrame, vocab: str | None = None) -> DataFrame:
    """J2 (scoped contexts). Nodes with the property's iri: by (scope, key, iri), the nearest scope first, then the default vocabulary.

    A scope is the path of the object whose context defines a key, '' for the whole document. Keys that begin with '@' stay.
    """
    outer = F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    known = context.groupBy("scope", "key").agg(F.min("iri").alias("iri")).groupBy("key").agg(F.collect_list(F.struct(F.length("scope").alias("n"), "scope", "iri")).alias("known"))
    known = F.broadcast(known) if context.limit(BROADCAST_CONTEXT + 1).count() <= BROADCAST_CONTEXT else known
    # Only few keys are in the context, so each node takes all entries of its key and keeps the nearest.
    around = F.filter("known", lambda x: (x["scope"] == "") | F.concat(outer, F.lit(".")).startswith(F.concat(x["scope"], F.lit("."))))
    iri = F.when((F.col("key") != "") & F.col("known").isNotNull(), F.array_max(around)["iri"])
    default = F.when(F.col("key").startswith("@"), F.col("key")).otherwise(F.concat(F.lit(vocab), F.col("key")) if vocab else F.lit(None).cast("string"))
    return nodes.join(known, "key", "left").select(*nodes.columns, F.coalesce(iri, F.when(F.col("key") != "", default)).alias("property"))


def to_triples(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples (s, p, o, o_kind) of nodes with ``property``: objects by their id, else by a blank node that follows from model and place."""
    # Both joins are by sorted runs: their sides grow with the documents, and one that looks small when packed would be spread by way of the driver.
    objects = nodes.where("kind = 'object'").select("model_id", "node_id", "owner_id", "property")
    named = objects.join(ids.select("model_id", "node_id", F.col("iri").alias("id")).hint("merge"), ["model_id", "node_id"], "left")
    me = F.coalesce("id", F.concat(F.lit("_:b"), F.substring(F.md5(F.concat_ws("|", "model_id", "node_id")), 1, 16)))
    known = named.select("model_id", "node_id", "owner_id", "property", me.alias("me"))
    held = known.select("model_id", "owner_id", F.col("property").alias("p"), F.col("me").alias("o"), F.when(F.col("me").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"))
    said = nodes.where("kind not in ('object', 'array', 'null')").select("model_id", "owner_id", F.col("property").alias("p"), F.col("value").alias("o"), F.lit("literal").alias("o_kind"))
    owners = known.select("model_id", F.col("node_id").alias("owner_id"), F.col("me").alias("s"))
    return held.unionByName(said).where("p is not null").join(owners.hint("merge"), ["model_id", "owner_id"]).select("s", "p", "o", "o_kind").distinct()


def expand(value: object, context: Mapping[str, object]) -> object:
    """A JSON-LD value with all keys, types and ids in full; a key with a context of its own opens a scope. Keys that stand for nothing are left out; what isn't JSON-LD raises ValueError."""
    if isinstance(value, list):
        return [expand(v, context) for v in value]
    if not isinstance(value, dict):
        return value
    if "@context" in value:
        context = _merged(context, value["@context"])
    if "@value" in value:
        if isinstance(value["@value"], (dict, list)):
            raise ValueError("@value is no scalar")
        return {k: _iri(v, context) if k == "@type" else v for k, v in value.items()}
    out: dict[str, object] = {}
    for key, v in value.items():
        if key == "@context":
            continue
        if key == "@id":
            if not isinstance(v, str):
                raise ValueError("@id is no text")
            out[key] = _iri(v, context)
        elif key == "@type":
            types = v if isinstance(v, list) else [v]
            if not all(isinstance(t, str) for t in types):
                raise ValueError("@type is no text")
            out[key] = [_iri(t, context, True) for t in types]
        elif key.startswith("@"):
            out[key] = expand(v, context)
        else:
            term = context.get(key)
            iri = _iri(key, context, True)
            inner = _merged(context, term["@context"]) if isinstance(term, dict) and "@context" in term else context
            if ":" in iri:
                held = expand(v, inner)
                held = [_iri(x, context) if isinstance(x, str) else x for x in (held if isinstance(held, list) else [held])] if isinstance(term, dict) and term.get("@type") == "@id" else held
                out[iri] = held if isinstance(held, list) else [held]
    return out


def _merged(context: Mapping[str, object], more: object) -> dict[str, object]:
    out = dict(context)
    for part in more if isinstance(more, list) else [more]:
        if part is None:
            out = {}
        elif isinstance(part, dict):
            out.update(part)
        elif not isinstance(part, str):
            raise ValueError("@context is neither an object nor an address")
    return out


def _iri(term: str, context: Mapping[str, object], vocab: bool = False) -> str:
    for _ in range(len(context) + 1):
        known = context.get(term) if not term.startswith("@") else None
        known = known.get("@id") if isinstance(known, dict) else known
        if vocab and isinstance(known, str) and known != term:
            term = known
            continue
        prefix, colon, local = term.partition(":")
        at = context.get(prefix)
        at = at.get("@id") if isinstance(at, dict) else at
        if colon and not local.startswith("//") and isinstance(at, str):
            return _iri(at, context, True) + local if at != prefix else term
        return term if colon or term.startswith("@") or not vocab else str(context.get("@vocab") or "") + term
    raise ValueError(f"the context goes round at {term!r}")


def compact(value: object, context: Mapping[str, object]) -> object:
    """The reverse of ``expand`` for one context: full keys by their terms or prefixes, single values without their list."""
    names = {_iri(k, context, True): k for k in context if not k.startswith("@")}
    spaces = sorted(((full, k) for full, k in names.items() if full[-1:] in "/#:"), reverse=True)

    def short(iri: str) -> str:
        if iri in names:
            return names[iri]
        vocab = context.get("@vocab")
        if isinstance(vocab, str) and iri.startswith(vocab):
            return iri[len(vocab) :]
        return next((f"{k}:{iri[len(full) :]}" for full, k in spaces if iri.startswith(full)), iri)

    if isinstance(value, list):
        return [compact(v, context) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        v = [short(t) for t in v] if k == "@type" and isinstance(v, list) else compact(v, context)
        out[k if k.startswith("@") else short(k)] = v[0] if isinstance(v, list) and len(v) == 1 else v
    return out


def validity(files: DataFrame, name: str, doc: str) -> DataFrame:
    """J10/K6. (name, valid, message): whether a document is JSON-LD: it is expanded, compacted by its own context and expanded again, and has to come out the same."""

    def check(text: str) -> None:
        top = json.loads(text)
        if not isinstance(top, (dict, list)):
            raise ValueError("neither an object nor a list")
        context = _merged({}, top.get("@context", {})) if isinstance(top, dict) else {}
        full = expand(top, {})
        again = compact(full, context)
        # Keys that are in full after the first pass stay so; a scoped context may only be lost where it changed a key.
        if expand(again if isinstance(again, list) else {"@context": context, **again}, {}) != full and not any(isinstance(v, dict) and "@context" in v for v in context.values()):
            raise ValueError("compaction doesn't give the document back")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, text in zip(b["name"], b["doc"]):
                try:
                    check(text)
                    out.append((n, True, "valid"))
                except RecursionError:
                    out.append((n, False, "nested too deep"))
                except (TypeError, ValueError) as e:
                    out.append((n, False, str(e)[:200]))
            yield pd.DataFrame(out, columns=["name", "valid", "message"])

    return files.select(F.col(name).cast("string").alias("name"), F.col(doc).cast("string").alias("doc")).mapInPandas(run, "name string, valid boolean, message string")


def is_joined(files: DataFrame) -> DataFrame:
    """J6. (archive, joined): more than one metadata file, or a model file that lists submodels. ``files``: archive, member, text."""
    meta = F.lower("member").rlike(r"(^|/)metadata\.json$")
    return files.groupBy("archive").agg(((F.count_if(meta) > 1) | F.coalesce(F.bool_or(F.col("text").contains("comp:listOfSubmodels")), F.lit(False))).alias("joined"))


def models_by_directory(files: DataFrame) -> DataFrame:
    """J7. (archive, member, model): the name of the directory that holds each metadata file; files at the top have none."""
    parts = F.split("member", "/")
    return files.where(F.lower("member").rlike(r"/metadata\.json$")).select("archive", "member", F.get(parts, F.size(parts) - 2).alias("model"))


def nearest_metadata(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """J-near/J9. (archive, member, metadata): for each model file the metadata file in its own or the nearest upper directory, the first by order.

    Every upper directory becomes a row, so the search is an equi-join.
    """
    steps = F.split(F.regexp_replace("member", "/?[^/]*$", ""), "/")
    up = models.select("archive", "member", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("depth", "dir")).distinct()
    m = metadata.select("archive", F.regexp_replace("member", "/?[^/]*$", "").alias("dir"), F.col("member").alias("metadata"), "ord")
    w = Window.partitionBy("archive", "member").orderBy(F.length("dir").desc(), "ord")
    return up.join(m, ["archive", "dir"]).withColumn("n", F.row_number().over(w)).where("n = 1").select("archive", "member", "metadata")


def parameter_links(links: DataFrame, aliases: DataFrame, parameters: DataFrame) -> DataFrame:
    """J5. (target, source) iris of linked parameters: aliases to models, ids matched without their last digits.

    ``links``: target_alias, target_param, source_alias, source_param; ``aliases``: alias, model_id; ``parameters``: model_id, param_id, iri.
    """
    p = parameters.select("model_id", strip_digits(F.col("param_id")).alias("stem"), "iri").groupBy("model_id", "stem").agg(F.min("iri").alias("iri"))
    side = lambda df, x: df.join(aliases.select(F.col("alias").alias(f"{x}_alias"), F.col("model_id").alias(f"{x}_model")), f"{x}_alias").withColumn(f"{x}_stem", strip_digits(F.col(f"{x}_param"))).join(
        p.select(F.col("model_id").alias(f"{x}_model"), F.col("stem").alias(f"{x}_stem"), F.col("iri").alias(x)), [f"{x}_model", f"{x}_stem"]
    )
    return side(side(links, "target"), "source").select("target", "source").distinct()


def composite(model: DataFrame, parts: DataFrame, links: DataFrame, kind: str, voc: Vocabulary) -> DataFrame:
    """J5. Triples (s, p, o, o_kind) of composite models: their type, their parts, and what parameters are informed by.

    ``model``: (iri) of the composites, ``parts``: (composite, part) iris, ``links``: (target, source) of ``parameter_links``.
    """
    iri = F.lit("iri").alias("o_kind")
    typed = model.select(F.col("iri").alias("s"), F.lit(voc.type).alias("p"), F.lit(kind).alias("o"), iri)
    held = parts.select(F.col("composite").alias("s"), F.lit(voc.has_part).alias("p"), F.col("part").alias("o"), iri)
    informed = links.select(F.col("target").alias("s"), F.lit(voc.informed_by).alias("p"), F.col("source").alias("o"), iri)
    return typed.unionByName(held).unionByName(informed).distinct()


def in_both(models: DataFrame, processed: DataFrame) -> DataFrame:
    """U3. (model_id) known and processed: the intersection."""
    return models.select("model_id").intersect(processed.select("model_id"))


def statuses(models: DataFrame, processed: DataFrame) -> DataFrame:
    """J18/U3. (model_id, title, status): new, processed or only processed; the title falls back to the source file, then the id."""
    done = processed.select("model_id").distinct().withColumn("done", F.lit(True))
    joined = models.withColumn("known", F.lit(True)).join(done, "model_id", "full")
    status = F.when(F.col("known").isNull(), "only processed").when(F.col("done"), "processed").otherwise("new")
    return joined.select("model_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("source_file", F.lit("")), "model_id").alias("title"), status.alias("status"))
