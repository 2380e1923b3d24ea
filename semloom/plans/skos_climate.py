"""Queries of vocabularies, wide tables, series and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.functions.text import comma_list
from semloom.operators import climate as C
from semloom.operators import skos as K
from semloom.plans.graph import T as TRIPLES
from semloom.plans.graph import V, full, triples
from semloom.plans.query import Queries, sql_slug, sql_strip

query = Queries()
_LONG = f"""l as (select row_id, i as ord, {sql_strip("u")} as uri from (select row_id, unnest([1, 2, 3]) as i, unnest([uri1, uri2, uri3]) as u from master_mapping) where u is not null and lower({sql_strip("u")}) not in ('', 'nan'))"""
URIS = ("uri1", "uri2", "uri3")


@query(f"with {_LONG} select row_id, cast(ord as integer) as ord, uri from l")
def f12_long_uris(load):
    return K.long_uris(load("master_mapping"), "row_id", URIS)


@query("select row_id, coalesce(nullif(uri1, ''), nullif(uri2, ''), nullif(uri3, '')) as uri from master_mapping where conceptgroup in ('Unit', 'Parameter', 'InputParameter')")
def f10_first_uri(load):
    """F9/F10."""
    return load("master_mapping").where(F.col("conceptgroup").isin("Unit", "Parameter", "InputParameter")).select("row_id", K.first_uri(URIS).alias("uri"))


@query(f"with {_LONG} select uri, min(row_id) as row_id from l group by uri")
def f11_reverse_lookup(load):
    return K.first_row_by_uri(load("master_mapping"), "row_id", URIS)


@query("select row_id, case when contains(lower(conceptgroup), 'unit') then 'unit' when contains(lower(conceptgroup), 'input') or contains(lower(conceptgroup), 'output') then 'io' when contains(lower(conceptgroup), 'param') then 'parameter' end as kind from master_mapping")
def f16_vocabulary_type(load):
    types = {"unit": ("#none", ["unit"]), "io": ("#none", ["input", "output"]), "parameter": ("#none", ["param"])}
    return load("master_mapping").select("row_id", K.vocabulary_type(F.col("conceptgroup"), types).alias("kind"))


@query("""select provider, min(uri) as a, max(uri) as b, substr(min(uri), 1, coalesce(list_max(list_filter(generate_series(1, length(min(uri))), lambda i: substr(min(uri), 1, i) = substr(max(uri), 1, i))), 0)) as base
from suggestion where uri is not null group by provider""")
def a13_common_prefix(load):
    s = load("suggestion").where("uri is not null")
    return s.groupBy("provider").agg(F.min("uri").alias("a"), F.max("uri").alias("b"), K.common_prefix(F.col("uri")).alias("base"))


def _wide(load) -> DataFrame:
    m = load("master_mapping")
    empty = F.array().cast("array<string>")
    return m.select("row_id", "term", F.col("altlabels").alias("alt_label"), F.col("conceptgroup").alias("concept_group"), F.when(F.coalesce("providerterm1", F.lit("")) != "", F.array("providerterm1")).otherwise(empty).alias("definitions"), empty.alias("sources"))


@query(TRIPLES + full(f""", m as (select *, list_filter(list_transform(string_split(coalesce(altlabels, ''), ','), lambda x: {sql_strip("x")}), lambda x: x <> '') as alts from master_mapping
  where {sql_strip("coalesce(term, '')")} <> ''),
c as (select s from triples where p = 'rdf:type' and o = 'skos:Concept'),
pn as (select o, min(s) as s from triples where p = 'skos:prefLabel' and s in (select s from c) group by 1), an as (select o, min(s) as s from triples where p = 'skos:altLabel' and s in (select s from c) group by 1),
ba as (select term, min(an.s) as s from (select term, unnest(alts) as alt from m) x join an on an.o = x.alt group by 1),
mi as (select term, arg_min('https://sem.example/concept/' || case when {sql_strip("coalesce(conceptgroup, '')")} <> '' then {sql_slug("conceptgroup")} || '/' else '' end || {sql_slug("term")}, row_id) as s from m group by 1)
select mi.term, coalesce(pn.s, ba.s, mi.s) as concept, (pn.s is null and ba.s is null) as is_new from mi left join pn on pn.o = mi.term left join ba on ba.term = mi.term"""))
def j12_concept_of_term(load):
    """J12. The concept that each term of the wide table goes to, and whether it is new."""
    t = triples(load)
    up = K.upsert(_wide(load).withColumn("definitions", F.array("term")).withColumn("alt_label", F.col("alt_label")), t, "https://sem.example/")
    return up.where(F.col("p") == V.definition).select(F.col("o").alias("term"), F.col("s").alias("concept"), "is_new")


@query()
def j12_upsert(load):
    """J12. All triples that the wide table adds."""
    return K.upsert(_wide(load), triples(load), "https://sem.example/")


@query("""with new as (select distinct 'c:' || term_id as s, uri, regexp_replace(uri, '/[^/]*$', '') as ns from suggestion where regexp_matches(uri, '^https?://') and provider = 'olx'),
old as (select 'c:' || term_id as s, min(uri) as uri, list(distinct uri) as all_old, regexp_replace(uri, '/[^/]*$', '') as ns from suggestion where regexp_matches(uri, '^https?://') and provider = 'localgraph' group by 1, 4),
f as (select new.*, old.uri as held, old.all_old, min(new.uri) over (partition by new.s, new.ns) as first_new from new left join old using (s, ns))
select s, 'http://www.w3.org/2004/02/skos/core#exactMatch' as p, coalesce(held, first_new) as existing_uri, uri as new_uri from f where uri <> coalesce(held, first_new) and not coalesce(list_contains(all_old, uri), false)""")
def j13_conflicts(load):
    """J13. Mappings of one provider that conflict with those of another."""
    s = load("suggestion").where(F.col("uri").rlike("^https?://")).withColumn("s", F.concat(F.lit("c:"), "term_id"))
    new = s.where("provider = 'olx'").select("s", F.lit(" SKOS:exactMatch ").alias("match_type"), "uri")
    old = s.where("provider = 'localgraph'").select("s", F.lit(V.matches[0]).alias("p"), F.col("uri").alias("o"))
    return K.conflicts(new, old)


@query(full("""with t as (select distinct 'map:' || row_id as s, 'skos:exactMatch' as p, uri1 as o from master_mapping where uri1 <> ''),
c as (select distinct s, p, o as existing_uri, o || '#new' as new_uri, list_extract(['keep', 'replace', 'both'], cast(1 + cast(substr(s, 5) as bigint) % 3 as integer)) as choice from t)
select s, p, o from t where not exists (select 1 from c where c.s = t.s and choice = 'replace') union select s, p, new_uri from c where choice = 'replace' union select s, 'skos:closeMatch', new_uri from c where choice = 'both'"""))
def j14_resolution(load):
    t = load("master_mapping").where("uri1 <> ''").select(F.concat(F.lit("map:"), "row_id").alias("s"), F.lit(V.matches[0]).alias("p"), F.col("uri1").alias("o"), (F.col("row_id") % 3).alias("r"))
    choice = F.element_at(F.array(*map(F.lit, ("keep", "replace", "both"))), (F.col("r") + 1).cast("int"))
    choices = t.select("s", "p", F.col("o").alias("existing_uri"), F.concat("o", F.lit("#new")).alias("new_uri"), choice.alias("choice"))
    return K.resolved(t.drop("r"), choices)


@query("""with l(ns, prefix, i) as (values ('https://vocab.agrisem.example/class/', 'FPX', 0), ('https://vocab.agrisem.example/class/', 'HZX', 1), ('https://entity.wikiterm.example/entity/', 'wte', 0), ('https://vocab.agrisem.example/', 'agrisem', 0)),
u as (select distinct uri from suggestion where uri is not null), p as (select l.*, uri, case when starts_with(lower(substr(uri, length(ns) + 1)), lower(prefix)) then 1 else 0 end as hit from u join l on starts_with(uri, ns)),
s as (select ns, prefix, i, sum(hit) as hits, count(*) over (partition by ns) as names from p group by 1, 2, 3),
k as (select *, case when names = 1 then 3 when hits > 0 then 2 when contains(lower(regexp_extract(ns, 'https?://([^/]+)', 1)), lower(prefix)) then 1 end as kind from s),
c as (select ns, prefix from k where kind is not null qualify row_number() over (partition by ns order by kind desc, hits desc, length(prefix) desc, i) = 1),
o as (select uri, arg_max(c.ns, length(c.ns)) as ns, arg_max(c.prefix, length(c.ns)) as prefix from p join c on c.ns = p.ns group by uri),
g as (select ns, prefix, min(uri) as a, max(uri) as b, count(*) as n from o group by 1, 2),
h as (select *, regexp_extract(substr(a, 1, coalesce(list_max(list_filter(generate_series(1, length(a)), lambda j: substr(a, 1, j) = substr(b, 1, j))), 0)), '^(.*[/#])', 1) as cut from g)
select prefix, case when n > 1 and length(cut) > length(ns) then cut else ns end as namespace, n as uris from h qualify row_number() over (partition by prefix order by length(ns) desc, ns desc) = 1""")
def j15_prefixes(load):
    """J15. Prefixes for all uris of the suggestions, of a list with an ambiguous namespace."""
    s = load("suggestion")
    listed = s.sparkSession.createDataFrame([("https://vocab.agrisem.example/class/", "FPX", 0), ("https://vocab.agrisem.example/class/", "HZX", 1), ("https://entity.wikiterm.example/entity/", "wte", 2), ("https://vocab.agrisem.example/", "agrisem", 3)], "namespace string, prefix string, ord long")
    return K.assign_prefixes(s.select("uri").where("uri is not null"), listed)


@query()
def k3_turtle(load):
    """K3. The vocabulary as Turtle blocks."""
    t = triples(load)
    return K.turtle(t.where(~F.col("s").startswith("map:")), {"agr": "https://vocab.agrisem.example/class/"})


_B = {"D": "cast(ts as date)", "W": "cast(date_trunc('week', ts) as date) + 6", "M": "last_day(ts)", "Y": "make_date(year(ts), 12, 31)"}


def _resample_sql(freq: str, fill: bool = False) -> str:
    return f"select cast(cast({_B[freq]} as date) as varchar) as bucket, round(avg(case when not isnan(value) then value end), 6) as mean, count(case when not isnan(value) then 1 end) as n from events where ts is not null group by 1"


def _resampled(load, freq: str) -> DataFrame:
    return C.resample(load("events"), "ts", "value", freq).select(F.col("bucket").cast("string").alias("bucket"), F.round("mean", 6).alias("mean"), "n")


for _f in "DWMY":
    query(_resample_sql(_f), f"a1_resample_{_f.lower()}")(lambda load, f=_f: _resampled(load, f))


@query("""with b as (select user_id % 50 as k, cast(ts as date) as bucket, avg(value) as mean, count(value) as n from events group by 1, 2), s as (select k, min(bucket) as a, max(bucket) as z from b group by 1),
c as (select k, cast(unnest(generate_series(a, z, interval 1 day)) as date) as bucket from s)
select k, cast(bucket as varchar) as bucket, round(mean, 6) as mean, coalesce(n, 0) as n from c left join b using (k, bucket)""")
def a1_gapfill(load):
    """A1 with empty buckets, per group of users."""
    e = load("events").withColumn("k", F.col("user_id") % 50)
    return C.resample(e, "ts", "value", "D", ["k"], fill=True).select("k", F.col("bucket").cast("string").alias("bucket"), F.round("mean", 6).alias("mean"), "n")


@query("""select cast(cast(ts as date) as varchar) as day, round(sum(value * cos(radians(user_id % 90))) / sum(cos(radians(user_id % 90))), 6) as mean from events where value is not null and not isnan(value) group by 1""")
def a2_weighted_mean(load):
    e = load("events")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(C.weighted_mean(F.col("value"), F.col("user_id") % 90), 6).alias("mean"))


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90, min(value) as least, max(value) as greatest from events where not isnan(value) and abs(value) < 'infinity'::double group by 1""")
def a3_statistics(load):
    s = C.statistics(load("events"), "value", ["event_type"])
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p10", "p90")), "least", "greatest")


@query("select user_id % 20 as y, user_id % 30 as x, round(avg(value), 6) as mean from events group by 1, 2")
def a4_cell_mean(load):
    e = load("events")
    return e.groupBy((F.col("user_id") % 20).alias("y"), (F.col("user_id") % 30).alias("x")).agg(F.round(F.avg(C.number(F.col("value"))), 6).alias("mean"))


@query("select event_id, round(case when (select avg(value + 250) from events) > 200 then value + 250 - 273.15 else value + 250 end, 6) as value from events")
def a5_to_celsius(load):
    e = load("events").select("event_id", (F.col("value") + 250).alias("value"))
    return C.to_celsius(e, "value").select("event_id", F.round("value", 6).alias("value"))


@query("select event_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-13'")
def f14_time_slice(load):
    return load("events").where(C.in_days(F.col("ts"), "2024-01-05", "2024-01-12")).select("event_id")


@query("select o_orderkey from orders where (o_orderpriority like '1%' and year(o_orderdate) between 1992 and 1994) or (o_orderpriority like '2%' and year(o_orderdate) between 1995 and 1998)")
def f15_valid_years(load):
    o = load("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).alias("e"))
    ranges = o.sparkSession.createDataFrame([("1", 1992, 1994), ("2", 1995, 1998)], "experiment string, first_year int, last_year int")
    return C.valid_years(o, "y", "e", ranges).select("o_orderkey")


_BOX = "select c_custkey, c_acctbal / 60 as y, c_acctbal / 20 as x from customer"


@query(f"""with b as ({_BOX}), p as (select c_custkey, y + 0.3 as n, y - 0.2 as s, x - 0.4 as w, x + 0.1 as e from b),
q as (select c_custkey, greatest(least(n, 90.0), -90.0) as n, greatest(least(s, 90.0), -90.0) as s, (w + 180) - 360 * floor((w + 180) / 360) - 180 as w, (e + 180) - 360 * floor((e + 180) / 360) - 180 as e from p),
r as (select c_custkey, greatest(n, s) as n, least(n, s) as s, least(w, e) as w, greatest(w, e) as e from q)
select c_custkey, round(case when n - s >= 0.55 then n else (n + s) / 2 + 0.275 end, 6) as n, round(case when e - w >= 0.55 then w else (w + e) / 2 - 0.275 end, 6) as w, round(case when n - s >= 0.55 then s else (n + s) / 2 - 0.275 end, 6) as s, round(case when e - w >= 0.55 then e else (w + e) / 2 + 0.275 end, 6) as e from r""")
def g1_boxes(load):
    """G1-G4. Box of a small polygon about each point, made sane and of a least size."""
    c = load("customer").select("c_custkey", (F.col("c_acctbal") / 60).alias("y"), (F.col("c_acctbal") / 20).alias("x"))
    corner = lambda dx, dy: F.concat((F.col("x") + dx).cast("decimal(20,10)").cast("string"), F.lit(" "), (F.col("y") + dy).cast("decimal(20,10)").cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), corner(-0.4, -0.2), F.lit(", "), corner(0.1, -0.2), F.lit(", "), corner(0.1, 0.3), F.lit(", "), corner(-0.4, 0.3), F.lit(", "), corner(-0.4, -0.2), F.lit("))"))
    boxed = c.select("c_custkey", C.bbox(wkt).alias("b")).select("c_custkey", C.sane(F.col("b")).alias("b")).select("c_custkey", C.at_least(F.col("b"), 0.55).alias("b"))
    return boxed.select("c_custkey", *(F.round(f"b.{k}", 6).alias(k) for k in "nwse"))


@query("""select c_custkey, 'diamond' as region from customer where abs(c_acctbal / 100 - 20) + abs((c_custkey % 90) - 40) < 30""")
def g5_clip(load):
    """G5. Points within a polygon."""
    c = load("customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 90).cast("double").alias("y"))
    regions = c.sparkSession.createDataFrame([("diamond", "POLYGON ((-10 40, 20 70, 50 40, 20 10, -10 40))")], "region string, wkt string")
    return C.clip(c, regions).select("c_custkey", "region")


@query("""with c as (select c_custkey, radians(c_custkey % 40 - 20) as a, radians(c_custkey % 60 - 30) as b, radians(39.25) as p from customer)
select c_custkey, round(degrees(asin(sin(p) * sin(a) + cos(p) * cos(a) * cos(b))), 6) as lat,
  round((d + 180) - 360 * floor((d + 180) / 360) - 180, 6) as lon from (select *, degrees(atan2(cos(a) * sin(b), sin(p) * cos(a) * cos(b) - cos(p) * sin(a))) - 162.0 + 180 as d from c)""")
def g6_rotated(load):
    """G6. Latitude and longitude of cells of a grid with a rotated pole."""
    c = load("customer").select("c_custkey", (F.col("c_custkey") % 40 - 20).alias("rlat"), (F.col("c_custkey") % 60 - 30).alias("rlon"))
    lat, lon = C.from_rotated(F.col("rlat"), F.col("rlon"), 39.25, -162.0)
    return c.select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("""select o_custkey, date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) as days, array_to_string(list_filter(['D', case when date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) > 7 then 'W' end, case when date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) > 30 then 'M' end, case when date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) > 365 then 'Y' end], lambda x: x is not null), ',') as scales from orders group by 1""")
def g7_time_scales(load):
    o = load("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return o.select("o_custkey", F.date_diff("b", "a").cast("long").alias("days"), F.array_join(C.time_scales(F.col("a"), F.col("b")), ",").alias("scales"))


QUERIES, SQL = query.queries, query.sql
