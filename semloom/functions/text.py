"""String, IRI and similarity functions, as column expressions (and Arrow UDFs where Spark has no built-in)."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Words that don't count when token sets are compared.
MATCH_STOPWORDS = ("sp", "spp", "cf", "strain", "subsp", "serovar", "serotype")


#: White space as regular expressions of Java and of SQL engines both read it.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without the white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """X1. 1 - distance / longer length, of lower-cased texts; two empty texts are equal (1), a null gives 0."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    score = F.when(longer == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(x, y).cast("double") / longer.cast("double"))
    return F.coalesce(score, F.lit(0.0))


def levenshtein_at_least(a: Column, b: Column, least: float) -> Column:
    """Whether the similarity X1 is at least ``least``: cheap length test, then a distance that stops at the bound, then the exact score."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    bound = F.floor(longer * (1 - least) + 1e-9).cast("int")
    near = F.abs(F.length(x) - F.length(y)) <= bound
    return near & (F.call_function("levenshtein", x, y, bound) >= 0) & (levenshtein_similarity(a, b) >= least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def hybrid_score(full_cos: Column, label_cos: Column, lev: Column, weights: Sequence[float] = (0.5, 0.2, 0.3)) -> Column:
    """X2. Weighted sum of the cosine of label and description, of the label alone, and the edit similarity."""
    return full_cos * weights[0] + label_cos * weights[1] + lev * weights[2]


def embedding_text(label: Column, description: Column) -> Column:
    """X3. ``label description`` trimmed, or the label where there is no description."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.trim(F.concat_ws(" ", label, description))).otherwise(F.coalesce(label, F.lit("")))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X4. Ratio of matching blocks of two texts (order counts); null gives 0."""
    out, matcher, last = [], difflib.SequenceMatcher(None), None
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(0.0)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that ``sequence_ratio`` can be, by length alone; a cheap filter before the UDF."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).lower())


def normalize(c: Column) -> Column:
    """X5. Compatibility forms, white space collapsed and trimmed, lower case. ASCII texts never leave the JVM."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")))
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_nfkc(c))


def normalize_ascii(c: Column) -> Column:
    """X5 for texts known to be ASCII: no UDF in the plan."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")))


def tokens(normal: Column) -> Column:
    """X6. Runs of a-z and 0-9 of a normalised text, without the words that don't count."""
    return F.filter(F.split(normal, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*MATCH_STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """X7. Of two token arrays taken as sets; two empty sets are equal (1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def keyword_tokens(c: Column) -> Column:
    """Set of the words longer than two letters, nine marks taken as blanks."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(c), "_-()[]/,.", "         "), WHITE + "+"), lambda t: F.length(t) > 2))


def keyword_overlap(a: Column, b: Column) -> Column:
    """X8. Over all pairs of two keyword sets: 1 for equal words, 0.8 where one holds the other."""
    pair = lambda x, y: F.when(x == y, 1.0).when(y.contains(x) | x.contains(y), 0.8).otherwise(0.0)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + pair(x, y)))


# What stands in an IRI for the characters that can't.
IRI_WORDS = {"@": "_at_", "&": "_and_", "%": "_percent_", "+": "_plus_", "=": "_eq_"}
IRI_UNDERSCORES = " /\\.,:;#()[]{}<>|*"
IRI_DROPPED = "!?\"'"


def sanitize_iri(c: Column) -> Column:
    """X12. A text fit as part of an IRI; null and '' give ''."""
    text = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), IRI_WORDS.items(), F.coalesce(c.cast("string"), F.lit("")))
    text = F.translate(text, IRI_UNDERSCORES + IRI_DROPPED, "_" * len(IRI_UNDERSCORES))
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")
    return F.substring(text, 1, 100)


def slugify(c: Column) -> Column:
    """X13. Without marks, trimmed, lower case, runs of blanks and hyphens as one hyphen."""
    kept = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s-]", ""), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(kept, r"(?U)[-\s]+", "-")


def hash_id(c: Column) -> Column:
    """X14. First eight digits of the MD5 of a text (of a struct: of its JSON, keys in the struct's order)."""
    return F.substring(F.md5(c), 1, 8)


def cache_name(c: Column) -> Column:
    """X15. File name of a cached item."""
    return F.regexp_replace(c, r"(?U)[^\w\-]", "_")


def display_label(term: Column, alt: Column) -> Column:
    """X16. ``term (alt)``, or the term alone."""
    return F.when(F.trim(F.coalesce(alt, F.lit(""))) != "", F.concat(term, F.lit(" ("), alt, F.lit(")"))).otherwise(term)


def hundredths(c: Column) -> Column:
    """A number with two decimals, rounded as C and Python do: by its exact binary value, exact ties to the even hundredth.

    The JVM rounds the shortest decimal form instead. ``200 x`` is odd for
    numbers half way; whether rounding made it so shows the sum of two products
    that are exact, as the parts of x have 24 and 29 bits.
    """
    x = F.abs(c.cast("double"))
    twice = F.floor(x * 200)
    high = x.cast("float").cast("double")
    over = (high * 200 - twice) + (x - high) * 200
    down = F.floor(twice / 2)
    tie = F.when(over > 0, down + 1).when(over < 0, down).otherwise(down + F.pmod(down, F.lit(2)))
    n = F.when((x * 200 == twice) & (F.pmod(twice, F.lit(2)) == 1), tie).otherwise(F.floor((twice + 1) / 2))
    sign = F.when(F.format_string("%f", c.cast("double")).startswith("-"), "-").otherwise("")
    return F.when(x < 1e9, F.concat(sign, F.format_string("%d.%02d", F.floor(n / 100), F.pmod(n, F.lit(100))))).otherwise(F.format_string("%.2f", c.cast("double")))


def suggestion_display(label: Column, source: Column, lev: Column, description: Column, uri: Column) -> Column:
    """X17. ``label [source] [Lev: 0.87] (description...) <uri>``; parts that are null or empty are left out."""
    cut = F.when(F.length(description) > 100, F.concat(F.substring(description, 1, 100), F.lit("..."))).otherwise(description)
    some = lambda c, shown: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", shown)
    return F.concat_ws(
        " ", F.coalesce(label, F.lit("N/A")), some(source, F.concat(F.lit("["), source, F.lit("]"))), some(lev, F.concat(F.lit("[Lev: "), hundredths(lev), F.lit("]"))),
        some(description, F.concat(F.lit("("), cut, F.lit(")"))), F.concat(F.lit("<"), F.coalesce(F.nullif(uri, F.lit("")), F.lit("No URI")), F.lit(">")),
    )


def local_name(uri: Column) -> Column:
    """X18. What follows the last slash, and of that what follows the last hash."""
    return F.substring_index(F.substring_index(uri, "/", -1), "#", -1)


def path_tail(url: Column) -> Column:
    """X19. Last segment of a URL's path."""
    return F.substring_index(F.try_parse_url(url, F.lit("PATH")), "/", -1)


def uri_namespace(uri: Column) -> Column:
    """X20. All before the last slash."""
    return F.when(uri.contains("/"), F.regexp_replace(uri, "/[^/]*$", "")).otherwise("")


def comma_list(c: Column) -> Column:
    """X21. Trimmed, non-empty parts between commas; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def strip_digits(c: Column) -> Column:
    """X22. Without the digits at its end."""
    return F.regexp_replace(c, r"\d+$", "")


# Record pages of the databases of one provider.
NCBI_PAGES = {
    "taxonomy": "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=%s",
    "sra": "https://www.ncbi.nlm.nih.gov/sra?term=%s",
    "pubmed": "https://pubmed.ncbi.nlm.nih.gov/%s/",
}


def ncbi_uri(db: Column, ident: Column) -> Column:
    """X23. Page of a record; null without an id."""
    page = reduce(lambda w, kv: w.when(db == kv[0], F.format_string(kv[1], ident)), NCBI_PAGES.items(), F.when(F.coalesce(ident, F.lit("")) == "", None))
    return page.otherwise(F.concat(F.lit("https://www.ncbi.nlm.nih.gov/"), db, F.lit("/"), ident))


def mint(base: str, model_id: Column, kind: str, fields: Sequence[Column], fallback: Column, cut: int | None = None) -> Column:
    """X24. ``base model/kind/name`` from the first non-empty field (cut before it is sanitised), else from the fallback's hash."""
    named = [F.nullif(sanitize_iri(F.substring(f.cast("string"), 1, cut) if cut else f), F.lit("")) for f in fields]
    return F.concat(F.lit(base), sanitize_iri(model_id), F.lit(f"/{kind}/"), F.coalesce(*named, hash_id(fallback)))


def core_iri(base: str, ident: Column) -> Column:
    """X24. The identifier where it is an IRI, else one minted from it; null without one."""
    return F.when(ident.rlike("^https?://"), ident).when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit(base), sanitize_iri(F.regexp_replace(ident, "^/+", ""))))


def expand_prefixed(iri: Column, prefix: str, base: str, only: str) -> Column:
    """X26. ``prefix:name`` in full where the name holds ``only``."""
    return F.when(iri.startswith(prefix + ":") & iri.contains(only), F.replace(iri, F.lit(prefix + ":"), F.lit(base))).otherwise(iri)


def turtle_literal(value: Column, lang: Column) -> Column:
    """X27. A literal as Turtle; long quotes where it holds line breaks or quotes."""
    tag = F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("@"), lang)).otherwise("")
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    long_ = value.contains("\n") | value.contains("\r") | value.contains('"')
    return F.concat(F.when(long_, F.concat(F.lit('"""'), escaped, F.lit('"""'))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'))), tag)


def turtle_iri(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """X27. ``prefix:name`` by the first prefix that fits and leaves a plain name, else in angle brackets; never shortened where it holds '?'."""
    out = F.when(iri.contains("?"), F.concat(F.lit("<"), iri, F.lit(">")))
    for p, ns in prefixes.items():
        rest = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
        out = out.when(iri.startswith(ns) & rest.rlike(r"^[A-Za-z_][\w-]*$"), F.concat(F.lit(p + ":"), rest))
    return out.otherwise(F.concat(F.lit("<"), iri, F.lit(">")))
