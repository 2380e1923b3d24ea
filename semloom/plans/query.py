"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semloom.functions.text import WHITE
from semloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def sql_strip(c: str) -> str:
    """SQL for ``functions.text.strip``."""
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def sql_normalize(c: str) -> str:
    """SQL for ``functions.text.normalize``: compatibility forms of blanks and of full-width marks, composed letters, one blank between words, lower case."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    return f"trim(regexp_replace(lower(nfc_normalize(translate({c}, '{wide}', '{plain}'))), '{WHITE}+', ' ', 'g'))"


def sql_keywords(c: str) -> str:
    """SQL for ``functions.text.keyword_tokens``."""
    return f"list_distinct(list_filter(string_split_regex(translate(lower({c}), '_-()[]/,.', '         '), '{WHITE}+'), lambda x: length(x) > 2))"


#: Letters, marks, digits and joiners, as both engines' word class takes them.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def sql_slug(c: str) -> str:
    """SQL for ``functions.text.slugify``."""
    return f"regexp_replace(lower(regexp_replace(regexp_replace({c}, '[^{WORD}\\s\\x{{a0}}\\x{{2009}}-]', '', 'g'), '^[\\s\\x{{a0}}\\x{{2009}}]+|[\\s\\x{{a0}}\\x{{2009}}]+$', '', 'g')), '[-\\s\\x{{a0}}\\x{{2009}}]+', '-', 'g')"


def sql_sanitize(c: str) -> str:
    """SQL for ``functions.text.sanitize_iri``."""
    text = f"coalesce({c}, '')"
    for a, b in (("@", "_at_"), ("&", "_and_"), ("%", "_percent_"), ("+", "_plus_"), ("=", "_eq_")):
        text = f"replace({text}, '{a}', '{b}')"
    text = f"translate({text}, ' /\\.,:;#()[]{{}}<>|*!?\"" + 2 * "'" + "', '____________________')"
    return f"substr(regexp_replace(regexp_replace({text}, '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 100)"


#: Characters that stand for those beyond ASCII where SQL counts bytes.
_STAND_INS = "||".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 127))


def sql_levenshtein(a: str, b: str) -> str:
    """SQL for the edit similarity of two texts in code points, lower case.

    The edit distance of that SQL counts bytes, so the characters beyond ASCII of
    both texts (27 kinds at most) are first replaced by control characters, equal
    ones by equal ones, which leaves the distance as it is.
    """
    x, y = f"lower({a})", f"lower({b})"
    kinds = f"array_to_string(list_sort(list_distinct(string_split(regexp_replace({x} || {y}, '[\\x00-\\x7f]+', '', 'g'), ''))), '')"
    plain = lambda t: f"translate({t}, {kinds}, {_STAND_INS})"
    distance = f"case when strlen({x}) = length({x}) and strlen({y}) = length({y}) then levenshtein({x}, {y}) else levenshtein({plain(x)}, {plain(y)}) end"
    return f"case when greatest(length({x}), length({y})) = 0 then 1.0 else 1.0e0 - cast({distance} as double) / cast(greatest(length({x}), length({y})) as double) end"


class Queries:
    """Queries and SQL of one module, filled by its decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Callable], Query]:
        """Registers ``f(load)``, where ``load(table)`` gives a whole table."""

        def add(f: Callable) -> Query:
            key = name or f.__name__

            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda t: table(spark, sf_dir, t))

            query.__doc__, query.__name__ = f.__doc__, key
            self.queries[key] = query
            if sql:
                self.sql[key] = sql
            return query

        return add
