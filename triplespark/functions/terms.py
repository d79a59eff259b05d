"""RDF terms in N-Triples lexical form, which is also how columns hold them.

IRIs are `<...>`, blank nodes `_:label`, literals `"..."` with an optional `@lang` or `^^<datatype>`.
Canonical: escapes are decoded, then only what must be escaped is escaped again, so that equal terms are
equal strings both in data and in queries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_NAMED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


class TermError(ValueError):
    """A term that is not well-formed."""


def unescape(text: str) -> str:
    """Decode string and numeric escapes."""
    def one(m: re.Match) -> str:
        x = m[1]
        if len(x) > 1:
            try:
                return chr(int(x[1:], 16))
            except (ValueError, OverflowError):
                raise TermError(f"no such character: \\{x}") from None
        if x not in _NAMED:
            raise TermError(f"unknown escape \\{x}")
        return _NAMED[x]

    return _ESCAPE.sub(one, text) if "\\" in text else text


def iri(text: str) -> str:
    return f"<{text}>"


def literal(text: str, lang: str | None = None, datatype: str | None = None) -> str:
    """A literal of decoded text; the datatype is an IRI without brackets."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(a, b)
    return f'"{text}"' + (f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


def literal_column(value: Column) -> Column:
    """Plain literals of a column's text."""
    value = value.cast("string")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), value, F.lit('"'))


def kind_column(term: Column) -> Column:
    """iri, bnode or literal."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")
