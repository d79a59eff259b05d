"""N-Triples files: read into a table of canonical terms, write, clean, and export as a graph.

A line is split by one regular expression, on the JVM; terms whose escapes need decoding are the only
ones that cost more than that. Lines that hold no statement are dropped or, with strict, raise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IRI = r"<[^\x00-\x20<>\"{}|^`]*>"
_BLANK = r"_:[\w](?:[\w.·‿⁀-]*[\w·‿⁀-])?"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*+\"(?:@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*|\^\^" + _IRI + ")?"
STATEMENT = rf"(?U)^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI})[ \t]*({_IRI}|{_BLANK}|{_LITERAL})[ \t]*\.[ \t]*(?:#.*)?$"
TRIPLES = "s string, p string, o string"
_NAMED = [("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'")]


def _numeric(c: Column, letter: str, digits: int) -> Column:
    """Decode \\uXXXX or \\UXXXXXXXX; c has no escaped backslash left (they are set aside before)."""
    parts = F.split(c, rf"\\{letter}(?=[0-9A-Fa-f]{{{digits}}})", -1)
    code = lambda x: F.conv(F.substr(x, F.lit(1), F.lit(digits)), 16, 10).cast("long")

    def one(x: Column) -> Column:
        utf32 = F.lpad(F.hex(code(x)), 8, "0")
        return F.concat(F.decode(F.unhex(utf32), "UTF-32"), F.substr(x, F.lit(digits + 1)))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def canonical(term: Column) -> Column:
    """Escapes decoded and what must be escaped escaped again; language tags in lower case."""
    aside = "\uffff"  # not a character: no text has it
    text = F.replace(term, F.lit("\\\\"), F.lit(aside))
    for name, char in _NAMED:
        if char not in '"\n\r':  # these stay escaped
            text = F.replace(text, F.lit("\\" + name), F.lit(char))
    text = _numeric(_numeric(text, "u", 4), "U", 8)
    # decoded quotes, newlines and backslashes that came from numeric escapes are rare: escape them again inside literals
    body = F.regexp_extract(text, r"(?s)^\"(.*)\"((?:@[^\"]*|\^\^<[^\"]*)?)$", 1)
    tail = F.regexp_extract(text, r"(?s)^\"(.*)\"((?:@[^\"]*|\^\^<[^\"]*)?)$", 2)
    again = F.regexp_replace(body, r"(?<!\\)\"", "\\\\\"")
    for name, char in (("n", "\n"), ("r", "\r")):
        again = F.replace(again, F.lit(char), F.lit("\\" + name))
    tail = F.when(tail.startswith("@"), F.lower(tail)).when(tail == "^^<http://www.w3.org/2001/XMLSchema#string>", "").otherwise(tail)
    decoded = F.when(text.startswith('"'), F.concat(F.lit('"'), again, F.lit('"'), tail)).otherwise(text)
    decoded = F.replace(decoded, F.lit(aside), F.lit("\\\\"))
    return F.when(F.contains(term, F.lit("\\")) | F.contains(term, F.lit('"@')) | term.endswith("#string>"), decoded).otherwise(term)


def statements(lines: DataFrame, column: str = "value", raw: bool = False, strict: bool = False) -> DataFrame:
    """s, p, o of the lines that are statements, in canonical form unless raw."""
    line = F.rtrim(F.col(column), F.lit("\r"))
    parts = [F.regexp_extract(line, STATEMENT, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))]
    found = lines.select(line.alias("__line"), *parts)
    if strict:
        blank = F.col("__line").rlike(r"^[ \t]*(#.*)?$")
        wrong = F.raise_error(F.concat(F.lit("not a statement: "), F.col("__line"))).cast("string")
        found = found.withColumn("s", F.when((F.col("s") == "") & ~blank, wrong).otherwise(F.col("s")))
    found = found.filter(F.col("s") != "").drop("__line")
    return found if raw else found.select(*[canonical(F.col(c)).alias(c) for c in "spo"])


def read(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Triples of N-Triples files, each statement as often as it is there."""
    return statements(spark.read.text(path), strict=strict)


def lines_of(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines_of(triples).write.mode(mode).text(path)


def cleaned(lines: DataFrame, column: str = "value") -> DataFrame:
    """Statements whose subject and object hold no numeric \\u escape, with line breaks as blanks; other lines go."""
    found = statements(lines, column, raw=True)
    plain = [F.regexp_replace(c, r"[\r\n]", " ").alias(c) for c in "spo"]
    kept = found.select(*plain).filter(~F.contains("s", F.lit("\\u")) & ~F.contains("o", F.lit("\\u")))
    return lines_of(kept)


def clean(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> None:
    cleaned(spark.read.text(source)).write.mode(mode).text(target)


def graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and all edges of the undirected view."""
    nodes = triples.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    return nodes, triples.select("s", "o")


def write_graph(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes one a line, edges as two terms a line, tab-separated as terms hold blanks."""
    nodes, edges = graph(triples)
    nodes.write.mode(mode).text(f"{path}/nodes")
    edges.select(F.concat_ws("\t", "s", "o").alias("value")).write.mode(mode).text(f"{path}/edges")


def write_graphml(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parts of one GraphML document in order: header, nodes, edges, footer."""
    spark = triples.sparkSession
    escaped = lambda c: reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.col(c))
    nodes, _ = graph(triples)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="p" for="edge" attr.name="predicate" attr.type="string"/>\n<graph edgedefault="directed">'
    parts = {
        "0-head": spark.createDataFrame([(head,)], "value string"),
        "1-nodes": nodes.select(F.concat(F.lit('<node id="'), escaped("node"), F.lit('"/>')).alias("value")),
        "2-edges": triples.select(F.concat(F.lit('<edge source="'), escaped("s"), F.lit('" target="'), escaped("o"), F.lit('"><data key="p">'), escaped("p"), F.lit("</data></edge>")).alias("value")),
        "3-foot": spark.createDataFrame([("</graph>\n</graphml>",)], "value string"),
    }
    for name, part in parts.items():
        part.write.mode(mode).text(f"{path}/{name}")
