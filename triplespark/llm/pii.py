"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds and validators: email (its shape), ip (parts of at most 255), card (13 to 19 digits, Luhn), phone
(9 to 15 digits), and, added by the method, iban (ISO 13616, mod-97), key (identifiers of cloud access
keys) and secret (a value of 12 characters or more, with a digit, that is assigned to a password, token or
the like). A span that fails its validator is dropped without another try. The score, in percent, is the
kind's prior, raised if one of the kind's context words stands within `NEAR` characters; it is part of the
result, and no base span is dropped for its score.

Everything is a SQL expression over the row: no shuffle, no Python. The patterns are written so that a
search takes linear time: possessive repeats, starts only where a run starts (or the last match ended),
and no repeated groups, which would recurse over a long run. The card pattern relies on separators next
to separators being masked first, one character for one, so that positions stay.

Positions are code points, end exclusive. Start positions come from summing the lengths of matches and
of the text between them, in blocks of `BLOCK` matches, so a text with very many stays affordable.

Edge cases: null and empty texts have no spans (the digest of the empty string); a null doc_id and
repeated rows are kept; empty tables give empty results; other columns are ignored by `find`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import text_or_empty

BLOCK, NEAR = 256, 48
KINDS, BASE = ("email", "ip", "card", "phone", "iban", "key", "secret"), 4
#: Prior of a confirmed span and its context words; a context word adds BONUS.
PRIOR = {"email": 80, "ip": 50, "card": 60, "phone": 50, "iban": 70, "key": 70, "secret": 60}
BONUS = 20
CONTEXT = {
    "email": "mail|contact|write|reach", "ip": "address|host|server|client|login", "card": "card|visa|credit|payment|debit",
    "phone": "phone|call|mobile|contact|fax", "iban": "iban|account|bank|transfer|swift",
    "key": "key|access|cloud|secret|credential", "secret": "login|user|auth|access|config|credential",
}
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]{11,}[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "key": r"A[KS]IA[0-9A-Z]{16}",
    "secret": r"(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\x22']?[A-Za-z0-9+/_-]{12}[A-Za-z0-9+/_-]*",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost, non-overlapping matches."""
    def placed(found: Column, between: Column) -> Column:
        widths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))

        def spans(w: Column, sums: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                end = _sum(F.slice(sums, F.lit(1), b)) + _sum(F.slice(w, b * BLOCK + 1, i - b * BLOCK + 1))
                return let(end, lambda e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))

            return F.transform(found, span)

        return F.when(F.size(found) > 0, let(widths, lambda w: let(blocks(w), lambda s: spans(w, s)))).otherwise(
            F.array().cast("array<struct<start:int,end:int,found:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def weighed(d: Column, i: Column) -> Column:
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    return _sum(F.transform(F.filter(each, lambda d: d.isNotNull()), weighed)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's remainder is 1, letters counting 10 to 35."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(found), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return let(F.replace(found, F.lit(" "), F.lit("")), lambda c: F.length(c).between(15, 34) & mod97(c))
    if kind == "secret":
        return found.rlike("[0-9]")
    return F.lit(True)


def _of_kind(kind: str, text: Column) -> Column:
    guard = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(PATTERNS["card"]),
             "phone": F.contains(text, F.lit("+")), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "key": F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA")),
             "secret": (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(r"[A-Za-z] ?[=:] ?[\x22']?[A-Za-z0-9+/_-]{12}")}[kind]
    source = F.regexp_replace(text, "[ -](?=[ -])|(?<=[ -])[ -]", "x") if kind == "card" else text
    near = lambda x: F.substr(text, F.greatest(F.lit(1), x["start"] - NEAR + 1), x["end"] - x["start"] + 2 * NEAR)

    def scored(x: Column) -> Column:
        bonus = F.when(F.lower(near(x)).rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"),
                        (F.lit(PRIOR[kind]) + bonus).alias("score"))

    kept = F.transform(F.filter(matches(source, PATTERNS[kind]), lambda x: _valid(kind, x["found"])), scored)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,score:int>>")
    return F.when(guard, kept).otherwise(none)


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and pii: an array of (kind, start, end, found, score), by kind as listed, then start."""
    text = text_or_empty()
    return docs.select(*keep, F.concat(*[_of_kind(k, text) for k in KINDS]).alias("pii"))


def redact(docs: DataFrame, least: int = 0) -> DataFrame:
    """The same columns with each span in `text` of a score of at least `least` written as its kind in brackets;
    n_chars follows the text.

    Of overlapping spans the one that starts first (the longer, at a tie) names the whole stretch.
    Null texts stay null.
    """
    text = text_or_empty()
    spans = F.concat(*[_of_kind(k, text) for k in KINDS])
    found = docs.withColumn("__pii", F.filter(spans, lambda x: x["score"] >= least) if least else spans)
    order = F.array_sort(F.transform("__pii", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        fresh = F.struct(F.concat(acc["out"], F.substr("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), end.alias("at"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], end).alias("at")))

    clean = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    changed = found.withColumn("text", F.when(F.size("__pii") > 0, clean).otherwise(F.col("text"))).drop("__pii")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return changed.select(docs.columns)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """All documents: counts and digests of their spans; also each span's score, in the order of `spans`, and
    whether there is any span."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    listed = lambda xs: F.array_join(F.transform(xs, name), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*KINDS[:BASE]))
    of = lambda kind: F.filter("pii", lambda x: x["kind"] == kind)
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"), (F.size("pii") > 0).alias("private"))


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    """DuckDB: list of (start, end, found) of the valid matches of a kind."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      'e': list_sum(list_transform((regexp_extract_all(t, '{pattern}'))[1:i], lambda m: length(m)))
         + list_sum(list_transform((string_split_regex(t, '{pattern}'))[1:i], lambda m: length(m))),
      'm': (regexp_extract_all(t, '{pattern}'))[i]}}), lambda x: {valid}) AS {kind}"""


_D = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_C = "replace(x.m, ' ', '')"
_T = f"({_C}[5:] || {_C}[1:4])"
_LUHN = f"""list_sum(list_transform(range(1, length({_D}) + 1), lambda k: CASE WHEN (length({_D}) - k) % 2 = 0 THEN ({_D})[k]::INT
  WHEN ({_D})[k]::INT > 4 THEN ({_D})[k]::INT * 2 - 9 ELSE ({_D})[k]::INT * 2 END)) % 10 = 0"""
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({_T}) + 1), lambda k: ascii(({_T})[k])::BIGINT)),
  lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""
_JOIN = lambda kind: f"list_transform({kind}, lambda x: '{kind}:' || (x.e - length(x.m))::BIGINT || ':' || x.e::BIGINT)"
_SCORE = lambda kind: f"""list_transform({kind}, lambda x: CASE WHEN regexp_matches(lower(substr(t, greatest(1, (x.e - length(x.m))::BIGINT - {NEAR - 1}),
  length(x.m) + {2 * NEAR})), '{CONTEXT[kind]}') THEN '{PRIOR[kind] + BONUS}' ELSE '{PRIOR[kind]}' END)"""  # noqa: E731
_LISTS = lambda of, kinds: f"coalesce(array_to_string(flatten([{', '.join(map(of, kinds))}]), ','), '')"
OP3_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id,
  {_sql_spans('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')},
  {_sql_spans('ip', '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0")},
  {_sql_spans('card', '[0-9](?:[ -]?[0-9])+', f"length({_D}) BETWEEN 13 AND 19 AND {_LUHN}")},
  {_sql_spans('phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_D}) BETWEEN 9 AND 15")},
  {_sql_spans('iban', PATTERNS['iban'], f"length({_C}) BETWEEN 15 AND 34 AND {_MOD97}")},
  {_sql_spans('key', PATTERNS['key'], 'true')},
  {_sql_spans('secret', PATTERNS['secret'].replace("'", "''"), "regexp_matches(x.m, '[0-9]')")}, t
  FROM texts)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
  sha256({_LISTS(_JOIN, KINDS[:BASE])}) AS base_sha256, {_LISTS(_JOIN, KINDS)} AS spans, {_LISTS(_SCORE, KINDS)} AS scores,
  {' + '.join(f'len({k})' for k in KINDS)} > 0 AS private
FROM found
"""
