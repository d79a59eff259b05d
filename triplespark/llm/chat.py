"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. A turn is written as `### role: text</turn>` and a newline; control strings inside
texts and roles are escaped with a backslash and a letter, which no other text can then contain.

`examples` gives each example in full: the text of all preceding turns and the reply, and where in it
the reply lies. The examples of a conversation share their beginnings, so they take space that grows
with the square of its replies. `format_examples` is the form to store: an example as what it adds to the
one before it (`delta`), with offsets into the full text, which `expand` writes out. Turns after the last
reply, and conversations without one, are rows without a target (loss_start null), so nothing is lost.

One shuffle by conversation serves the window, the examples and their reading; examples are written out
one after another and not kept. A conversation's turns meet in one task, since a digest of a whole
conversation needs its text in one value: that is the limit for a conversation of very many turns.

Edge cases: null texts and roles are empty; turns come by turn, then role, then text, nulls first, so
ties and repeated rows are all kept in a fixed order; rows with a null conv_id form one conversation;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and their escapes, in the order of escaping; the reverse order undoes it.
TEXT = [("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h")]
ROLE = [*TEXT, (":", "\\c")]


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, pairs=TEXT) -> Column:
    return _replace(c, pairs)


def unescape(c: Column, pairs=TEXT) -> Column:
    return _replace(c, [(b, a) for a, b in reversed(pairs)])


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns added, delta, prefix_chars before it, loss_start, loss_end in the full text."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reply = F.coalesce(F.col("role") == "assistant", F.lit(False))
    lead = F.concat(F.lit(OPEN), escape(role, ROLE), F.lit(BETWEEN))
    turns = (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumns({"reply": reply, "lead": F.length(lead), "line": F.concat(lead, escape(text), F.lit(CLOSE))})
        .withColumns({
            "n": F.row_number().over(order),
            "example": F.coalesce(F.sum(F.col("reply").cast("int")).over(before), F.lit(0)),
            "at": F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)),
        })
    )
    start = F.col("at") + F.col("lead")
    return turns.groupBy("conv_id", "example").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "").alias("delta"),
        F.min("at").alias("prefix_chars"),
        F.max(F.when(F.col("reply"), start)).alias("loss_start"),
        F.max(F.when(F.col("reply"), F.col("at") + F.length("line") - len(CLOSE))).alias("loss_end"),
    )


def expand(deltas: DataFrame, tails: bool = False) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: examples with their full text, all preceding turns and the
    reply; with `tails` also the rows without a target, whose text is the whole conversation."""
    so_far = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    full = deltas.withColumn("text", F.array_join(F.collect_list("delta").over(so_far), ""))
    kept = full if tails else full.filter(F.col("loss_start").isNotNull())
    return kept.select("conv_id", "example", "text", "loss_start", "loss_end")


def examples(conversations: DataFrame, tails: bool = False) -> DataFrame:
    """Every assistant turn as an example with all preceding turns as its context, as `expand` gives them."""
    return expand(format_examples(conversations), tails)


def digests(written: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples in full (with tails): its turns, from the last and longest
    text, and the text under the loss masks, from each example its own."""
    span = F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    trained = F.when(F.col("loss_start").isNotNull(), F.struct("example", unescape(span).alias("text")))
    whole = written.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("formatted"), F.array_sort(F.collect_list(trained)).alias("trained"))
    formatted = F.col("formatted")
    lines = F.split(formatted, CLOSE, -1)

    def turn(line: Column) -> Column:
        role = F.substring_index(line, BETWEEN, 1)
        text = F.substr(line, F.length(role) + len(BETWEEN) + 1)
        return F.concat(unescape(F.substr(role, F.lit(len(OPEN) + 1)), ROLE), F.lit("\n"), unescape(text), F.lit("\n"))

    masked = F.array_join(F.transform("trained", lambda x: x["text"]), "")
    read = whole.select(
        "conv_id", (F.size(lines) - 1).cast("long").alias("n_turns"),
        F.array_join(F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), turn), "").alias("turns"),
        masked.alias("masked"), F.length(formatted).cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, written out as examples and read back."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(extra.columns)
    return digests(examples(rows.unionAll(extra), tails=True))


def _sql_escape(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


OP1_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS masked,
    sum(14 + length({_sql_escape('r', ROLE)}) + length({_sql_escape('t', TEXT)}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(masked)::BIGINT AS loss_chars,
  sha256(masked) AS loss_sha256, formatted_chars
FROM joined
"""
