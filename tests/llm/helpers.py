"""Tables for the tests, with the awkward rows that every operator has to bear."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, component_id long, pii string"
LONG = " ".join(f"w{i} word{i % 97}" for i in range(30_000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here now", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \t\n ", "en"),
    (5, LONG, "en"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from here now", "en"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from here now", "en"),
    (None, "a row without an id", "en"),
    (7, "der Hund und die Katze schlafen im Garten", "de"),
    (8, "\u0000 ퟿ \U0001f600 ÀÉ ẞ ß", None),
    (9, "1234567890 !!! ???", "fr"),
]


def docs(spark, rows=None):
    rows = AWKWARD if rows is None else rows
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 1.0, "x", 5, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, quality int, toxic int, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]
