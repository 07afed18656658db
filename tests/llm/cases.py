"""Small tables with nulls, empty and long texts, repeats and clashing column names."""

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
DOCS = [
    (1, "a b c d e f g h i j", "en", "s", 1), (2, "a b c d e f g h i j", "en", "s", 1), (2, "a b c d e f g h i j", "en", "s", 1),
    (3, "", None, None, None), (4, None, "en", "s", None), (None, "a b c d e f g h i j", None, "s", 2), (None, None, None, None, None),
    (5, "x y", "en", "s", 3), (6, "X Y", "en", "s", 3), (7, LONG, "en", "s", 9), (8, LONG + " tail", "en", "s", 9), (9, " \t\n ", "en", "s", 0),
    (10, "héé wörld \U0001F600 ß 日本語 " * 5, "de", "s", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside or return; they must pass through or be replaced, not crash.
CLASH = "id string, row string, score string, node string, digest string, `statistics` string, spans string, label string, c0 string, token string, name string, n string, s2 string, i2 string, component string, rep string, `odd.name` string, text string, doc_id long"


def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def clashing(spark):
    return spark.createDataFrame([(*["z"] * 17, t, i) for i, t, *_ in DOCS], CLASH)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
