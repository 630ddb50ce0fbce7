"""Small fixtures with the awkward rows that every operator must take."""

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "mail me at someone@example.com or +1 (523) 555-1055", "en", None),
    (5, " \n\t ", "en", "b"),
    (6, "word " * 30_000, "en", "c"),
    (7, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "c"),
    (8, "...", None, "c"),
]


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and a column that clashes with internal names."""
    rows = [(*r, len(r[1] or ""), "x", 1, 0.5, "zz", [1], "k") for r in AWKWARD]
    names = "doc_id long, text string, lang string, source string, n_chars long, u string, size long, score double, lang_pred string, slots array<int>, t string"
    return spark.createDataFrame(rows, names)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
