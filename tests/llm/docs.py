"""Small documents with every odd case, for all operators."""

#: Names that operators might use for columns of their own.
CLASHING = ["__id", "__ID_", "__lost", "__copies", "__copy", "__start", "__part", "__row", "__gone", "__x", "x", "t", "pos", "line", "copies", "rank", "key", "word", "place", "keep"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` int, `a.b` string, score string, n string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def row(doc_id, text, source="s1", lang="en"):
    return (doc_id, text, lang, source, None, 1, "x", None, None, *["y"] * len(CLASHING))


ODD = [
    row(1, None),
    row(2, ""),
    row(3, " \t\r\n\x0b\x0c "),
    row(4, "word " * 40000),
    row(5, "x" * 30000),
    row(6, "Same text here, of eight words in all."),
    row(6, "Same text here, of eight words in all."),
    row(7, "Same text here, of eight words in all.", None, None),
    row(8, "Ünïcode  wörds here 日本語 🎉 <|endoftext|> end", ""),
    row(None, "without an id", "s2"),
    row(9, "a\n\nb\nAll rights reserved.\n", "s2"),
]


def frame(spark, rows=ODD, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
