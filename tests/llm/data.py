"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows, odd columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `count` string, bucket string"


def rows(texts, langs=None):
    return [(i, t, (langs or [None] * len(texts))[i], "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]


def documents(spark, texts, langs=None, ids=None):
    r = rows(texts, langs)
    if ids is not None:
        r = [(i, *x[1:]) for i, x in zip(ids, r, strict=True)]
    return spark.createDataFrame(r, DOCS)


def awkward():
    long = "thnt ondre " * 3000
    return [
        "The quick brown fox jumps over the lazy dog and runs away from here.",
        None, "", "   \n\t ", "123 456", "é", "a", long, long + "end",
        "The quick brown fox jumps over the lazy dog and runs away from here.",
        "double  space \n new line  \t end ", " lead and trail ", "it's we'll I'd CAN'T",
        "日本語 テキスト 漢字かな交じり文", "emoji 😀😀 ok", "x" * 5000, "\x1c\x1d odd \x85 space", "under the MIT License. Apache License, Version 2.0; cc by-nc",
    ]
