"""Small tables with nulls, ties, repeats, long texts and columns that clash with the operators' own names."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, kept string, name int, i int, bands string, spans int, _row int, _text string, part string, label string"
)


def odd_documents(spark):
    long = " ".join(f"word{i} and{i % 7}" for i in range(4000))
    base = " ".join(f"token{i % 83}x{i % 11}" for i in range(300))
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \n\t ", "fr", "a"), (None, base + " tail", "en", "b"), (None, None, None, None),
        (6, base.replace("token5x", "other"), "en", "b"), (7, "one", None, "b"), (8, "one", "en", "b"), (9, long, "en", "c"), (10, "é" * 150 + " 日本語 🙂", "de", "c"), (11, "a\x00b " * 60, "de", "c"), (12, "###$$$ %%%", "en", "c"),
    ]
    return spark.createDataFrame([(*t, len(t[1] or ""), "k", "x", 5, 6, "b", 7, 8, "t", "p", "l") for t in texts], SCHEMA)


def odd_pages(spark):
    page = "<html><body><article><h1>T</h1><p>" + "words in a row " * 90 + "</p></article></body></html>"
    rows = [(1, "http://x/1", page), (2, "http://x/2", page), (2, "http://x/2", page), (3, None, page), (None, "http://x/4", page), (4, "u v\r\nw", None), (5, "http://x/5", ""), (6, "x", "<p>unclosed <b>text &amp; &#233; <table><tr><td>cell"), (7, "x", "short"), (8, "y", "short")]
    return spark.createDataFrame([(*r, "c", 3) for r in rows], "page_id bigint, url string, html string, digest string, kind int")
