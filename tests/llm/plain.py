"""Plain Python forms that the operators are held against."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def table(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = "alpha beta gamma delta epsilon zeta eta theta\n" * 3000
    return [
        (1, None), (2, ""), (3, "   \n\t\n"), (4, long), (5, "The MIT License.\nOne two three four five six seven eight nine."), (5, "The MIT License.\nOne two three four five six seven eight nine."),
        (None, "One two three four five six seven eight nine."), (None, None), (7, "é ü 漢字 😀\x0b\x0c\r\n"), (8, "a"), (8, "b"), (9, "x" * 40_000),
    ]


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
