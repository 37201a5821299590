"""Small documents with awkward rows, shared by the tests of this folder."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, _gone string, h string, key string"


def doc(i, text, source="s"):
    """With extra columns whose names clash with ones that operators use inside."""
    return (i, text, "en", source, None if text is None else len(text), "x", "y", "z", "k")


def awkward():
    long = " ".join(f"w{k}" for k in range(30_000))
    return [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "one"), doc(4, "one"), doc(5, long), doc(6, "é ▁ 😀\x00 x", None), doc(7, "x" * 5000), doc(None, "no id"), doc(9, "one"), (10, "only text", None, None, None, None, None, None, None)]
