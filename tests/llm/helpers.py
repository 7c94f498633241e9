"""Awkward documents that every operator must take, and brute-force versions of what they do."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(60))


def documents(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    texts = [
        None, "", "   \n\t ", "one", PASSAGE, f"before {PASSAGE} after it", f"x {PASSAGE}", PASSAGE.upper(), "same line that is shared by some\nother", "  SAME line that is shared by some \nmore\n",
        "same line that is shared by some", "Ünïcödé wörds, 日本語 and 😀 <|endoftext|> don't", "a  b   c \n d", "the cat sat on the mat " * 3000, "Released under the MIT License.", "word " * 120,
    ]
    rows = [(i, t, None if i % 3 else "en", None if i % 5 else "src0", None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[8], (None, PASSAGE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["doc", "body", "words", "anchor", "at", "n", "score", "key", "fp", "component_id", "n_lines", "n_dropped", "licenses", "ids", "hits", "items", "shard", "batch", "drop", "row", "hash", "__doc", "__body", "__hash", "__drop", "__words", "__hashes", "__some", "__order0", "__candidates", "__score"]
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def none(docs):
    return docs.where("false")


def groups(pairs, nodes):
    """The smallest node that each reaches."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least
