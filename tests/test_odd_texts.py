"""Queries over texts that the given tables lack, against their SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb

from narrata import oracle, oracle_chunks, queries, queries_cast  # noqa: F401

ODD = ["two words", None, "", "... ?", "漢字", "\n\n x"]


def both(spark, folder, name, sql, texts):
    """Rows of a query and of its SQL over a table of these texts."""
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as from '{path}/*.parquet'")
    found = queries.queries()[name](spark, str(folder))
    return sorted(map(tuple, found.collect())), sorted(con.sql(sql).fetchall())


def test_texts_without_words_have_no_first_word(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "t17_word_starts", oracle.oracle_sql()["t17_word_starts"], ODD)
    assert got == wanted == [(0, 2, 0), (1, 0, -1), (2, 0, -1), (3, 0, -1), (4, 0, -1), (5, 1, 3)]


def flowed(text):
    """The rule in words: paragraphs part at blank lines, lines of headings at their beginning stand alone, other wraps become blanks."""
    lines = text.split("\n")
    pages = ["\n".join(([f"Chapter {n // 15 + 1}"] if n % 15 == 0 else []) + lines[n : n + 5]) for n in range(0, len(lines), 5)]
    out = []
    for block in re.split(r"\n\s*\n+", "\n\n".join(pages)):
        while "\n" in block and re.match(r"(?:chapter|part|section)(?!\S)", block.split("\n")[0].strip(), re.IGNORECASE):
            head, block = block.split("\n", 1)
            out.append(head.strip())
        block = re.sub(r"[ \t]*\n[ \t]*", " ", block).strip()
        out += [block] if block else []
    return out


def test_wraps_and_headings_are_flowed(spark, tmp_path):
    """Lines of a page become one paragraph below its heading; on random texts as by the rule and by the SQL."""
    draw = random.Random(5)
    bits = ["a", "B.", " ", "\t", "\n", "\n", "\n", "\nPart", "\nchapter 3", "\nSection\xa0x", "\x1c", "\r", "漢", "Parting"]
    texts = ["One\nline of six\n  Part II\nends\nhere.\nNext page.", "Part I\n chapter 2 \nText.", *ODD, *("".join(draw.choices(bits, k=draw.randrange(60))) for _ in range(400))]
    assert flowed(texts[0]) == ["Chapter 1", "One line of six Part II ends here.", "Next page."]
    assert flowed(texts[1]) == ["Chapter 1", "Part I", "chapter 2", "Text."]
    got, sql = both(spark, tmp_path, "t19_flowed_paragraphs", oracle_chunks.oracle_sql()["t19_flowed_paragraphs"], texts)
    lists = [flowed(t or "") for t in texts]
    assert got == sql == [(n, len(p), hashlib.sha256("\n".join(p).encode()).hexdigest()) for n, p in enumerate(lists)]
