from narrata.llm import linerules
from tests.llm.helpers import no_docs, odd_docs


def test_facts_by_hand():
    f = linerules.facts_of("One two\n\none  TWO\nOne two\n# $ <3\n")
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (9, 22, 3, 1, 0)
    assert len(f.line_hashes) == 2 and f.line_words == [6, 3]
    assert linerules.normal_line(" A\tB 12.34 ") == b"a b 0.0"
    assert linerules.facts_of(None)[:5] == (0, 0, 0, 0, 0)


def test_repeated_words_equal_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
        assert linerules.repeated_words(words) == len(inside)


def test_common_lines_go_and_depleted_documents_with_them(spark):
    own = [" ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j) for j in range(20)) for i in range(60)]
    common = "This very line stands in every text of the host number 7"
    rows = [(i, f"{common}\n{t}", "en", "h") for i, t in enumerate(own)] + [(100 + i, f"{common.upper()}\nonly {chr(97 + i)}", "en", "h") for i in range(3)]
    rows += [(200 + i, "A text that stands many times in one host has nothing but common lines", "en", "h") for i in range(80)]
    rows += [(300 + i, "A text that stands ten times in one host is still within the limit", "en", "h") for i in range(10)]
    got = {r["doc_id"]: r for r in linerules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 12 for i in range(60))
    assert all(not got[100 + i]["kept"] and not got[100 + i]["base_failed"] for i in range(3))
    assert all(not got[200 + i]["kept"] and got[200 + i]["n_removed_words"] == 14 for i in range(80))
    assert all(got[300 + i]["kept"] and got[300 + i]["n_removed_words"] == 0 for i in range(10))


def test_the_limit_does_not_rise_with_the_host(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(i % 7 + 10)).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)]
    rows = [(i, f"Boilerplate of one page in a hundred\n{t}" if i % 100 == 0 else t, "s", 7, "clash") for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone long, host string")
    got = {r["doc_id"]: r["n_removed_words"] for r in linerules.line_rules(docs).collect()}
    assert all(n == (7 if i % 100 == 0 else 0) for i, n in got.items())
    cleaned = linerules.cleaned_documents(docs)
    assert cleaned.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == dict(enumerate(own))


def test_odd_rows_have_defined_results(spark):
    got = linerules.line_rules(odd_docs(spark)).collect()
    assert len(got) == 15 and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 10)
    assert linerules.line_rules(no_docs(spark)).count() == linerules.cleaned_documents(no_docs(spark)).count() == 0
    assert all(len(r["text"].split()) >= 10 for r in linerules.cleaned_documents(odd_docs(spark)).collect())


def test_rows_of_one_id_are_one_document(spark):
    """A dozen rows of one id and one of another are two documents, fewer than the limit; as many ids are more; rows without an id are documents each."""
    line, own = "a line that stands in many of these documents here", "only {} has these words of its own in it today"
    rows = [(1, f"{line}\n{own.format(n)}", "en", "one") for n in range(12)] + [(2, f"{line}\n{own.format(99)}", "en", "one")]
    rows += [(n, f"{line}\n{own.format(n)}", "en", "two") for n in range(3, 16)] + [(None, f"{line}\n{own.format(n)}", "en", "three") for n in range(13)]
    got = linerules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all((r["n_removed_words"] == 0) == (r["doc_id"] in (1, 2)) for r in got) and len(got) == len(rows)
