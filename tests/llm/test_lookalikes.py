import unicodedata

from hypothesis import example, given, settings
from hypothesis import strategies as st

from stratavox.llm.lookalikes import CYRILLIC, GREEK, consistent_form, consistent_text, look_alike_pairs, look_classes, shown_form, shown_text

DOCS = "doc_id long, text string, id string, coarse string"
BASE = "The café opens: scope = x² — ok"
SAME = [
    BASE, unicodedata.normalize("NFD", BASE), BASE.replace(" ", " "), BASE.replace("o", "о"), BASE.replace("o", "ο"), "﻿" + BASE.replace("sc", "s​c"),
    BASE.replace("scope", "ｓｃｏｐｅ"), BASE.replace("e", "е").replace("T", "Τ"),
]
OTHER = [BASE.lower(), BASE.replace("é", "e"), BASE.replace("²", "2"), BASE.replace("—", "-"), BASE.replace(" ", "  "), BASE + "!", ""]


def test_shown_form_tells_apart_what_a_reader_sees():
    assert len({shown_form(t) for t in SAME}) == 1
    assert all(shown_form(t) != shown_form(BASE) for t in OTHER)
    assert len({consistent_form(t) for t in [*SAME, BASE.lower(), BASE.upper(), BASE.replace("²", "2")]}) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_stable_and_shown_refines_consistent(text):
    assert consistent_form(consistent_form(text)) == consistent_form(text)
    assert shown_form(shown_form(text)) == shown_form(text)
    assert consistent_form(shown_form(text)) == consistent_form(text)
    assert shown_form(unicodedata.normalize("NFD", text)) == shown_form(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40))
@example("page one\x0cpage two\x0bend")
@example("a\tb\r\nc")
def test_a_plain_text_has_the_forms_of_its_copy_with_an_invisible_character(text):
    assert shown_form(text) == shown_form(text + "\u200b")
    assert consistent_form(text) == consistent_form(text + "\u200b")


def test_cyrillic_and_greek_texts_that_differ_in_case_only_have_one_consistent_form():
    for text in ("Код: Вектор Ткани, объём Һ Ԁ", "Все Клетки Мозга Находятся Там", "Αβ Βα Εκτίμηση Ζώα Ηχώ Ικτίς Κάπα Μέρος Τιμή Υψος Χάος Ρω Ος", *CYRILLIC, *GREEK):
        if not set(text) & set("ΝνӀӏ"):
            assert len({consistent_form(t) for t in (text, text.upper(), text.lower(), text.swapcase(), text.casefold(), "\u200b" + text.title())}) == 1, text
    assert shown_form("к") != shown_form("k") and shown_form("К") == "K"
    assert consistent_form("n") != consistent_form("v") and consistent_form("i") != consistent_form("l")


def test_every_look_alike_of_a_latin_letter_is_compared_as_that_letter():
    # the lunate sigma is decomposed to σ before letters are read
    assert all(consistent_form(x) == v.casefold() for x, v in {**CYRILLIC, **GREEK}.items() if x not in "Ϲϲ")


def test_pairs_and_classes(spark):
    texts = [*SAME, *OTHER, SAME[0], None, None, "", "x" * 200_000, "x" * 199_999 + "х"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and shown_form(a) == shown_form(b)}
    got = [tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r["id"]: r for r in look_classes(df, "doc_id", "text").collect()}
    assert len(classes) == len(texts)
    for i, a in enumerate(texts):
        mates = [j for j, b in enumerate(texts) if (b is not None and a is not None and consistent_form(a) == consistent_form(b)) or i == j]
        assert (classes[i]["class_id"], classes[i]["n_docs"]) == (min(mates), len(mates))
    assert look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0 and look_classes(df.limit(0), "doc_id", "text").count() == 0
    assert [r[0] for r in df.filter("doc_id = 0 or text is null").orderBy("doc_id").select(consistent_text("text")).collect()][1:] == [None, None]


def test_many_variants_and_many_copies_meet_in_chunks(spark):
    variants = ["scope " + "".join("о" if b == "1" else "o" for b in f"{k:06b}") for k in range(40)]
    texts = variants + [variants[0]] * 70 + [variants[1]] * 30 + ["lone"] * 50
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a != b and shown_form(a) == shown_form(b)}
    got = [tuple(r) for r in look_alike_pairs(df, "doc_id", "text", chunk_docs=8, chunk_texts=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_column_functions_agree_with_the_forms(spark):
    texts = [*SAME, *OTHER, "A\tB\r\nC\x0bD\x0c", "É\r\n", None, "ß", "\u212a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select("t", consistent_text("t").alias("c"), shown_text("t").alias("s")).collect()
    for r in rows:
        assert (r["c"], r["s"]) == ((None, None) if r["t"] is None else (consistent_form(r["t"]), shown_form(r["t"])))


def test_every_blank_counts():
    assert shown_form("a\r\nb") == shown_form("a\u200b\r\nb") == "a\n\nb" != shown_form("a\nb")
    assert consistent_form("a\r\nb") != consistent_form("a\nb") and shown_form("a\rb") == shown_form("a\u2028b")


def test_rows_without_id_or_text_are_kept(spark):
    rows = [(1, "a"), (2, "A"), (3, None), (None, None), (None, None), (None, "a"), (None, "b")]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in look_classes(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 3, 2), (2, 1, 3, 2), (None, 1, 3, 2), (3, 3, 1, 1), (None, None, 1, 1), (None, None, 1, 1), (None, None, 1, 1)], key=str)
