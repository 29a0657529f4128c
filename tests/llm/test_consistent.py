import pytest

from skein.llm.consistent import consistent_form, inconsistent_values

SCHEMA = "result_id bigint, text string, title string, plain string, of string"


def rows(*values):
    return [(i, text, title, "x", "y") for i, (text, title) in enumerate(values)]


def made(spark, *values, **more):
    df = spark.createDataFrame(rows(*values), SCHEMA)
    out = {r.result_id: (r.text_consistent, r.title_consistent) for r in consistent_form(df, ["text", "title"], **more).collect()}
    found = {(r.result_id, r.field_name) for r in inconsistent_values(df, "result_id", ["text", "title"], **more).collect()}
    assert found == {(i, f) for i, pair in enumerate(values) for f, a, b in zip(("text", "title"), pair, out[i]) if a != b}
    return out


# The words that tasks hold: all of them, and a few, so that values are completed by the join.
@pytest.mark.parametrize("most_words", [50_000, 3])
def test_forms(spark, most_words):
    out = made(
        spark,
        ("Класс Ｂ１２ и шина", "кра​н"),
        ("район край", "ёлка"),
        ("сталь с медью с хромом", "ВРУ"),
        ("сталь c медью", "BPY"),
        ("шина LED и LЕD", "пoлoжения"),
        ("устрοйство λ = 5 м²", "№ 5 — 3 ‰ ±2 °С"),
        ("PE PE PE РЕ", "IP54 ІР54"),
        (None, ""),
        ("сталь с медью с хромом", "ВРУ"),
        most_words=most_words,
    )
    assert out[0] == ("Класс B12 и шина", "кран")
    assert out[1] == ("район край", "ёлка")
    assert out[2] == ("сталь с медью с хромом", "ВРУ") == out[8]
    assert out[3] == ("сталь с медью", "ВРУ")
    assert out[4] == ("шина LED и LED", "положения")
    assert out[5] == ("устройство λ = 5 м²", "№ 5 — 3 ‰ ±2 °С")
    assert out[6] == ("PE PE PE PE", "IP54 IP54")
    assert out[7] == (None, "")


def test_accents_and_case_keep_words_apart(spark):
    assert made(spark, ("сорт", "Сорт"), ("все всё", None))[1] == ("все всё", None)


def test_undecidable_word_stays_and_long_text(spark):
    long = "слово " * 40_000 + "пpи"
    out = made(spark, ("жqж", None), (long, None))
    assert out[0][0] == "жqж" and out[1][0] == long[:-3] + "при"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert consistent_form(df, ["text", "title"]).count() == 0 and inconsistent_values(df, "result_id", ["text"]).count() == 0
