import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.splitting import cut_positions, split_oversized


def check(text, most, overlap):
    cuts = cut_positions(text, most, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:]):
        assert b - overlap <= c <= b - (overlap - overlap // 3) or c == 0 and b <= overlap
        assert a <= c and b < d
    assert all(b - a <= most for a, b, _ in cuts)
    return cuts


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="аб .\n|;-", max_size=900), st.integers(20, 80), st.integers(0, 9))
def test_pieces_cover_the_text_and_keep_the_limit(text, most, overlap):
    check(text, most, overlap)


def test_cuts_where_paragraphs_end():
    paragraphs = ["Предложение номер %d о прокладке кабеля. " % i * 12 for i in range(9)]
    text = "\n\n".join(p.strip() for p in paragraphs)
    assert {kind for _, _, kind in check(text, 1500, 150)[:-1]} == {"paragraph"}


def test_cuts_rows_not_words():
    text = "\n".join(f"| {i} | задвижка {i * 7} | {i / 3:.2f} |" for i in range(400))
    assert {kind for _, _, kind in check(text, 1500, 150)[:-1]} == {"line"}


def test_text_without_any_boundary():
    assert len(check("я" * 5000, 1500, 150)) == 4


def test_rows(spark):
    long = "Слово и ещё слово. " * 200
    rows = [(1, long, "1 → 2", "x"), (2, "коротко", None, "y"), (3, None, "3", "z"), (4, "", None, "z"), (1, long, "1 → 2", "x"), (5, "ю" * 1500, "5", None)]
    df = spark.createDataFrame(rows, "doc bigint, text string, part string, piece string")
    out = split_oversized(df.withColumnRenamed("part", "section_path"), "doc", "text", ["section_path"]).collect()
    assert sorted(r.doc for r in out if r.n_parts == 1) == [2, 3, 4, 5]
    first = [r for r in out if r.doc == 1 and r.part == 1]
    assert len(first) == 2 and first[0] == first[1] and first[0].section_path == "1 → 2"
    for r in out:
        assert r.piece is None or r.piece == (long if r.doc == 1 else dict((a, b) for a, b, *_ in rows)[r.doc])[r.start : r.end]
    assert split_oversized(df.limit(0), "doc", "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "doc", "text", most=100, overlap=60)
