"""Cases with literal expected values for Markdown, tables, captions and slugs."""

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import markdown as M
from skein.operators import scanned as O
from skein.operators.structure import with_ancestors

MD = """## 1. Общие положения
Введение к главе.

### 1.1. Область
Текст области, см. п. 3.2.1 и табл. 3.1.
#### Без номера
Подпункт.
#### 1.1.1. Первый
Пункт первый.
#### Ещё без номера
После первого.
## Содержание
### 9.9. В содержании
Не нужно.
## 1. Общие положения
Снова.
## 2. Пусто
###### не заголовок
"""


def documents(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate(texts)], "doc string, text string, number string")


def test_structure(spark):
    got = [tuple(r) for r in M.headings(documents(spark, MD, None, "", "без заголовков"), "doc", "text").orderBy("doc", "place").collect()]
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in got[:4]] == [(2, "1", "1. Общие положения", 0, 3), (3, "1.1", "1.1. Область", 3, 5), (4, None, "Без номера", 5, 7), (4, "1.1.1", "1.1.1. Первый", 7, 9)]
    assert [r[7] for r in got[:3]] == ["Введение к главе.", "Текст области, см. п. 3.2.1 и табл. 3.1.", "Подпункт."] and len(got) == 9
    assert got[-1][7] == "###### не заголовок"


def test_chunk_rows(spark):
    ignore = F.array(F.lit("Содержание"), F.lit(""))
    rows = M.chunk_rows(documents(spark, MD, None), "doc", "text", F.filter(ignore, lambda x: x != "")).orderBy("place").collect()
    assert [r.chunk_id for r in rows] == ["d0/1", "d0/1.1", "d0/_h1", "d0/1.1.1", "d0/_h3", "d0/1/occurrence_2", "d0/2"]
    assert [r.section_path for r in rows] == ["1", "1 → 1.1", "1 → 1.1", "1 → 1.1 → 1.1.1", "1 → 1.1 → 1.1.1", "1", "2"]
    assert rows[2].clause_text is None and rows[4].clause_text == "1.1.1. Первый"
    assert rows[1].references == ["п. 3.2.1", "табл. 3.1"]
    assert rows[3].embedding_text == "Заголовок главы: 1. Общие положения\nЗаголовок раздела: 1.1. Область\nЗаголовок пункта: 1.1.1. Первый\n\nПункт первый."


def test_repeated_headings_and_oversized_clause(spark):
    text = "## 1. A\nодин\n## 1. A\nдва\n## 1. A\nтри\n#### 1.1. B\n" + "\n\n".join(["слово " * 8] * 4)
    rows = M.chunk_rows(documents(spark, text), "doc", "text", None, most_tokens=40, overhead=10).orderBy("place", "part").collect()
    assert [r.chunk_id for r in rows] == ["d0/1", "d0/1/occurrence_2", "d0/1/occurrence_3", *(f"d0/1.1/part_{i}" for i in (1, 2))]
    assert rows[3].clause == "1.1 (ч. 1)" and rows[3].text == "\n\n".join(["слово " * 8] * 2)


def test_atomic_blocks(spark):
    text = "абзац\nвторая строка\n| a | b |\n|---|---|\n| 1 | 2 |\nпосле\n\n```\nкод\n\n| не таблица |\n```\nхвост"
    blocks, none = (r[0] for r in documents(spark, text, None).select(M.atomic_blocks(F.col("text"))).collect())
    assert blocks == ["абзац\nвторая строка", "| a | b |\n|---|---|\n| 1 | 2 |", "после", "```\nкод\n\n| не таблица |\n```", "хвост"] and none is None
    table = "| a | b |\n" + "| 1 | 2 |\n" * 40
    got = documents(spark, "перед\n\n" + table + "\n\nпосле").select(M.parts(F.col("text"), 20)).head()[0]
    assert got == ["перед", table.strip("\n"), "после"]
    assert documents(spark, "a\n\nb\n\nc").select(M.parts(F.col("text"), 4, F.length, 2)).head()[0] == ["a\n\nb", "c"]


def test_tables_with_captions_and_markers(spark):
    text = "<!-- t_p1_0 -->\n\nТаблица 1 — Токи\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nтекст\n| c |\n|---|\n\n*Таблица 2*\n| d |\n|---|\n| | не таблица\n\n| одна строка |"
    got = [tuple(r)[1:7] for r in M.tables(documents(spark, text, None, "нет"), "doc", "text").orderBy("doc", "n").collect()]
    assert got == [(1, 3, 7, 2, "t_p1_0", "Таблица 1 — Токи"), (2, 8, 10, 0, "t_p1_0", "Таблица 2"), (3, 12, 15, 1, "t_p1_0", "")]
    image = M.images(documents(spark, "a\n![Схема](image/fig_1.png) и ![](image/fig_2.png)\n![x](other.png)"), "doc", "text").orderBy("n").collect()
    assert [tuple(r)[1:] for r in image] == [(1, "Схема", "image/fig_1.png", 1), (2, "", "image/fig_2.png", 1)]


def test_content_match_and_binding(spark):
    rows = lambda x: spark.createDataFrame([("d", i, c) for i, c in x], "doc string, id string, cells array<string>")
    pairs = M.content_candidates(rows([("a", ["x", "y"]), ("b", ["x", "y", "z"]), ("c", ["q"])]), rows([("1", ["x", "y"]), ("2", ["y", "z", "w"])]))
    match = {r.left_id: (r.right_id, round(r.best, 3), round(r.second, 3)) for r in M.content_match(pairs).collect()}
    assert match == {"a": ("1", 1.0, 0.25), "b": ("1", 0.667, 0.5)}
    assert {(r.left_id, r.right_id) for r in M.content_binding(pairs).collect()} == {("a", "1"), ("b", "2")}
    assert M.content_binding(pairs.limit(0)).count() == 0


def test_binding_is_in_order_of_tables(spark):
    import random

    rng = random.Random(3)
    pairs = [("d" + str(rng.randrange(3)), f"{i:02d}", f"r{j}", rng.choice([0.05, 0.1, 0.3, 0.5])) for i in range(12) for j in range(5) if rng.random() < 0.6]
    pairs = [(f"d{int(i) % 3}", i, j, s) for _, i, j, s in pairs]
    want = set()
    for doc in {p[0] for p in pairs}:
        used = set()
        for i in sorted({p[1] for p in pairs if p[0] == doc}):
            free = sorted((-s, j) for d, k, j, s in pairs if (d, k) == (doc, i) and s >= 0.1 and j not in used)
            if free:
                used.add(free[0][1])
                want.add((doc, i, free[0][1]))
    df = spark.createDataFrame(pairs, "doc string, left_id string, right_id string, similarity double")
    assert {(r.doc, r.left_id, r.right_id) for r in M.content_binding(df).collect()} == want


def test_mentions(spark):
    assets = spark.createDataFrame([("t1", "d", "Таблица 2", None), ("t2", "d", "Таблица 2.1 — Токи", None), ("f", "d", "fig_1", "image/fig_1.png"), ("o", "e", "Таблица 2", None)], "asset_id string, doc string, caption string, image_path string")
    chunks = spark.createDataFrame([("c1", "d", "см. Таблица 2.1 — Токи и ![](image/fig_1.png)"), ("c2", "d", "в таблице 2"), ("c3", None, "Таблица 2"), ("c4", "d", None)], "chunk_id string, doc string, text string")
    assert {tuple(r) for r in M.mentions(assets, chunks).collect()} == {("t1", "c1"), ("t2", "c1"), ("f", "c1")}


def test_ancestors_inherit_a_clause(spark):
    rows = [(1, 2, "1", "A"), (2, 4, None, "без"), (3, 4, "1.1.1", "B"), (4, 5, None, "C"), (5, 2, "2", "D"), (6, 4, None, "E")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, place int, level int, number string, heading_text string")
    got = {r.place: (r.clause, r.clause_text) for r in with_ancestors(df, "doc", ["place"]).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("1.1.1", "B"), 4: ("1.1.1", "B"), 5: (None, None), 6: (None, None)}


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLES = f"table_id bigint, doc_key string, page int, table_index int, bbox {BOX}, cells array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>, caption string, table_num string, is_continuation boolean"


def scanned(spark, *rows):
    cells = [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b")]
    return spark.createDataFrame([(i, "d", page, 0, box, cells, caption, number, goes_on) for i, (page, box, caption, number, goes_on) in enumerate(rows)], TABLES)


def test_stitching(spark):
    wide, narrow, low = (100.0, 100.0, 1500.0, 500.0), (100.0, 100.0, 700.0, 2000.0), (100.0, 1500.0, 1500.0, 2200.0)
    tables = scanned(
        spark,
        (0, low, "Таблица 1", "1", False),
        (1, wide, None, None, False),  # goes on under it
        (2, wide, "Продолжение таблицы 1", "1", True),  # the number of the group's first table
        (3, narrow, "Продолжение таблицы 2", "2", True),  # another number: a group of its own
        (4, wide, None, None, False),  # under a table of less than half its width
        (5, wide, "Продолжение", None, True),  # no number, as the group's first table
    )
    got = [(r["group"], r.part) for r in O.stitch_groups(tables).orderBy("table_id").collect()]
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)]


def test_a_caption_belongs_to_the_next_table_only(spark):
    tables = scanned(spark, (0, (0.0, 300.0, 9.0, 400.0), None, None, False), (0, (0.0, 600.0, 9.0, 700.0), None, None, False), (1, (0.0, 50.0, 9.0, 90.0), None, None, False))
    blocks = [(1, 0, (0.0, 100.0, 9.0, 120.0), "Таблица 1"), (2, 0, (0.0, 200.0, 9.0, 220.0), "Таблица 2"), (3, 0, (0.0, 250.0, 9.0, 270.0), "текст")]
    blocks = spark.createDataFrame([(i, "d", p, b, "TEXT", t, None, None) for i, p, b, t in blocks], f"block_id bigint, doc_key string, page int, bbox {BOX}, layout_type string, text string, is_table_caption boolean, is_continuation_caption boolean")
    assert {r.table_id: r.caption_block for r in O.captions_above(tables, blocks).collect()} == {0: 2, 1: None, 2: None}


def test_numbers_slugs_and_signs(spark):
    captions = [("table", "Таблица 19 — Токи", "19"), ("table", "Таблица Д.1", "д.1"), ("table", "", None), ("table", "Просто подпись", None), ("table", "к Таблице 3", None), ("image", "fig_1", "1"), ("image", "Рисунок 3 — Схема", "3"), ("image", None, None)]
    df = spark.createDataFrame(captions, "kind string, caption string, want string")
    assert all(r[0] == r[1] for r in df.select(T.caption_number(F.col("kind"), F.col("caption")), "want").collect())
    slugs = {"ГОСТ 18410—73": "GOST_18410_73", "СП 297.1325800.2017": "SP_297_1325800_2017", "СНиП Щит ЖЦ": "SNiP_Schit_ZhC", "—": "DOC"}
    df = spark.createDataFrame(list(slugs.items()), "id string, want string")
    assert all(r[0] == r[1] for r in df.select(T.slug(F.col("id")), "want").collect())
    text = "Таблица 2.1 — Токи\n| a | b |\n|---|---|\n| 1 | 2 |\nпроза\n| c | d |\n|:---|---:|\n| нет | правила |\n\n| x | y |\n| 1 | 2 |"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(T.without_tables(F.col("t"))).collect()
    assert got[0][0] == "Таблица 2.1 — см. прикреплённое изображение\nпроза\n(таблица — см. прикреплённое изображение)\n\n| x | y |\n| 1 | 2 |" and got[1][0] is None


def grid(*rows):
    return [(r, c, 1, 1, text) for r, row in enumerate(rows) for c, text in enumerate(row)]


def with_cells(spark, *tables):
    rows = [(i, "d", i, 0, (0.0, 0.0, 1.0, 1.0), cells, caption, number, goes_on) for i, (cells, caption, number, goes_on) in enumerate(tables)]
    return spark.createDataFrame(rows, TABLES)


def test_stitched_tables_keep_data_rows(spark):
    one = grid(["Имя", "N"], ["а", "1"], ["б", "2"])
    two = grid(["имя", "N"], ["а", "1"], ["в", "3"], ["б", "2"])
    rows = {r.group: r for r in O.stitched_tables(with_cells(spark, (one, "Таблица 1", "1", False), (two, "Продолжение", "1", True), (None, "Таблица 2", "2", False))).collect()}
    assert rows[1].markdown == "| Имя | N |\n|---|---|\n| а | 1 |\n| б | 2 |\n| в | 3 |\n| б | 2 |" and (rows[1].caption, rows[1].n_parts) == ("Таблица 1", 2)
    assert rows[2].markdown is None and rows[2].n_parts == 1


def test_notes_and_headers(spark):
    noted = grid(["a", "b"], ["П р и м е ч а н и е — да", "и ещё"])
    alike, plain, short = grid(["a", "b"], ["одно", "одно"]), grid(["a", "b"], ["1", ""]), grid(["Примечание"])
    tables = with_cells(spark, *[(c, None, None, False) for c in (noted, alike, plain, short, None)])
    assert {r.table_id: r.note for r in O.table_notes(tables).collect()} == {0: "П р и м е ч а н и е — да и ещё", 1: "одно"}
    spanned = [(0, 0, 2, 1, "Общий"), (0, 1, 1, 2, "Kc"), (1, 1, 1, 1, "2"), (1, 2, 1, 1, "3")]
    headers = {r.table_id: (r.header, r.merged) for r in O.merged_headers(with_cells(spark, (spanned, None, None, False), (plain, None, None, False))).collect()}
    assert headers == {0: (["Общий", "Kc 2", "Kc 3"], True), 1: (["a", "b"], False)}
