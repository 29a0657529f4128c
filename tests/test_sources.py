"""Pages as JSON, sinks, and clean-up, with literal expected values."""

import json

from pyspark.sql import functions as F

from skein.functions import cleaning as C
from skein.sources import pages as P
from skein.sources import rows as R


def corners(x0, y0, x1, y1):
    return {"vertices": [{"x": str(x0), "y": y0}, {"x": x1, "y": str(y1)}]}


def line(text, box):
    return {"text": text, "boundingBox": corners(*box)}


PAGE = {
    "result": {
        "textAnnotation": {
            "width": "1000", "height": 2000,
            "blocks": [
                {"layoutType": "LAYOUT_TYPE_SECTION_HEADER", "boundingBox": corners(0, 0, 9, 9), "lines": [line("1.2. Общие ", (100, 50, 300, 60)), line(" ", (0, 60, 1, 61)), line("положения", (90, 62, 200, 70))]},
                {"layoutType": "LAYOUT_TYPE_SECTION_HEADER", "lines": [line("2 Справа", (700, 100, 900, 120))]},
                {"layoutType": "LAYOUT_TYPE_TEXT", "boundingBox": corners(0, 500, 900, 520), "lines": []},
                {"layoutType": "LAYOUT_TYPE_TEXT", "lines": [line("в таблице", (0, 620, 10, 640))]},
                {"layoutType": "LAYOUT_TYPE_CAPTION", "lines": [line("Продолжение таблицы 3", (0, 900, 10, 920))]},
            ],
            "tables": [{"boundingBox": corners(0, 600, 900, 700), "cells": [{"rowIndex": "0", "columnIndex": 1, "columnSpan": "2", "text": "a\nb "}]}],
        }
    }
}


def test_pages(spark):
    df = spark.createDataFrame([("d", 0, json.dumps(PAGE)), ("d", 1, "{broken"), ("d", 2, None), ("d", 3, "{}")], "doc string, page int, content string")
    pages = P.parse_pages(df)
    got = [(r.page, r.pos, r.layout_type, r.text, r.heading_level, r.heading_number, r.is_table_caption, r.is_continuation_caption) for r in P.page_blocks(pages).orderBy("pos").collect()]
    assert got == [
        (0, 0, "SECTION_HEADER", "1.2. Общие положения", 2, "1.2", False, False),
        (0, 1, "SECTION_HEADER", "2 Справа", None, None, False, False),
        (0, 2, "TEXT", "", None, None, False, False),
        (0, 4, "CAPTION", "Продолжение таблицы 3", None, None, True, True),
    ]
    tables = P.page_tables(pages).collect()
    assert [(r.page, r.table_index, tuple(r.bbox), [tuple(c) for c in r.cells]) for r in tables] == [(0, 0, (0.0, 600.0, 900.0, 700.0), [(0, 1, 1, 2, "a b")])]


def test_pages_from_files_and_rows_in_files(spark, tmp_path):
    (tmp_path / "pages.json").write_text(json.dumps({"doc": "d", "page": 0} | PAGE) + "\n")
    assert P.page_blocks(P.read_pages(spark, str(tmp_path / "pages.json"))).count() == 4
    assets = spark.createDataFrame([("t1", "ГОСТ 1", None), ("t2", "ГОСТ 2", "Таблица 1")], "asset_id string, document_id string, caption string")
    for _ in range(2):
        R.write_rows(assets, str(tmp_path / "assets"), ["document_id"])
    assert R.read_assets(spark, str(tmp_path / "assets")).where("asset_type IS NULL").select("asset_id", "caption").orderBy("asset_id").collect() == [("t1", None), ("t2", "Таблица 1")]
    assert R.read_rows(spark, str(tmp_path / "assets"), "asset_id string, document_id string").orderBy("asset_id").collect()[0] == ("t1", "ГОСТ 1")


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_cleaning(spark):
    assert one(spark, C.italic_labels, "текст\n## Таблица 1 — Токи\n| a |\n\nРис. 2\nТ а б л и ц а 3\nв таблице 4", None) == ["текст\n\n*Таблица 1 — Токи*\n| a |\n\n*Рис. 2*\n\n*Т а б л и ц а 3*\nв таблице 4", None]
    assert one(spark, C.italic_image_captions, "![x](image/fig_1.png)\nРис. 1 — Схема\nРис. 2") == ["![x](image/fig_1.png)\n*Рис. 1 — Схема*\nРис. 2"]
    assert one(spark, C.joined_digits, "0 , 4 2 9 и 1 2", "нет", "") == ["0,429 и 12", "нет", ""]
    assert one(spark, C.refused, None, " ", "Не удалось распознать таблицу", "I'm sorry", "| a |") == [True, True, True, True, False]
    assert one(spark, C.doubtful_tables, "<!-- WARN_3.1 --> и <!--WARN_2--> <!-- WARN_3.1 -->", "") == [["3.1", "2"], []]
    assert one(spark, C.plain_formulas, r"по $k = 0 , 5 \mathbf{ x }$ и 1 2; $$a \mathrm{ мм } \, 3 4$$ цена 5 $") == ["по $k = 0,5 x$ и 1 2; $$\na \\text{мм} 34\n$$ цена 5 $"]
