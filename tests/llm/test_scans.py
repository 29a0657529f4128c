from itertools import product

from skein.llm.scans import _flat, as_number, correction_candidates, distance, furniture, malformed, repaired, repeated_headers

BLOCKS = "block_id bigint, doc_key string, page int, pos int, layout_type string, text string, word string, n string"
TABLES = "table_id bigint, doc_key string, page int, caption string, rest string"
GOOD = "Проверку опорной лестницы выполняют по графику, результат заносят в журнал формы. Сопротивление насоса измеряют прибором класса"


def run(spark, blocks, captions=(), filler=30):
    rows = [(-1, "d", 0, 0, "SECTION_HEADER", "ГОСТ 70001—79"), (-2, "d", 0, 1, "SECTION_HEADER", "Насосы. Общие требования")]
    rows += [(-10 - i, f"e{i}", 1, 5, "TEXT", GOOD) for i in range(filler)]
    rows += [(i, "d", page, pos, "TEXT", text) for i, (page, pos, text) in enumerate(blocks)]
    left = spark.createDataFrame([(*r, "x", "y") for r in rows], BLOCKS)
    right = spark.createDataFrame([(i, "d", page, text, "z") for i, (page, text) in enumerate(captions)], TABLES)
    out = {(r.src_table, r.row_id): (r.text, r.damaged) for r in repaired(left, right).collect()}
    assert all(not out["ocr_blocks", -10 - i][1] for i in range(filler)) and not out["ocr_blocks", -1][1]
    return out


def test_repairs(spark):
    out = run(
        spark,
        [
            (1, 0, "Проверку опор-\nной лес- тницы выполняют"),
            (1, 1, "Сопротив–\nление наcоса н3меряют прибором"),
            (1, 2, "Проверку л е с т н и ц ы выполняют"),
            (1, 3, "[2]"),
            (1, 4, "НАСОСЫ. ОБЩИЕ ТРЕБОВАНИЯ"),
            (1, 5, "Проверку опорной\nлестницы выполняют"),
            (1, 6, "Масса 35 кг класса М25, длина 1О м"),
            (1, 7, "результат заносят в жур-"),
            (2, 0, "— 3 —"),
            (2, 1, "нал формы. Проверку выполняют"),
            (2, 2, "ГОСТ 70002—80"),
            (2, 3, "984"),
            (2, 4, "Г0СТ 70001—79 (проект)\nПроверку выполняют 3 из 9 по графику"),
            (2, 5, None),
            (2, 6, ""),
            (2, 7, "результаг заносят в журнал"),
        ],
        [(1, "Таблица 1.1 — Проверку лесmницы"), (1, "Табл. 1 \n— 2 —"), (1, None), (1, "Таблица 2 — Проверку насоса")],
    )
    block = lambda i: out["ocr_blocks", i]
    assert block(0) == ("Проверку опорной лестницы выполняют", True)
    assert block(1) == ("Сопротивление насоса измеряют прибором", True)
    assert block(2) == ("Проверку лестницы выполняют", True)
    assert block(3) == ("", True) and block(4) == ("", True) and block(8) == ("", True)
    assert block(5) == ("Проверку опорной лестницы выполняют", False)
    assert block(6) == ("Масса 35 кг класса М25, длина 10 м", True)
    assert block(7) == ("результат заносят в журнал", True) and block(9) == ("формы. Проверку выполняют", True)
    assert block(10) == ("ГОСТ 70002—80", False) and block(11) == ("984", False)
    assert block(12) == ("Проверку выполняют по графику", True)
    assert block(13) == ("", False) and block(14) == ("", False)
    assert block(15) == ("результат заносят в журнал", True)
    assert out["ocr_tables", 0] == ("Таблица 1.1 — Проверку лестницы", True)
    assert out["ocr_tables", 1] == ("Табл. 1", True)
    assert out["ocr_tables", 2] == ("", False) and out["ocr_tables", 3] == ("Таблица 2 — Проверку насоса", False)


def test_repeated_rows_and_long_text(spark):
    long = " ".join([GOOD] * 400) + " лесmницы"
    out = run(spark, [(1, 0, long), (1, 1, "выполняют по графи-"), (1, 1, "выполняют по графи-"), (1, 2, "ку"), (1, 2, "ку")])
    assert out["ocr_blocks", 0][0].endswith(" лестницы")
    assert out["ocr_blocks", 1] == out["ocr_blocks", 2] == ("выполняют по графику", True)
    assert out["ocr_blocks", 3] == out["ocr_blocks", 4] == ("", True)


def test_empty_tables(spark):
    blocks, tables = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], TABLES)
    assert repaired(blocks, tables).count() == 0


def test_candidates_against_brute_force(spark):
    words = {"лестницы": 40, "лестнице": 35, "лесгницы": 1, "насоса": 50, "нaсоса": 2, "журнал": 30, "журнап": 1, "прочный": 2, "1О": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {(r.word, r.candidate) for r in correction_candidates(df).collect()}
    want = {
        (w, c)
        for w in words
        for c in words
        if w != c and not malformed(c) and words[c] >= 4 and words[c] >= 10 * (0 if malformed(w) else words[w]) and as_number(w) is None and distance(w, c) <= 0.95
    }
    assert got == want | {("1О", "10")} and ("лесгницы", "лестницы") in got


def test_furniture():
    assert furniture("Текст [3] дальше", 2, None, None) == ("Текст\nдальше", False, True)
    assert furniture("Текст [4] дальше", 2, None, None) == ("Текст [4] дальше", False, False)
    assert furniture("ГОСТ 1", 0, "ГОСТ 1", None, True) == ("ГОСТ 1", False, False)
    assert furniture("Издание официальное", 3, None, None) == ("", True, False)


def test_copies_count_once(spark):
    ends = ["по плану", "по схеме", "по форме", "в срок", "до пуска", "после пуска", "на месте", "на стенде", "в цехе", "у входа", "при пуске", "за смену"]
    texts = [f"Контроль нагрузки ведут {e}" for e in ends]
    texts += [f"Основание уложено {e}" for e in ends[:5]]
    copied = "Проверку нагрузкн ведут ежедневно, труба уложена ровно"  # и read as н
    blocks = [(2, i, t) for i, t in enumerate(texts)] + [(3, i, copied) for i in range(60)] + [(4, 0, "Ведут учасrке")]
    out = run(spark, blocks)
    fixed = {out["ocr_blocks", i] for i in range(len(texts), len(texts) + 60)}
    assert fixed == {("Проверку нагрузки ведут ежедневно, труба уложена ровно", True)}
    assert [out["ocr_blocks", i] for i in range(len(texts))] == [(t, False) for t in texts]
    assert out["ocr_blocks", len(blocks) - 1] == ("Ведут учасrке", True)


def test_headers_by_repetition_and_long_tokens(spark):
    blocks = [(f"d{d}", page, pos, text) for d in range(3) for page in range(1, 5) for pos, text in enumerate(["Для служебного пользования", f"{GOOD} {d}{page}", "Проверку выполняют"])]
    blocks += [("d0", 7, 0, "начало страницы"), ("d0", 7, 1, "Насос работает.\nДля слyжебного пользования"), ("d0", 7, 2, "Папка Для служебного пользования хранится отдельно")]
    blocks += [("d1", 8, 0, "Aб1" * 4000), ("d1", 8, 1, "абвгд" * 2000)]
    rows = [(i, d, page, pos, "TEXT", text, "x", "y") for i, (d, page, pos, text) in enumerate(blocks)]
    left, right = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], TABLES)
    assert repeated_headers(left) == [_flat("Для служебного пользования"), _flat("Проверку выполняют")]
    out = {r.row_id: (r.text, r.damaged) for r in repaired(left, right).collect()}
    assert all(out[i] == ("", True) for i in range(0, 36, 3))
    assert out[37] == ("Насос работает.", True) and out[38] == (blocks[38][3], False)
    assert out[40][0] == blocks[40][3] and repeated_headers(left.limit(0)) == []


def test_more_headers_than_tasks_hold(spark):
    names = ["Глава о насосах " + "".join(x) for x in product("адежкмрхфэюя", repeat=3)][:150]
    pages = [(f"d{d}", 3 * i + p, i) for d in range(2) for i in range(len(names)) for p in range(1, 4)]
    blocks = [(d, page, pos, text) for d, page, i in pages for pos, text in enumerate([names[i], f"{GOOD} {d}{page}"])]
    blocks += [("d0", 999, 0, GOOD), ("d0", 999, 1, f"Насос работает.\n{names[149]}"), ("d0", 999, 2, f"Папка {names[149]} хранится отдельно")]
    rows = [(i, d, page, pos, "TEXT", text, "x", "y") for i, (d, page, pos, text) in enumerate(blocks)]
    left, right = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], TABLES)
    assert len(repeated_headers(left)) == 150
    for out in (repaired(left, right), repaired(left, right, most_headers=20)):
        out = {r.row_id: (r.text, r.damaged) for r in out.collect()}
        assert len(out) == len(rows)
        assert all(out[i] == ("", True) for i in range(0, 2 * len(pages), 2)) and not any(out[i][1] for i in range(1, 2 * len(pages), 2))
        assert out[len(rows) - 2] == ("Насос работает.", True) and out[len(rows) - 1] == (blocks[-1][3], False)


def test_headings_of_copied_documents_are_no_headers(spark):
    heading = "Безопасность работ"
    blocks = [(f"c{d}", page, pos, text) for d in range(10) for page in (1, 2) for pos, text in enumerate([heading, f"{GOOD} {page}"])]
    rows = [(i, d, page, pos, "TEXT", text, "x", "y") for i, (d, page, pos, text) in enumerate(blocks)]
    assert repeated_headers(spark.createDataFrame(rows, BLOCKS)) == []
    others = [(-i, f"e{i}", 1, pos, "TEXT", text, "x", "y") for i in range(1, 4) for pos, text in enumerate([heading, f"{GOOD} {i} e"])]
    assert repeated_headers(spark.createDataFrame(rows + others, BLOCKS)) == [_flat(heading)]
