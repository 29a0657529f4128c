"""Cases with literal expected values for citations, list requests, JSON and targeted search."""

from pyspark.sql import functions as F

from skein.operators import answers as A


def test_citations(spark):
    texts = ["По [СП 89.13330.2016, п. 16.1] и ГОСТ 31996—2012, табл. 19", "без цитат", "[СО 153-34.21.122-2003; табл. 3.1]", "п. 4", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.has_citations(F.col("t")).alias("has"), A.citations(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.has for r in got] == [True, False, True, False, False]
    assert [(c.kind, c.number) for c in got[0].c] == [("п.", "16.1"), ("табл.", "19")] and got[0].c[1].document.endswith("ГОСТ 31996—2012")
    assert [tuple(c) for c in got[2].c] == [("СО 153-34.21.122-2003", "табл.", "3.1")] and got[3].c == [] and got[4].c is None


def test_requests_for_the_list(spark):
    asks = {
        "Перечисли документы": True, "список документов": True, "Какие документы в базе?": True, "что есть в базе": True, "Что загружено?": True, "какие гост/сп есть в базе": True, "Какие нормативы есть": True,
        "Какие нормативы регламентируют высоту": False, "какие нормативные документы регламентируют": False, "высота молниеотвода": False, "": False, None: False,
    }
    df = spark.createDataFrame(list(asks.items()), "q string, want boolean")
    assert all(r.got == r.want for r in df.select("q", "want", A.asks_for_documents(F.col("q")).alias("got")).collect())


def test_json_in_prose(spark):
    texts = {'{"k": 1}': 1, 'Ответ:\n```json\n{"k": 2}\n```': 2, 'так {не json} и {"k": 3, "a": {"b": "}"}} конец': 3, "[1]": None, "{": None, "": None, None: None}
    df = spark.createDataFrame(list(texts.items()), "t string, want int")
    got = df.select("want", F.get_json_object(A.json_object(F.col("t")), "$.k").cast("int").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_matched_citations(spark):
    cited = spark.createDataFrame([(1, "СП 1.2", "п.", "3.1"), (1, "ГОСТ 5—79", "табл.", "2"), (1, None, "п.", "1"), (2, "СП 1.2", "п.", "3.1")], "query_id int, document string, kind string, number string")
    results = spark.createDataFrame([(1, 10, 2, "b", "СП 1.2.2017", "3 → 3.1"), (1, 11, 1, "a", "СП 1.2.2017", "3 → 3.1 "), (1, 12, 3, "c", "СП 9", "3.1"), (1, 13, 4, "d", None, None)], "query_id int, result_id int, rank int, chunk_id string, document_id string, section_path string")
    assets = spark.createDataFrame([("t2", "ГОСТ 5-79", "table", "Таблица 2", ["x", "y"]), ("t3", "ГОСТ 5-79", "table", "Таблица 2", ["z"]), ("t4", None, "table", None, None)], "asset_id string, document_id string, asset_type string, caption string, chunk_ids array<string>")
    assert {tuple(r) for r in A.matched_citations(cited, results, assets).collect()} == {(1, "a"), (1, "x"), (1, "y")}


def test_targeted_chunks(spark):
    assets = [("ГОСТ 5-79", "table", "Таблица 1", ["g1"]), ("СП 7.13330.2010", "table", "Таблица 1 — Токи", ["s1", "s2"]), ("СП 7.13330.2010", "image", "fig_4", ["s4"]), (None, "table", "Таблица 1", ["n"])]
    assets = spark.createDataFrame(assets, "document_id string, asset_type string, caption string, chunk_ids array<string>")
    questions = {1: "что в таблице 1?", 2: "СП 7.13330, табл. 1", 3: "рис. 4", 4: "таблица 9", 5: "таблица 1 в ГОСТ 5—79 и СП 7", 6: None, 7: "", 8: "гост 5-79 таблица 1"}
    df = spark.createDataFrame(list(questions.items()), "id int, text string")
    assert {(r.id, r.chunk_id) for r in A.targeted_chunks(df, assets).collect()} == {(2, "s1"), (2, "s2"), (3, "s4"), (8, "g1")}


def test_named_documents(spark):
    questions = spark.createDataFrame([(1, "по СП 89.13330 и гост 31996"), (2, "СП 8"), (3, None)], "id int, text string")
    documents = spark.createDataFrame([("СП89.13330.2016",), ("ГОСТ31996-2012",), ("СП8.1",), (None,)], "document string")
    assert {tuple(r) for r in A.named_documents(questions, documents).collect()} == {(1, "СП89.13330.2016"), (1, "ГОСТ31996-2012"), (2, "СП8.1")}
