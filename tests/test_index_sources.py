import json

import pytest
from pyspark.sql import functions as F

from quarry import demo
from quarry.functions import text
from quarry.index import Index
from quarry.operators import crud
from quarry.operators.lexical import BM25
from quarry.sources import files, sinks, tasks
from quarry.streaming.ingest import ingest


def test_crud_plans(spark, rows):
    schema = "doc_id string, doc_ord bigint, text string, meta string"
    base = spark.createDataFrame([("a", 0, "x", '{"k": 1}'), ("b", 1, "y", None)], schema)
    new = spark.createDataFrame([("b", 2, "y2", "{}"), ("b", 3, "y3", "{}"), ("c", 4, "z", "{}"), (None, 5, "n", "{}")], schema)
    assert rows(crud.upsert(base, new), "doc_id", "text") == [("a", "x"), ("b", "y3"), ("c", "z")]
    assert rows(crud.upsert(base, new.where("false")), "doc_id") == [("a",), ("b",)]
    assert rows(crud.delete(base, spark.createDataFrame([("b",), ("zz",), (None,)], "doc_id string")), "doc_id") == [("a",)]
    told = spark.createDataFrame([("a", '{"m": [1]}'), ("b", "bad"), ("q", "{}")], "doc_id string, meta string")
    assert {r.doc_id: json.loads(r.meta) for r in crud.update_metadata(base, told).collect()} == {"a": {"k": 1, "m": [1]}, "b": {}}
    assert {r.doc_id: r.meta for r in crud.update_metadata(base, told, merge=False).collect()} == {"a": '{"m": [1]}', "b": "bad"}


def test_index_lifecycle(spark, tmp_path):
    with Index(spark, str(tmp_path / "ix"), "window") as ix:
        assert len(ix) == 0 and ix.search("nada").count() == 0
        assert ix.add_documents({"a": "A alíquota do imposto.", "b": "O prazo\r\nde recurso.", "c": "", "n": None}, {"ano": 2024}) == 2
        assert len(ix) == 3 and ix.get_document("b") == ("O prazo\nde recurso.", {"ano": 2024})
        assert ix.has_document("c") and not ix.has_document("n") and ix.get_document("n") is None
        assert ix.search("imposto", mode="lexical").first().doc_id == "a"
        # over an old one, of repeated ids the last
        ix.add_documents([("b", "primeiro"), ("b", "novo texto do imposto municipal")])
        assert [r.text for r in ix.chunks_of("b").collect()] == ["novo texto do imposto municipal"]
        ords = [r.doc_ord for r in ix.table("docs").orderBy("doc_ord").collect()]
        assert len(set(ords)) == 3
        assert ix.update_metadata({"a": {"uf": "SP"}, "zz": {}}) == 1
        assert ix.get_document("a")[1] == {"ano": 2024, "uf": "SP"}
        assert ix.update_metadata({"a": {"uf": "RJ"}}, merge=False) == 1 and ix.get_document("a")[1] == {"uf": "RJ"}
        assert [h.doc_id for h in ix.search("imposto", where={"uf": "RJ"}).collect()] == ["a"]
        assert ix.delete_documents(["a", "nope"]) == 1 and ix.delete_documents(["a"]) == 0
        again = Index(spark, str(tmp_path / "ix"))
        before = sorted(map(tuple, again.search("imposto").collect()))
        assert [r[2] for r in before] == ["b"]
        assert again.compact() == 1
        assert sorted(map(tuple, again.search("imposto").collect())) == before
        assert again._known() is not None and again.text_of("b") == "novo texto do imposto municipal"
        assert again.n_chunks == 1 and again.max_ordinal() == 3
        assert [r.doc_id for r in again.document_ids().collect()] == ["c", "b"] and [r.chunk_id for r in again.scan_chunks().collect()] == ["b#0"]
        again.flush(), again.close()
        with pytest.raises(KeyError):
            again.text_of("a")
        s = again.stats().first()
        assert (s.documents, s.chunks, s.dim) == (2, 1, 64)
        assert len(list((tmp_path / "ix").glob("p-*"))) == 1 and not list((tmp_path / "ix").glob("in-*"))
        assert again.finalize() == 1 and again._known() is not None and sorted(map(tuple, again.search("imposto").collect())) == before
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "x"), "other")
    for other in ({"mode": "paragraph"}, {"max_chars": 99}, {"bm25": BM25(tokenizer="singular")}):
        with pytest.raises(ValueError):
            Index(spark, str(tmp_path / "ix"), **other)


def test_changes_write_parts_only(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"), "window")
    ix.add_documents({f"d{i}": f"texto número {i}" for i in range(20)})
    first = next((tmp_path / "ix").glob("p-*"))
    size = sum(f.stat().st_size for f in first.rglob("*.parquet"))
    ix.add_documents({"d3": "outro texto", "novo": "mais um"})
    ix.delete_documents(["d5", "d6"])
    ix.update_metadata({"d7": {"uf": "SP"}})
    assert sum(f.stat().st_size for f in first.rglob("*.parquet")) == size
    tables = {p["number"]: (p["tables"], p["gone"]) for p in ix._manifest()["parts"]}
    assert tables[1] == (["chunks", "docs", "postings", "vectors"],) * 2 and tables[2] == ([], tables[1][1]) and tables[3] == (["docs"], ["docs"])
    for _ in range(2):
        assert len(ix) == 19 and ix.n_chunks == 19 and ix.text_of("d3") == "outro texto" and ix.get_document("d7")[1] == {"uf": "SP"}
        assert {h.doc_id for h in ix.search("texto", 50, "lexical").collect()} == {*(f"d{i}" for i in range(20))} - {"d5", "d6"}
        assert [h.doc_id for h in ix.search("outro", 50, "lexical").collect()] == ["d3"] and ix.search("texto", 50, "dense").count() == 19
        ix.compact()
    assert len(ix._manifest()["parts"]) == 1 and ix.add_documents({"z": "fim"}) == 1 and ix.max_ordinal() == 22


def test_other_tokenizer(spark, tmp_path):
    with pytest.raises(ValueError):
        text.build_tokenizer("none")
    ix = Index(spark, str(tmp_path / "ix"), "window", bm25=BM25(tokenizer="singular"))
    ix.add_documents({"a": "As leis federais", "b": "um contrato"})
    assert [h.doc_id for h in ix.search("lei", mode="lexical").collect()] == ["a"]
    plain = Index(spark, str(tmp_path / "plain"), "window")
    plain.add_documents({"a": "As leis federais"})
    assert plain.search("lei", mode="lexical").count() == 0 and plain.search("LEIS", mode="lexical").count() == 1


def test_question_over_a_delimited_text(spark):
    blob = "=== tributos ===\nA alíquota máxima do imposto é de 27,5%.\n\n=== ambiente ===\nO licenciamento ambiental é preventivo.\n"
    rows, note = demo.ask(spark, "qual a alíquota máxima?", blob, "lexical", 2)
    assert rows[0][0] == 1 and rows[0][2] == "tributos" and rows[0][3] == "0-40" and "27,5%" in rows[0][4] and "2 documents in 2 chunks" in note
    assert demo.ask(spark, "pergunta", "") == ([], "No document given.") and demo.ask(spark, "  ", blob)[0] == []


def test_stream_ingest(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "um"), ("b", None)], "doc_id string, text string").write.json(folder)
    ix = Index(spark, str(tmp_path / "ix"), "window")
    for _ in range(2):
        ingest(spark.readStream.schema("doc_id string, text string").json(folder), ix, str(tmp_path / "cp")).awaitTermination(60)
        assert sorted(r.text for r in ix.table("docs").collect()) == (["um"] if _ == 0 else ["dois", "um"])
        spark.createDataFrame([("c", "dois")], "doc_id string, text string").write.mode("append").json(folder)


def test_memory_and_files(spark, rows, tmp_path):
    assert rows(files.from_memory(spark, ["x", None, "y"])) == [("0", 0, "x"), ("2", 2, "y")]
    assert rows(files.from_memory(spark, [("a", "1"), ("a", "2")])) == [("a", 1, "2")]
    assert files.from_memory(spark, {}).count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.TXT").write_text("olá", encoding="utf-8")
    (tmp_path / "b c.md").write_bytes(b"\xffx")
    (tmp_path / "no.bin").write_text("no")
    got = rows(files.read_files(spark, [str(tmp_path), "/does/not/exist"]), "doc_id", "doc_ord", "text")
    assert [(d.rsplit("/", 1)[1], o, t) for d, o, t in got] == [("b c.md", 0, "�x"), ("a.TXT", 1, "olá")]
    assert rows(files.read_files(spark, [str(tmp_path / "no.bin")]), "text") == [("no",)]
    assert files.read_files(spark, ["/does/not/exist"]).count() == 0


def test_delimited(spark, rows):
    blob = "lost\n=== a ===\nfoo\r\n\nbar\n=== ===\nxx\n=== a ===\nlast\n===e===\n\n"
    df = spark.createDataFrame([(1, blob), (2, "plain\n"), (3, " "), (4, None)], "k int, text string")
    assert rows(files.split_delimited(df, key="k"), "k", "doc_id", "text") == [(1, "a", "last"), (1, "doc1", "xx"), (2, "documento", "plain")]


def test_tasks(spark, rows, tmp_path):
    (tmp_path / "d.csv").write_text('KEY,ENUNCIADO\n1,"<p>um</p>\n dois"\n2,\n')
    (tmp_path / "q.csv").write_text("ID,TEXT\n7, pergunta \n8,sem\n")
    (tmp_path / "r.csv").write_text("QUERY_ID,DOC_ID,SCORE\n7,1,3\n7,1,2\n")
    t = tasks.from_csv(spark, "t", *(str(tmp_path / f) for f in ("d.csv", "q.csv", "r.csv")))
    assert rows(t.docs, "doc_id", "text") == [("1", "um dois")] and rows(t.queries) == [("7", "pergunta")] and rows(t.qrels) == [("7", "1", 3)]
    (tmp_path / "docs.json").write_text(json.dumps([{"filename": "lei.txt", "filedata": " abcdef "}, {"filename": "", "filedata": "x"}]))
    (tmp_path / "qs.json").write_text(json.dumps([{"question_number": "1", "question_text": "q?", "formatted_references": [{"file": "lei.txt"}], "formatted_embedded_references": [{"file": "lei"}, {"file": "fora"}]}, {"question_number": "2", "question_text": "sem"}]))
    j = tasks.from_json(spark, "j", str(tmp_path / "docs.json"), str(tmp_path / "qs.json"), 3)
    assert rows(j.docs, "doc_id", "text") == [("lei", "abc")] and rows(j.qrels) == [("1", "lei", 2)] and rows(j.queries) == [("1", "q?")]
    ranked = spark.createDataFrame([("7", ["1", "9", "1"]), ("8", [])], "`query-id` string, `corpus-ids` array<string>")
    c = tasks.from_tables("c", spark.createDataFrame([("1", "x")], "_id string, text string"), spark.createDataFrame([("7", "a"), ("7", "a"), ("8", "b")], "_id string, text string"), spark.createDataFrame([("7", "1", 1), ("8", "1", 1)], "`query-id` string, `corpus-id` string, score int"), ranked)
    assert rows(c.queries) == [("7", "a")] and rows(c.candidates) == [("7", "1", 0), ("7", "9", 1)] and c.main_score == "map_at_1000"


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("q", 2, "b", 0.5, "b#0", 0, 1, "y"), ("q", 1, "a", 1.0, "a#0", 0, 1, "x")], "qid string, rank int, doc_id string, score double, chunk_id string, start int, end int, text string")
    assert [h["doc_id"] for h in json.loads(sinks.hits_json(hits).first().hits)] == ["a", "b"]
    records = spark.createDataFrame([("t", "e1", 0.5), ("t", "e0", 0.5)], "task string, experiment string, score double")
    sinks.write_results(records, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert sinks.markdown_table(sinks.best_experiments(records)) == "| task | experiment | score |\n|---|---|---|\n| t | e0 | 0.5000 |"


def test_command_line(spark, tmp_path, capsys):
    from quarry import cli

    args = cli.parser().parse_args(["search", "q", "p", "-k", "3", "--json"])
    assert (args.k, args.mode, args.json) == (3, "hybrid", True)
    (tmp_path / "a.txt").write_text("A alíquota do imposto", encoding="utf-8")
    hits = Index(spark, str(tmp_path / "ix"), "window")
    hits.add_documents(files.read_files(spark, [str(tmp_path / "a.txt")]))
    found = hits.search("imposto", mode="lexical")
    assert json.loads(cli.as_json(found))[0]["text"] == "A alíquota do imposto" and cli.as_json(found.where("false")) == "[]"
    assert "0-21" in cli.as_table(found) and cli.as_table(found.where("false")) == ""


def test_metadata(spark, rows):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    by = spark.createDataFrame([("a", '{"k":1}')], "doc_id string, meta string")
    assert rows(crud.assign_metadata(docs, by), "doc_id", "meta") == [("a", '{"k":1}'), ("b", "{}")]
    assert rows(crud.assign_metadata(docs, shared='{"s":1}').withColumn("text", F.lit(1)), "meta") == [('{"s":1}',), ('{"s":1}',)]
