"""Model answers, files of runs, histories, numbering and fragments on small cases."""

import json

from pyspark.sql import functions as F

from fableguard.operators import answers, errors, evaluate, numbering
from fableguard.sources import stories

FENCE = "`" * 3


def test_no_answer_vanishes(spark):
    report = {"error_count": 5, "errors": [{"id": "a", "category": "Temporal", "description": "d\n{x}"}, {"category": "odd"}, 7]}
    parts = {"llm_lint": {"errors": [{"id": "l"}]}, "logic_lint": {"errors": "none"}}
    cases = {
        1: json.dumps(report),
        2: f"<think>a {{ b</think> Sure:\n{FENCE}json\n{json.dumps(report, indent=1)}\n{FENCE}",
        3: json.dumps(report).replace("\\n", "\n\x01\t"),
        4: json.dumps(parts),
        5: '{"error_count": 1, "errors": [}',
        6: "nothing",
        7: None,
        8: '{"errors": []}',
        9: '{"error_count": 2, "errors": {}}',
        10: '{"error_count": "x", "errors": []}',
        11: "[1, 2]",
        12: '{"error_count": null, "errors": null}',
    }
    table = spark.createDataFrame(list(cases.items()), "id int, response string")
    parsed = answers.parse_answers(table)
    got = {(r["id"], r["part"]): (r["reason"], r["error_count"]) for r in parsed.collect()}
    want = {(k, "report"): (None, 3) for k in (1, 2, 3)} | {(4, "llm_lint"): (None, 1), (4, "logic_lint"): ("errors_not_list", 0)}
    want |= {(5, "report"): ("bad_json", 0), (6, "report"): ("no_json", 0), (7, "report"): ("no_answer", 0), (8, "report"): ("missing_keys", 0)}
    want |= {(9, "report"): ("errors_not_list", 0), (10, "report"): ("bad_count", 0), (11, "report"): ("no_json", 0)}
    assert {k: v for k, v in got.items() if k[0] != 12} == want
    assert got[12, "report"][0] in ("errors_not_list", "missing_keys")
    found = {(r["id"], r["n"]): r for r in answers.extract_errors(parsed.withColumnRenamed("id", "answer"), "llm", ["answer"]).where("answer = 3 or answer = 4").collect()}
    assert {(k, r["category"], r["description"]) for k, r in found.items()} == {(("a", 0), "temporal", "d\n\t{x}"), (("llm_1", 1), "coherence", "Error 1"), (("l", 0), "coherence", "l")}
    assert answers.extract_errors(parsed, "logic", ["id"]).count() == 0


def test_a_run_counts_once(spark, tmp_path):
    """A repeated run replaces its own records, as does one that broke off half way; a retried task leaves its rows once."""
    path = str(tmp_path / "history")
    df = spark.range(20).repartition(4)
    stories.history_append(df, path, "a")
    stories.history_append(df, path, "b")
    fails = F.udf(lambda k: 1 // 0 if k == 7 else k, "long")
    try:
        stories.history_append(df.select(fails("id").alias("id")), path, "b")
    except Exception:
        pass
    assert spark.read.json(path).groupBy("run_id").count().orderBy("run_id").collect() == [("a", 20), ("b", 20)]
    stories.history_append(df.where("id < 5"), path, "b")
    assert spark.read.json(path).groupBy("run_id").count().orderBy("run_id").collect() == [("a", 20), ("b", 5)]


def test_folders_of_a_run(spark, tmp_path):
    for folder, name, text in [("stories", "b_Chapter_01.txt", "Once."), ("llm_results", "b_Chapter_01.json", '{"a": 1}'), ("llm_results", "b_Chapter_02.json", "{"), ("logic_results", "plain.json", "[]")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = {(r["book"], r["chapter"]): r for r in stories.results_scan(spark, str(tmp_path)).collect()}
    assert set(got) == {("b", "01"), ("b", "02"), ("plain", None)}
    assert (got["b", "01"]["stories"], got["b", "01"]["llm_results"]) == ("Once.", '{"a": 1}')
    assert set(got["b", "01"]["missing"]) == {"structured_json", "logic_results", "fol_rules"}
    assert got["b", "02"]["llm_results"] is None and got["b", "02"]["corrupt"][0].startswith("llm_results: ") and "llm_results" not in got["b", "02"]["missing"]


def test_readers(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "one.txt").write_bytes(b"A \xff")
    assert [tuple(r) for r in stories.flat_story_scan(spark, str(tmp_path / "flat")).collect()] == [("one", "A �")]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "s1.json").write_text(json.dumps({"events": [{"id": "e1", "type": "go", "agent": ["a", "b"]}]}, indent=1))
    row = stories.structured_story_scan(spark, str(tmp_path / "json")).first()
    assert (row["story_id"], json.loads(row["events"][0]["agent"])) == ("s1", ["a", "b"])
    (tmp_path / "calls.jsonl").write_text('{"type": "lint", "prompt": "abc", "response": ""}\n{"type": "lint", \n[1]\n\n{"prompt_length": 9, "response": "xy", "status": "late"}\n')
    got = [(r["type"], r["prompt_length"], r["response_length"], r["status"], r["line"]) for r in stories.call_log_scan(spark, str(tmp_path / "calls.jsonl")).collect()]
    assert sorted(got, key=str) == sorted([("lint", 3, 0, "empty", None), (None, None, None, "corrupt", '{"type": "lint", '), (None, None, None, "corrupt", "[1]"), (None, 9, 2, "late", None)], key=str)
    stories.summary_sink(spark.range(1), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 1
    assert [tuple(r) for r in stories.response_table(spark.range(1).selectExpr("id", "'x' r"), "id", "r").collect()] == [("0", "lint", "x")]


def test_one_book_is_numbered_by_many_tasks(spark):
    df = spark.range(3000).selectExpr("if(id % 50 = 0, null, 'b') book", "3000 - id chapter").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.number_rows(df, ["book"], ["chapter"])
        for book, rows in ((None, 60), ("b", 2940)):
            own = got.where(F.col("book").eqNullSafe(book)).orderBy("chapter").collect()
            assert [r["rn"] for r in own] == list(range(1, rows + 1))
        assert got.where("book = 'b'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slices_know_what_arrays_of_books_know(spark):
    rows = [(f"b{k % 9}", v, "llm", f"s{(k * k) % 7}") for k in range(60) for v in ("original", "modified") if (k + len(v)) % 3]
    e = spark.createDataFrame(rows, "book string, variant string, source string, sig string")
    books = e.select("book").distinct()
    items = evaluate.numbered(books, "book").withColumn("all", F.lit("x"))
    ks = [1, 2, 4, 9]
    got = evaluate.fold_evaluate_slices(e.withColumn("all", F.lit("x")), items, ks, ["all"], "book")
    want = evaluate.fold_evaluate(e, evaluate.folds_contiguous(books, ks))
    key = lambda df: sorted(map(tuple, df.select("k", "fold", "source", "true_positives", "filtered").collect()))
    assert key(got) == key(want)


def test_fragments_by_keyword(spark):
    text = "Anna came. " + "x" * 300 + ". The old mill stood! anna left\nthe MILL. " + "y" * 250 + " Anna."
    rows = spark.createDataFrame([(text, "Anna and 'mill' and \"Anna\" or It"), ("short", "Short"), (None, "Anna"), (text, None), ("", "Anna")], "t string, d string")
    got = [[tuple(x) for x in r[0]] if r[0] is not None else None for r in rows.select(errors.fragments_by_keyword(F.col("t"), F.col("d"))).collect()]
    assert [x[0] for x in got[0]] == ["Anna", "Anna", "mill", "mill"]
    assert got[0][0][1:3] == (0, text.index(". The"))
    assert all(x[3] == text[x[1] : x[2]].strip() for x in got[0])
    assert got[1] == [] and not got[2] and not got[3] and got[4] == []
