"""Symbols, responses, readers and sinks."""

from pyspark.sql import functions as F

from fableguard.functions import symbols
from fableguard.operators import errors
from fableguard.plans import text_queries
from fableguard.sources import stories


def test_sanitize(spark):
    rows = spark.createDataFrame([(None,), ("",), ("123abc",), ("e-1",), ("don't",)], "x string")
    assert [r[0] for r in rows.select(symbols.sanitize_symbol(F.col("x"))).collect()] == ["null", "unknown", "n123abc", "e_1", "dont"]
    one = spark.sql("SELECT array('Hansel', 'Gretel') AS x, 'not(p(a, b))' AS t")
    r = one.select(symbols.sanitize_list(F.col("x")).alias("l"), symbols.parse_term(F.col("t")).alias("t")).first()
    assert r["l"] == "hansel__gretel"
    assert (r["t"]["negated"], r["t"]["functor"], r["t"]["args"]) == (True, "p", ["a", "b"])


def test_json_of_answers(spark):
    rows = spark.createDataFrame([('x {"a": {"b": 1}} tail }',), ("no json",), ('{"a": 1}',), ("{ open",)], "x string")
    assert [r[0] for r in rows.select(errors.extract_json(F.col("x"))).collect()] == ['{"a": {"b": 1}}', None, '{"a": 1}', None]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "book one").mkdir(parents=True)
    (tmp_path / "in" / "book one" / "001.txt").write_bytes(b"It was \xff night.")
    (tmp_path / "in" / "book one" / "note.md").write_text("no")
    assert [tuple(r) for r in stories.corpus_scan(spark, str(tmp_path / "in")).select("chapter", "text").collect()] == [("001", "It was � night.")]
    df = spark.createDataFrame([("p1", "b", "x")], "phase string, book string, v string")
    stories.result_sink(df, str(tmp_path / "out"), "phase", "book")
    stories.result_sink(df, str(tmp_path / "out"), "phase", "book")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    stories.fact_sink(spark.createDataFrame([("s", 1)], "story_id string, e long"), str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).select("story_id", "e").collect()[0]["e"] == 1


def test_whole_texts(spark, tmp_path):
    start = "Zz. " * 60
    rows = [(1, start + "a violation of the temporal timeline and " + " ".join(errors.KEYWORDS["temporal"]), "s", 2), (2, start, "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    q = {k: f(spark, str(tmp_path)) for k, f in text_queries.queries().items() if k.endswith("_whole") or k == "sanitize_list"}
    assert {r["chapter"]: r["symbol"].count("__") for r in q["sanitize_list"].collect()} == {k: len(t.split(" ")) - 1 for k, t, _, _ in rows}
    sig = {r["chapter"]: r["sig"].split(":")[1:] for r in q["signature_words_whole"].collect()}
    assert {"temporal", "timeline", "violation"} <= set(sig[1])
    assert sig[2] == [""]
    quoted = {r["chapter"]: r["sig"] for r in q["signature_quoted_whole"].collect()}
    assert quoted[1] != quoted[2]
    assert len({r["symbol_md5"] for r in q["sanitize_symbol_whole"].collect()}) == 2
    assert {r["chapter"]: r["category"] for r in q["classify_by_score_whole"].collect()}[1] == "temporal"
