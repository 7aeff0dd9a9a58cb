"""The stages on a small table with copies, near copies, texts without letters and a missing id."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    long = " ".join(f"word{k} the and" for k in range(60))
    texts = [long, long, long + " end", "The other text is about a thing and more.", "12345 !!!", None, "Der Hund und die Katze sind nicht hier."]
    rows = [(k, t, "de" if t and t.startswith("Der") else "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)]
    rows += [(k, f"The thing {k} and the other with this {'der und nicht ' * (k % 2)}", "de" if k % 2 else "en", "a", 0) for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {4, 5} & set(kept["language ID"])
    assert {0, 1, 2, 3, 6} <= set(kept["language ID"])
    assert 0 not in kept["exact dedup"]
    assert {1, 2} <= set(kept["exact dedup"])
    assert 2 not in kept["near duplicates"]
    assert 1 in kept["near duplicates"]
    assert sorted(kept["encoding"]) == sorted(kept["mixing"])
    assert set(kept["mixing"]) <= set(kept["near duplicates"])


def test_language_stage_without_labels(spark):
    rows = [(k, t, None, "a", len(t or "")) for k, t in enumerate(["The thing and the other.", "Der Hund", "12345 !!!", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.detect_language(spark, docs, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_columns_that_clash(spark, tmp_path):
    """Columns named like the stages' own stay as they are; repeated and missing ids, a long text and an empty table pass."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, Mixed_Copies int, mixed_copy int, any_kept string"
    rows = [(k % 9 if k % 7 else None, f"The thing {k} and the other.", "en", "ab"[k % 2], 5, f"r{k}", k, -k, "z") for k in range(30)]
    rows += [rows[3], (50, "The word and " * 20000, "en", "a", 0, "long", 0, 0, None)]
    for name, table in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame(table, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, None)
            docs.write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{n}"))
            if n < 4:
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                held = {tuple(r)[5:] for r in docs.collect()}
                assert held <= {r[5:] for r in table}
                assert n > 1 or name == "empty" or len(held) == 31
    assert docs.count() == 0
