"""Work that has to grow with the input, against the plain forms of the same operators."""

import json

from pyspark.sql import functions as F

from fableguard.operators import errors, fluents, partial_order, rules, structured, timeline
from fableguard.plans import rule_queries
from fableguard.plans.adapters import events_as_story
from fableguard.plans.facts import Facts
from fableguard.plans.store import FactStore
from fableguard.sources.stories import RUN_FOLDERS, pack_run, parse_stories, results_scan

INTERVALS = "story_id string, event_id long, start_ord long, end_ord long, t_start long, t_end long"


def told(spark):
    """Events that come twice, that are told with several intervals, or that lack a rank, a time or an id."""
    rows = [("a", k % 9, k % 5, k % 5 + k % 3, k % 5, k % 5 + k % 3) for k in range(40)]
    rows += [("a", 90, None, None, None, None), ("a", None, 1, 2, 1, 2), ("b", 1, 0, 0, 0, 0), ("b", 2, 0, 5, 0, 5), ("b", 2, 0, 5, 0, 5), ("c", 1, 3, 3, 3, 3)]
    df = spark.createDataFrame(rows, INTERVALS)
    return Facts(spark, df, df, 2)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_meets_are_counted_without_pairs(spark):
    facts = told(spark)
    got = timeline.meets_count(facts)
    assert sorted(got.collect()) == sorted(timeline.meets(facts).groupBy("story_id").agg(F.count("*").alias("n")).collect())
    assert "Join" not in plan(got)


def test_concurrent_pairs_come_once_without_telling_them_apart(spark):
    facts = told(spark)
    got = timeline.concurrent(facts)
    want = timeline.symmetric(timeline.overlap(facts)).collect()
    assert len(want) > 50 and sorted(got.collect()) == sorted(want)
    assert not plan(got).lstrip().startswith("Aggregate")


def test_a_score_reads_the_text_once(spark):
    df = spark.createDataFrame([("plot", "x", "Before the EFFECT, after"), (None, None, None), ("Location", "x", "cause"), (None, "cause", "time of ubiquity")], "c string, t string, d string")
    got = df.select(errors.by_score(F.col("c"), F.col("t"), F.col("d")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["temporal", "coherence", "location", "causality"]
    assert plan(got).count("lower(coalesce(d") == 1


def test_a_sentence_starts_after_the_line_end_that_the_context_starts_at(spark):
    text = "Abc def ghi\n" + "x" * 199 + "Keyword here"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(errors.fragments_by_keyword(F.col("text"), F.lit('A "keyword"')).alias("x")).first()["x"]
    assert [(x["keyword"], x["start"], x["end"]) for x in got] == [("keyword", 11, len(text))]


def test_no_table_of_a_store_is_sent_through_the_driver(spark):
    spark.range(3).selectExpr("'s' story_id", "id").createOrReplaceTempView("small_cast")
    store = FactStore(spark, "small", "", [], {}, 1, None)
    both = store.side("cast").join(store.side("cast").select("id").distinct(), "id")
    assert both.count() == 3 and "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_structured_facts_that_rules_read_many_times_are_kept_until_released(spark):
    story = {"events": [{"id": "e1", "type": "lock", "patient": "door", "time": {"start": "t1"}}, {"id": "e2", "type": "lock", "patient": "box", "time": {"start": "t2"}}]}
    story |= {"fluents": [{"id": "shut(box)", "time_start": "t1"}], "rules": [{"type": "precondition", "head": "lock(A,B)", "body": ["shut(B)"]}]}
    facts = structured.load(parse_stories(spark.createDataFrame([("s", json.dumps(story))], "id string, j string"), "id", "j"))
    read = [facts.events, facts.event_role, facts.fluents, facts.preconditions, facts.effects]
    assert all(df.storageLevel.useMemory for df in read)
    assert [(r["subject"], r["detail"]) for r in rules.precondition_not_met(facts, "base").where("detail = 'shut'").collect()] == [("e1", "shut")]
    facts.release()
    assert not any(df.storageLevel.useMemory for df in read)


def test_packed_files_of_a_run_are_read_like_files_of_their_own(spark, tmp_path):
    texts = [("stories", "b 1_Chapter_01", "Once.\n"), ("llm_results", "b 1_Chapter_01", '{"a": 1}'), ("llm_results", "b 1_Chapter_02", "{"), ("logic_results", "plain", "[]"), ("fol_rules", "c", None)]
    for folder, name, text in texts:
        if text is not None:
            (tmp_path / "loose" / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / "loose" / folder / f"{name}.json").write_text(text)
    rows = lambda some: spark.createDataFrame(some, "folder string, name string, text string")
    pack_run(rows(texts), str(tmp_path / "whole"))
    pack_run(rows(texts[1:]), str(tmp_path / "mixed"))
    (tmp_path / "mixed" / "stories").mkdir()
    (tmp_path / "mixed" / "stories" / "b 1_Chapter_01.txt").write_text("Once.\n")
    told = lambda run: sorted((r["book"], r["chapter"] or "", *(r[f] for f in RUN_FOLDERS), sorted(r["missing"]), len(r["corrupt"])) for r in results_scan(spark, str(tmp_path / run)).collect())
    want = told("loose")
    assert len(want) == 3 and told("whole") == want and told("mixed") == want


def test_few_rows_of_a_key_meet_without_being_copied_for_the_index(spark):
    df = told(spark).events
    pairs = lambda out: sorted(map(str, out.collect()))
    want = pairs(timeline.together(df, ["story_id"], 2))
    for few in (0, 4, 5, 1000):  # story b has three rows, and all but the first of these leave a for the index
        got = timeline.together_by_agent(df, ["story_id"], 2, few)
        assert got.columns == timeline.together(df, ["story_id"], 2).columns and pairs(got) == want
    joined = rules._together(Facts(spark, df.withColumns({"location": F.lit("l"), "type": F.lit("x"), "agent": F.lit("u")}), df, 2), df.withColumns({"location": F.lit("l"), "type": F.lit("x"), "agent": F.lit("u")}))
    assert "LeftAnti" in plan(joined)


def test_validation_takes_a_story_apart_once(spark):
    story = {"entities": {"objects": [{"id": "o1"}, {"id": "o1"}]}, "events": [{"id": "e1", "agent": ["ann", "o1"], "time": {"start": "t2", "end": "t1"}}]}
    rows = [("s", json.dumps(story)), ("s", json.dumps({"entities": {"characters": [{"id": "Ann"}]}})), (None, json.dumps(story))]
    got = structured.validate(parse_stories(spark.createDataFrame(rows, "id string, j string"), "id", "j"))
    own = {("duplicate_id", "o1"), ("ends_before_start", "e1")}
    want = {("s", *x) for x in own | {("malformed_id", "Ann")}} | {(None, *x) for x in own | {("missing_reference", "ann"), ("missing_reference", "o1")}}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert plan(got).count("Generate explode") == 1 and "Join" not in plan(got)


def test_v2_waits_for_no_store(spark):
    found = rule_queries.queries()["violations_v2"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["ruleset", *rule_queries.COLS]
    assert (spark.sparkContext.applicationId, "/root/testdata/sf0.001") not in rule_queries.STORES


def test_what_holds_where_asked_is_dealt_by_fluent_once(spark):
    rows = [("s", k, kind, "l", k, k, k, k, False) for k, kind in enumerate(["open", "look", "close", "look", "look"])]
    events = spark.createDataFrame(rows, "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    roles = spark.createDataFrame([("s", k, "patient", "door") for k in range(5)], "story_id string, event_id long, role string, arg string")
    asked = spark.createDataFrame([("s", "open", who, t, t) for who in ("door", None, "box") for t in range(5)], "story_id string, pred string, arg string, t long, t_ord long")
    for ruleset, want in (("base", [0, 1]), ("general", [0, 1, 3, 4])):
        got = fluents.holds_at(Facts(spark, events, roles), ruleset, asked)
        assert sorted((r["arg"], r["t"]) for r in got.collect()) == [("door", t) for t in want]
        assert plan(got).count("RepartitionByExpression") == 1 and "LeftSemi" not in plan(got)


def test_an_order_is_asked_once_for_what_begins_and_what_ends(spark, monkeypatch):
    edges = spark.createDataFrame([("s", t, t + 1) for t in range(4)], "story_id string, t1 long, t2 long")
    rows = [("s", t, kind, "l", t, t, None, None, False) for t, kind in enumerate(["look", "sleep", "look", "wake", "look"])]
    events = spark.createDataFrame(rows, "story_id string, event_id long, type string, location string, t_start long, t_end long, start_ord long, end_ord long, requires_focus boolean")
    roles = spark.createDataFrame([("s", t, "agent", "ann") for t in range(5)], "story_id string, event_id long, role string, arg string")
    asked = events.selectExpr("story_id", "'asleep' pred", "'ann' arg", "t_start t")
    order, calls = partial_order.Order.of(edges), []
    before = partial_order.Order.before
    monkeypatch.setattr(partial_order.Order, "before", lambda *args: calls.append(args) or before(*args))
    for ruleset, want in (("base", [1, 2]), ("general", [1, 2, 4])):
        assert sorted(r["t"] for r in partial_order.holds_at(Facts(spark, events, roles), order, ruleset, asked).collect()) == want
    assert len(calls) == 2


def test_events_told_in_one_row_with_their_roles_are_not_joined(spark):
    facts = rules.once(events_as_story(spark, "/root/testdata/sf0.001"))
    assert all("Join" not in plan(facts.acts(r)) for r in ("agent", "patient")) and len(facts.held) == 1
    assert sorted(facts.acts().columns) == sorted([*facts.events.columns, "agent"])
    joined = Facts(spark, facts.events, facts.event_role).acts()
    assert sorted(map(str, facts.acts().select(joined.columns).collect())) == sorted(map(str, joined.collect()))
    facts.release()


def test_a_score_takes_no_case_mapping_of_texts_outside_ascii(spark):
    texts = ["KÖNIG CheKhov, UNEXPLAINED", "é BİFORE BEFORE", "é emotİon", "HATES 日本 loves", "Émotıon", "Distance", None]
    df = spark.createDataFrame([(k, None, None, x) for k, x in enumerate(texts)] + [(9, "Temporal", "cause", "é cause")], "k int, c string, t string, d string")
    got = df.select("k", errors.by_score(F.col("c"), F.col("t"), F.col("d")).alias("x"))
    assert [r["x"] for r in got.orderBy("k").collect()] == ["causality", "temporal", "coherence", "emotional", "coherence", "location", "coherence", "temporal"]
    assert plan(got).count("Contains(") == 0 and plan(got).count("octet_length(d") == 1
    letters = spark.range(128, 0x110000).where("id not between 55296 and 57343").selectExpr("id", "lower(decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')) as x")
    assert sorted((r["id"], r["x"]) for r in letters.where("x rlike '[ -~]'").collect()) == [(0x130, "i̇"), (0x212A, "k")]


def test_one_ruleset_alone_writes_no_store(spark, monkeypatch):
    folder, query = "/root/testdata/sf0.001", rule_queries.queries()["violations_narrative_context"]
    monkeypatch.setattr(rule_queries, "STORES", {})
    alone = query(spark, folder)
    assert not rule_queries.STORES
    rule_queries.fact_store(spark, folder)
    kept = query(spark, folder)
    assert alone.columns == kept.columns and "facts_" in plan(kept) and "facts_" not in plan(alone)
    assert alone.count() > 100 and sorted(map(str, alone.collect())) == sorted(map(str, kept.collect()))
    rule_queries.STORES.popitem()[1].drop()


def test_what_stories_say_together_is_read_off_each_once(spark):
    story = {"events": [{"id": "E 1", "type": "eat"}, {"id": "E 2", "type": "eat", "is_significant": True}], "constraints": [{"type": "distance", "location1": "A", "location2": "B"}, {"type": "x"}]}
    story |= {"fluents": [{"id": "love(Ann)"}, {"id": "not(love(Bob))"}, {"name": "love", "args": ["Cy"], "time_start": "T1"}, {"id": "love(a,b)"}, {}], "relationships": [{"type": "enemy", "from": "A", "to": "B"}, {"type": "enemy", "from": "A", "to": ""}]}
    story |= {"rules": [{"type": "Causal", "head": "eat(A,B)", "body": ["not(raw(B))", "two(A,B)"]}, {"type": "precondition", "head": "eat(A,B)", "body": ["raw(B)"]}, {"type": "precondition", "head": "not(eat(A,B))", "body": ["raw(B)"]}, {"type": "precondition", "head": "eat(A)"}]}
    rows = [("s", json.dumps(story)), ("t", json.dumps(story)), ("u", "{}"), ("v", "no story"), ("w", None)]
    got = structured.domain_union(parse_stories(spark.createDataFrame(rows, "id string, j string"), "id", "j"), spark.sql("SELECT 'decorative' AS kind, 'Old Vase' AS id"))
    effects = {("effect", t, p, x) for t, p, x, _ in (*structured.EFFECTS, *structured.DOMAIN_EFFECTS)}
    want = {("distant", "a", "b", None), ("distant", "b", "a", None), ("relationship", "enemy", "a", "b"), ("significant_event", "e_2", None, None), ("initial_event", "e_1", None, None), ("decorative", "old_vase", None, None)}
    want |= {("emotional_state", "ann", "love", "t0"), ("emotional_state", "cy", "love", "t1"), ("effect", "eat", "neg", "raw"), ("precondition", "eat", "pos", "raw")}
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) and set(found) == want | effects
    assert plan(got).count("Generate explode") == 1 and plan(got).count("from_json") == 1 and plan(got).count("Aggregate") == 1


def test_a_storys_rows_meet_blocks_of_rows(spark):
    facts = told(spark)
    rows = lambda out: sorted(map(str, out.collect()))
    ords = [f"{p}_{c}" for p in "ab" for c in ("start_ord", "end_ord")]
    both, ordered = timeline.together(facts.events, ["story_id"], 2), timeline.in_order(facts.events, ["story_id"], 2).drop(*ords)
    for block in (1, 3, 1000):
        got = timeline.together_by_story(facts.events, ["story_id"], 2, block)
        assert got.columns == both.columns and rows(got) == rows(both)
        got = timeline.in_order_by_story(facts.events, ["story_id"], 2, block)
        assert got.columns == ordered.columns and rows(got) == rows(ordered)
    for query in (timeline.precedes, timeline.overlap, timeline.concurrent):
        assert "collect_list" in plan(query(facts)) and "RepartitionByExpression" in plan(query(facts))


def test_two_cells_meet_at_one_node_that_few_others_share(spark):
    cells, sizes = spark.range(64).toDF("c"), {}
    nodes = lambda later: {r["c"]: list(map(tuple, r["n"])) for r in cells.select("c", timeline.quarters("c", "3", later).alias("n")).collect()}
    first, last = nodes(False), nodes(True)
    for a in range(64):
        for b in range(64):
            shared = set(first[a]) & set(last[b])
            assert len(shared) == (a <= b)
            for x in shared:
                sizes[x] = sizes.get(x, 0) + 1
    assert max(sizes.values()) <= sum(sizes.values()) / 8 and max(map(len, first.values())) <= 3 * 4 + 1


def test_an_event_that_ends_before_it_starts_does_not_precede_itself(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01 10:00:00' AS ts, id AS user_id, 'view' AS event_type, -5.0D AS value, 'k1' AS props FROM range(2)").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted((r["e1"], r["e2"]) for r in rule_queries.queries()["precedes"](spark, str(tmp_path)).collect()) == [(0, 1), (1, 0)]


def test_an_order_told_with_its_times_is_not_looked_up_again(spark, tmp_path):
    day = lambda n: f"1996-01-{n:02}" if n else None
    orders = [(1, 7, 10), (1, 7, 12), (2, 7, 10), (3, None, 10), (4, 8, None), (5, 8, 10), (6, 9, 10)]
    lines = [(1, 1, 5, 6, 11), (1, 1, 5, 6, 11), (1, 2, 5, 6, 13), (2, 1, 5, 6, 9), (2, 1, 5, 6, 20), (3, 1, 5, 6, 10), (4, 1, 5, 6, 9), (5, 1, 5, 6, None), (6, None, 1, 2, 3), (6, 1, None, 2, 3), (None, 1, 5, 6, 1)]
    spark.createDataFrame([(o, c, day(d)) for o, c, d in orders], "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(*x, day(d)) for *x, d in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    for r, kind in (("general", "explicit_order_violated"), ("narrative", "explicit_order_violated"), ("v2", "order_violated")):
        got = rule_queries.queries()[f"explicit_order_violated_{r}"](spark, str(tmp_path))
        want = [("7", "o1", "s1-1-5-6"), ("7", "o2", "s2-1-5-6"), (None, "o3", "s3-1-5-6"), ("9", "o6", None)]  # as by the SQL
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((s, "temporal", kind, a, b)) for s, a, b in want)
        assert plan(got).count("Relation [") == 2 and plan(got).count("Aggregate") == 1
    facts = rule_queries._lineitem_story(spark, str(tmp_path))
    looked_up = Facts(spark, facts.events, facts.event_role, 32, {"must_precede": facts.must_precede.drop("ends", "starts")})
    named = lambda f: sorted(map(str, rules.explicit_order_violated(f, "v2").where("story_id is not null and detail is not null").collect()))
    assert named(looked_up) == named(facts)
