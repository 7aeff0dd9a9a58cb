"""Baselines, folds and roll-ups over error records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.functions.knowledge import CATEGORIES
from fableguard.plans.facts import small


def true_positives(test: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    """Test errors whose signature the baseline lacks."""
    return test.join(baseline.select(*on).distinct(), on, "left_anti")


def filtered_errors(test: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    return test.join(baseline.select(*on).distinct(), on, "left_semi")


def numbered(items: DataFrame, name: str) -> DataFrame:
    """rn and n of each item in order. Books and chapter lists are few: one small window numbers them."""
    items = items.select(name).distinct()
    return items.withColumn("rn", F.row_number().over(Window.orderBy(name))).crossJoin(items.agg(F.count("*").alias("n")))


def _slices(items: DataFrame, name: str, ks: list[int], guard: Column, size: Column, clamp: bool) -> DataFrame:
    """(k, fold, item) of contiguous slices."""
    ks_ = items.sparkSession.sql("SELECT explode(array(" + ",".join(map(str, ks)) + ")) AS k")
    rows = numbered(items, name).crossJoin(ks_).where(guard)
    at = F.floor((F.col("rn") - 1) / size).cast("int")
    fold = F.least(at, F.col("k") - 1) if clamp else at
    return rows.withColumn("fold", fold).where(F.col("fold") < F.col("k")).select("k", "fold", name)


def _roles(tests: DataFrame, items: DataFrame, name: str, empty_train: bool = False) -> DataFrame:
    """(k, fold, item, role): each fold's own items test, all others train; with one fold all do both."""
    folds = tests.select("k", "fold").distinct()
    test = tests.withColumn("role", F.lit("test"))
    everything = folds.crossJoin(items.select(name).distinct())
    train = everything.join(tests, ["k", "fold", name], "left_anti")
    alone = everything.where("k = 1")
    if empty_train:
        alone = everything.join(train.select("k", "fold").distinct(), ["k", "fold"], "left_anti")
    return test.unionByName(train.unionByName(alone).distinct().withColumn("role", F.lit("train")))


def folds_contiguous(books: DataFrame, ks: list[int], name: str = "book") -> DataFrame:
    """Slices of floor(n/k) items, the last with the remainder; k above n is skipped, k = 1 trains and tests on all."""
    tests = _slices(books, name, ks, F.col("k") <= F.col("n"), F.greatest(F.lit(1), F.floor(F.col("n") / F.col("k"))), True)
    return _roles(tests, books, name)


def folds_contiguous_open(books: DataFrame, ks: list[int], name: str = "book") -> DataFrame:
    """The same with slices of one item where k reaches n; later folds are empty."""
    tests = _slices(books, name, ks, F.lit(True), F.greatest(F.lit(1), F.floor(F.col("n") / F.col("k"))), True)
    return _roles(tests, books, name)


def folds_truncating(books: DataFrame, ks: list[int], name: str = "book") -> DataFrame:
    """Without the remainder, whose items are never tested; a fold without training items trains on its test items."""
    tests = _slices(books, name, ks, F.lit(True), F.greatest(F.lit(1), F.floor(F.col("n") / F.col("k"))), False)
    return _roles(tests, books, name, empty_train=True)


def folds_combinations(books: DataFrame, k: int, name: str = "book") -> DataFrame:
    """Every subset of k items (4 at most) as a test set: b1 < b2 < ..."""
    if not 1 <= k <= 4:
        raise ValueError("k must be 1 to 4")
    out = books.select(F.col(name).alias("b1")).distinct()
    for i in range(2, k + 1):
        nxt = books.select(F.col(name).alias(f"b{i}")).distinct()
        out = out.join(nxt, F.col(f"b{i - 1}") < F.col(f"b{i}"))
    return out


def fold_evaluate(errors: DataFrame, folds: DataFrame) -> DataFrame:
    """k, fold, source, true_positives, filtered: errors (book, variant, source, sig) of each fold's test books against its training books.

    Errors are not copied per fold: each signature of a test book gets the books whose originals hold it, at most as
    many as there are books, in one join; a fold then only asks whether one of these trains it. Books and folds are few.
    """
    test = errors.where("variant = 'modified'").groupBy("book", "source", "sig").agg(F.count("*").alias("n"))
    holders = errors.where("variant = 'original'").groupBy("source", "sig").agg(F.collect_set("book").alias("holders"))
    held = test.join(holders, ["source", "sig"], "left").groupBy("book", "source", F.array_sort(F.coalesce("holders", F.array().cast("array<string>"))).alias("holders")).agg(F.sum("n").alias("n"))
    trains = folds.where("role = 'train'").groupBy("k", "fold").agg(F.collect_set("book").alias("trains"))
    both = held.join(folds.where("role = 'test'"), "book").join(trains, ["k", "fold"], "left")
    known = F.coalesce(F.arrays_overlap("holders", "trains"), F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return both.groupBy("k", "fold", "source").agg(total(~known)("true_positives"), total(known)("filtered"))


def fold_evaluate_slices(errors: DataFrame, items: DataFrame, ks: list[int], group: list[str], item: str) -> DataFrame:
    """k, fold, source, true_positives, filtered over contiguous folds of the items of each group, k up to their number.

    items: group, item, rn (from 1), n of its group. A fold's training items lie outside its slice, so a signature is known to
    training if its least or its greatest holder among the originals does: two numbers a signature, however many items there are.
    With one fold all items train. Folds of several groups are counted together.
    """
    at = errors.join(items, [*group, item])
    holders = at.where("variant = 'original'").groupBy(*group, "source", "sig").agg(F.min("rn").alias("low"), F.max("rn").alias("high"))
    test = at.where("variant = 'modified'").groupBy(*group, "source", "sig", "rn", "n").agg(F.count("*").alias("errors"))
    both = test.join(holders, [*group, "source", "sig"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("k <= n")
    size = F.floor(F.col("n") / F.col("k"))
    both = both.withColumn("fold", F.least(F.floor((F.col("rn") - 1) / size), F.col("k") - 1).cast("int"))
    first = F.col("fold") * size + 1
    last = F.when(F.col("fold") == F.col("k") - 1, F.col("n")).otherwise(first + size - 1)
    known = F.coalesce((F.col("k") == 1) & F.col("low").isNotNull() | (F.col("low") < first) | (F.col("high") > last), F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("errors")).otherwise(0)).alias
    return both.groupBy("k", "fold", "source").agg(total(~known)("true_positives"), total(known)("filtered"))


def fold_aggregate(evaluated: DataFrame, folds: DataFrame) -> DataFrame:
    """k, folds, true_positives, filtered, mean_true_positives; folds without any error count as zero."""
    per_fold = folds.select("k", "fold").distinct().join(evaluated, ["k", "fold"], "left").groupBy("k", "fold").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true_positives", "filtered")))
    return per_fold.groupBy("k").agg(F.count("*").alias("folds"), F.sum("true_positives").alias("true_positives"), F.sum("filtered").alias("filtered"), F.round(F.avg("true_positives"), 6).alias("mean_true_positives"))


# --- roll-ups


def count_by(errors: DataFrame, name: str, values: list[str], other: str | None = None) -> DataFrame:
    """name, n for each value, zeros too; what is not listed counts as ``other`` if that is given."""
    spark = errors.sparkSession
    c = F.col(name) if other is None else F.when(F.col(name).isin(values), F.col(name)).otherwise(other)
    counts = errors.groupBy(c.alias(name)).agg(F.count("*").alias("n"))
    dim = small(spark, [(v,) for v in [*values, *([other] if other else [])]], name)
    return dim.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def category_source_matrix(errors: DataFrame) -> DataFrame:
    """category, llm, logic, total, share, ratio (logic per llm, null without llm)."""
    counts = errors.groupBy("category").agg(*(F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("llm", "logic")), F.count("*").alias("total"))
    dim = small(errors.sparkSession, [(c,) for c in CATEGORIES], "category")
    rows = dim.join(counts, "category", "left").na.fill(0, ["llm", "logic", "total"]).crossJoin(errors.where(F.col("category").isin(*CATEGORIES)).agg(F.count("*").alias("all")))
    ratio = F.round(F.col("logic") / F.nullif("llm", F.lit(0)), 6)
    return rows.select("category", "llm", "logic", "total", F.round(F.col("total") / F.nullif("all", F.lit(0)), 6).alias("share"), ratio.alias("ratio"))


def category_winner(matrix: DataFrame) -> DataFrame:
    won = F.when(F.col("llm") > F.col("logic"), "llm").when(F.col("logic") > F.col("llm"), "logic")
    return matrix.select("category", won.alias("winner")).where("winner is not null")


def story_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per story of both sources; a missing side is zero."""
    sides = [errors.where(F.col("source") == s).groupBy(*keys).agg(F.count("*").alias(s)) for s in ("llm", "logic")]
    both = reduce(lambda a, b: a.join(b, keys, "full_outer"), sides).na.fill(0, ["llm", "logic"])
    return both.withColumn("total", F.col("llm") + F.col("logic"))


def corpus_summary(errors: DataFrame, stories: DataFrame) -> DataFrame:
    """Totals over all of stories (story_id), with and without errors: with_errors counts those that have one at least."""
    n = errors.groupBy("story_id").agg(F.count("*").alias("n"))
    stories = stories.select("story_id").distinct().join(n, "story_id", "left").na.fill(0, ["n"])
    a = stories.agg(F.count("*").alias("stories"), F.sum("n").alias("errors"), F.round(F.avg("n"), 6).alias("mean"), F.count(F.when(F.col("n") > 0, 1)).alias("with_errors"))
    return a.crossJoin(errors.agg(F.countDistinct("sig").alias("signatures"), F.countDistinct("book").alias("books")))


def timing_summary(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum("duration"), 4).alias("seconds"), F.round(F.avg("duration"), 4).alias("mean_seconds"))


def call_stats(calls: DataFrame, *by: str) -> DataFrame:
    """Calls of a log (call_log_scan) by status and ``by``: calls, seconds, mean_prompt, mean_response, longest_response."""
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return calls.groupBy(*by, "status").agg(
        F.count("*").alias("calls"), F.round(F.sum("duration"), 4).alias("seconds"),
        mean("prompt_length", "mean_prompt"), mean("response_length", "mean_response"), F.max("response_length").alias("longest_response"),
    )


def rollup_report(errors: DataFrame) -> DataFrame:
    """Counts by category, source and book and at all levels above, in one pass; level tells which are rolled up."""
    return errors.rollup("category", "source", "book").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
