"""Personal data by candidate gradient boosting, with DataFrame functions and MLlib only.

Patterns with checks (Luhn, octets, digit counts) give the base spans. High-recall generators propose further,
overlapping candidates: any run of grouped digits, any address with a spelled-out or spaced sign. Boosted trees rate
each candidate by its format and context. They learn from evidence: what a base span confirms is positive, also in a
masked form (phone numbers without their sign, addresses spelled out, card numbers with other signs between), and so is
what its words or its format name; what fails the checks of its kind is negative. A candidate that no base span touches
is no negative for that. Thresholds are calibrated per kind for precision, on the masked forms and on all candidates
with evidence, each rated by trees that didn't see it, and what passes is added to the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import saved, table, uniform

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that long runs cost linear time: a match starts where its run of signs starts or where
#: the last match ended, and gives nothing back that couldn't help.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
}
#: Without one of these signs a text has no match.
NEEDS = {"email": "@", "phone": "+", "address": "[@\\[(]"}
CONTEXT = 16
FEATURES = ("digits", "length", "seps", "dots", "parens", "plus", "luhn", "octets", "at", "letters", "groups", "longest", "glued", "word_before", "sign_before", "spelled", "sentence")
PRECISION = 0.98


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return (F.length(digits) > 0) & (total % 10 == 0)


def octets(match: Column) -> Column:
    """Whether a string is four numbers of at most 255."""
    parts = F.split(match, r"\.")
    small = F.forall(parts, lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.coalesce(F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int"), F.lit(256)) <= 255))
    return (F.size(parts) == 4) & small


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    card = F.length(digits).between(13, 19) & luhn(digits)
    return F.when(kind == "email", True).when(kind == "ip", octets(match)).when(kind == "card", card).otherwise(F.length(digits).between(9, 15))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, hits) per document; a hit is (kind, k, gap, match, before, after), gap what lies since the last one."""
    patterns = BASE | GENERATORS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")

    def found(kind: str) -> Column:
        need = F.col("text").rlike(NEEDS[kind].replace("+", "\\+")) if kind in NEEDS else F.col("numeric")
        return F.when(need, F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))).otherwise(none)

    rows = rows.withColumn("numeric", F.col("text").rlike("[0-9][\\x20().-]{0,2}[0-9]"))
    rows = rows.select("doc_id", "text", *(found(k).alias(f"m_{k}") for k in patterns))
    pieces = [F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()]
    rows = rows.select("doc_id", *(f"m_{k}" for k in patterns), *pieces)

    def hits(kind: str) -> Column:
        gap = lambda k: F.get(F.col(f"p_{kind}"), k)
        return F.transform(f"m_{kind}", lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(gap(k)).alias("gap"), m.alias("match"), F.right(gap(k), F.lit(CONTEXT)).alias("before"), F.left(gap(k + 1), F.lit(CONTEXT)).alias("after")))

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*map(hits, patterns)).alias("hits"))


def features(hits: DataFrame) -> DataFrame:
    """Format and context of each candidate, and the kind that it would be."""
    m, digits = F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    runs = F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0))
    count = lambda signs: F.length("match") - F.length(F.regexp_replace("match", signs, ""))
    out = hits.withColumns({
        "digits": F.length(digits), "length": F.length(m), "seps": count("[\\x20-]"), "dots": count("[.]"), "parens": count("[()]"), "plus": (F.substring(m, 1, 1) == "+").cast("int"),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False).cast("int"), "octets": octets(m).cast("int"), "at": m.rlike("@|[(\\[]at[)\\]]").cast("int"),
        "letters": count("[A-Za-z]"), "groups": F.size(runs), "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        "glued": (F.col("before").rlike("[A-Za-z0-9_=]$") | F.col("after").rlike("^[A-Za-z0-9_@]")).cast("int"),
        "word_before": F.col("before").rlike("(?i)(tel|phone|call|card|mail|contact|ip|address)").cast("int"), "sign_before": F.col("before").rlike("[\"'=:#/$]\\s*$").cast("int"),
        "spelled": m.rlike("[(\\[](at|dot)[)\\]]").cast("int"), "sentence": m.rlike("@[A-Za-z0-9.-]*[A-Za-z0-9-]\\.\\x20").cast("int"),
    })
    return out.withColumn("as", F.when(F.col("at") == 1, "email").when((F.col("dots") == 3) & (F.col("groups") == 4) & (F.col("digits") <= 12), "ip").when(F.col("digits") >= 13, "card").otherwise("phone"))


def evidence(candidates: DataFrame) -> DataFrame:
    """Candidates with their label: 1 where a base span, words or format speak for the kind, 0 where a check or the context speaks against it, else null."""
    kind, m = F.col("as"), F.col("match")
    passes = valid(kind, m)
    other = (F.col("glued") == 1) | F.col("before").rlike("[=#/$]\\s*$") | m.rlike("^(19|20)[0-9]{2}([-.\x20])(0[1-9]|1[0-2])\\2")
    against = ~passes | ((kind == "phone") & other) | ((kind == "email") & (F.col("sentence") == 1) & (F.col("spelled") == 0))
    named = F.when(kind == "email", m.rlike("[(\\[]at[)\\]].*[(\\[]dot[)\\]]")).otherwise(F.col("word_before") == 1)
    return candidates.withColumn("label", F.when(F.col("touched"), F.when(passes, 1)).when(against, 0).when(named, 1))


def masked(candidates: DataFrame) -> DataFrame:
    """Confirmed candidates in forms that no base pattern finds (label 1, which counts in calibration), and broken so that their check fails (label 0)."""
    m, kind = F.col("match"), F.col("as")
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    spelled = lambda at, dot: F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    forms = {
        "phone": [F.regexp_replace(m, "^\\+", ""), F.regexp_replace(m, "^\\+[0-9]{1,3}(?:[\x20.-]|(?=\\())+", ""), F.regexp_replace(m, "^\\+[0-9]{1,3}[\x20.-]*\\(([0-9]+)\\)\x20*", "$1-")],
        "email": [spelled(" [at] ", " [dot] "), spelled("(at)", "(dot)"), spelled("[at]", "."), spelled(" @ ", " . ")],
        "card": [F.regexp_replace(m, "[^0-9]?([0-9]{4})(?=[0-9])", f"$1{sign}") for sign in (".", "--")],
    }
    broken = {
        "phone": F.regexp_extract(m, "^\\+?((?:[^0-9]*[0-9]){8})", 1), "email": F.concat(F.regexp_extract(m, "^([^@]*@[A-Za-z0-9-]+)", 1), F.lit(". The")),
        "card": F.concat(F.expr("left(match, length(match) - 1)"), F.translate(F.right(m, F.lit(1)), "0123456789", "1234567890")), "ip": F.regexp_replace(m, "^[0-9]+", "999"),
    }
    form = lambda text, label: F.struct(text.alias("match"), F.lit(label).alias("label"))
    several = [(kind == k, F.array(*(form(t, 1) for t in forms.get(k, [])), form(broken[k], 0))) for k in KINDS]
    chosen = reduce(lambda c, x: c.when(*x), several[1:], F.when(*several[0]))
    rows = candidates.where("touched and label = 1").select("row", "kind", "k", "before", "after", m.alias("whole"), kind.alias("was"), F.explode(chosen).alias("form"))
    rows = features(rows.select("row", "kind", "k", "before", "after", "whole", "was", "form.*")).where("as = was and match <> whole")
    return rows.where((valid(F.col("as"), F.col("match")) == (F.col("label") == 1)) | ((F.col("as") == "email") & (F.col("label") == 0)))


def rated(candidates: DataFrame, train_rows: int, seed: int = 5) -> DataFrame:
    """Candidates that no base span touches and no check speaks against, where their kind's threshold is reached.

    Candidates are dealt into two halves by hash. The trees of a half learn from a sample by hash of about
    ``train_rows`` of its rows and rate the other half, so all candidates with evidence count for the thresholds. A
    kind without such evidence has the least threshold. Without both classes in each half there is no model, and what
    words or format name is returned.
    """
    draw = lambda n: uniform(F.col("row"), F.col("kind"), F.col("k"), F.lit(seed + n))
    open_ = candidates.where("not touched and label is distinct from 0").withColumn("half", (draw(0) < 0.5).cast("int"))
    forms = masked(candidates).withColumn("counts", F.col("label") == 1)
    known = candidates.where("label is not null").withColumn("counts", ~F.col("touched"))
    cols = ["row", "kind", "k", "as", "label", "counts", *FEATURES]
    known = saved(known.select(cols).unionByName(forms.select(cols)).withColumn("half", (draw(0) < 0.5).cast("int")), "pii-evidence")
    classes = {(r["half"], r["label"]): r["count"] for r in known.groupBy("half", "label").count().collect()}
    if min(classes.get((h, y), 0) for h in (0, 1) for y in (0, 1)) < 10:
        return open_.where("label = 1")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    part = reduce(lambda c, x: c.when((F.col("half") == x[0]) & (F.col("label") == x[1]), min(1.0, train_rows / 2 / classes[x])), classes, F.when(F.lit(False), 0.0))
    learn = vectors.transform(saved(known.where(draw(1) < part).select("half", "label", *FEATURES), "pii-sample"))
    models = [GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, stepSize=0.3, seed=seed).fit(learn.where(F.col("half") == h)) for h in (0, 1)]
    rate = lambda df, h: models[1 - h].transform(vectors.transform(df.where(F.col("half") == h))).withColumn("p", vector_to_array("probability")[1])
    score = lambda df: rate(df, 0).unionByName(rate(df, 1))
    steps = score(known.where("counts")).groupBy("as", (F.floor(F.col("p") * 50) / 50).alias("step")).agg(F.sum("label").alias("right"), F.count("*").alias("n"))
    down = Window.partitionBy("as").orderBy(F.desc("step"))
    sums = steps.select("as", "step", F.sum("right").over(down).alias("right"), F.sum("n").over(down).alias("n"))
    reached = (F.col("right") >= PRECISION * F.col("n")) & (F.col("step") >= 0.5)
    limits = {r["as"]: r["step"] for r in sums.groupBy("as").agg(F.min(F.when(reached, F.col("step"))).alias("step")).collect()}
    limits = {k: limits.get(k, 0.5) for k in KINDS}
    limit = reduce(lambda c, k: c.when(F.col("as") == k, 2.0 if limits[k] is None else limits[k]), KINDS, F.when(F.lit(False), 1.0))
    return score(open_).where(F.col("p") >= limit)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans (kind:start:end, comma-joined).

    Positions count code points, ends are exclusive, base spans of a kind never overlap. A null or empty text has no
    spans; repeated rows are read one by one; an empty table gives no rows.
    """
    found = saved(matches(docs, id_col, text_col), "pii-hits")
    so_far = Window.partitionBy("row", "kind").orderBy("k")
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    hits = saved(hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")), "pii-spans")
    base = hits.where(F.col("kind").isin(*KINDS)).where(valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end")

    # A candidate is touched by a base span if one that starts before its end goes on beyond its start.
    proposed = hits.where(~F.col("kind").isin(*KINDS))
    both = base.select("row", "start", "end", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("k")).unionByName(proposed.select("row", "start", "end", "kind", "k"))
    order = Window.partitionBy("row").orderBy("start", F.col("kind").isNotNull())
    is_base = F.col("kind").isNull()
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touched = both.withColumns({"before_end": before, "after_start": after}).where("kind is not null")
    touched = touched.select("row", "kind", "k", F.coalesce((F.col("before_end") > F.col("start")) | (F.col("after_start") < F.col("end")), F.col("before_end") > F.col("start"), F.col("after_start") < F.col("end"), F.lit(False)).alias("touched"))
    candidates = saved(evidence(features(proposed).join(touched, ["row", "kind", "k"])), "pii-candidates")
    new = rated(candidates, train_rows)
    spans = base.withColumn("base", F.lit(True)).unionByName(new.select("row", F.col("as").alias("kind"), "start", "end", F.lit(False).alias("base")).distinct())
    rank = reduce(lambda c, k: c.when(F.col("kind") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    sorted_spans = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base")))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    joined = spans.groupBy("row").agg(*counts, sorted_spans.alias("all"))
    joined = joined.select("row", *(f"n_{k}" for k in KINDS), text(F.filter("all", lambda s: s["base"])).alias("base_spans"), text(F.col("all")).alias("spans"))
    out = found.select("row", "doc_id").join(joined, "row", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def op4_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
