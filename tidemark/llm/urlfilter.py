"""URL filters: rules first, then the ratio of two character language models.

Rules on host and path decide what they fit, and every URL that they decide is an example of an
accepted or a rejected one. From all these examples two Markov models of characters are counted, of
orders 0 to `ORDER`, each order smoothed by the one below it (Witten-Bell), so the order that speaks
varies with what was seen. A URL's score is the difference of its log-likelihoods, divided by its
length; the threshold is the one that separates held-out examples best (Youden's index).

Characters are read as they are. The models are tables of counted n-grams and grow with the corpus:
one row for each distinct n-gram, so that smoothing joins distinct n-grams only, each with at most
an alphabet of others. Scoring has to look up every place of every URL: n-grams that make up a
1/`HOT` of all places or more, of which there are `HOT` at most, are broadcast; any other is rare
by that definition, so a join by n-gram has no hot key. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.common import cut, table

#: Stands before and after a URL; one inside a URL reads like an edge.
EDGE = "\x01"
#: Characters before the one that is predicted.
ORDER = 4
#: No more n-grams than this are broadcast (5 characters and a number each).
HOT = 1 << 16
#: Log-likelihood differences are kept as integers of 1/UNIT; thresholds are multiples of 1/STEP.
UNIT, STEP = 65536, 256
#: One example in HOLD_OUT is kept for the threshold.
HOLD_OUT = 5

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what the models read: all after `://` with the host in lower case, or the whole URL without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    body = F.coalesce(F.when(at > 0, F.concat(host, F.substr(rest, F.length(host) + 1))).otherwise(url), F.lit(""))
    return host, path, body


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; null where none fits."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    return rule, says


def grams(body: Column) -> Column:
    """For each character of `body` and its end: the ORDER characters before it and itself."""
    chars = F.split(F.concat(F.lit(EDGE * ORDER), body, F.lit(EDGE)), "")
    return let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, F.lit(ORDER + 1)), "")))


def model(bodies: DataFrame) -> DataFrame:
    """gram, n, ratio: each n-gram of the rows (body, yes, no), how often it occurs in them, and the difference of the log-likelihoods of its last character.

    `yes` and `no` are how many examples of either kind a body is; the n-grams of other bodies are
    in the table with what the examples say of them.
    """
    kinds = ("yes", "no")
    counted = cut(bodies.select(F.explode(grams(F.col("body"))).alias("gram"), *kinds).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in kinds]))
    levels = [counted]
    for k in range(ORDER, 0, -1):
        levels.insert(0, cut(levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*[F.sum(c).alias(c) for c in kinds])))
    uniform = 1 / max(1, levels[0].count())
    below = None
    for k, seen in enumerate(levels):
        before = Window.partitionBy(F.substring("gram", 1, k))  # no more rows than characters
        rows = seen
        for c in kinds:
            rows = rows.withColumn(f"all_{c}", F.sum(c).over(before)).withColumn(f"kinds_{c}", F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(before))
        if below is None:
            rows = rows.withColumn("p_yes", F.lit(uniform)).withColumn("p_no", F.lit(uniform))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k)).join(below, "shorter")
        smooth = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}")) for c in kinds}
        below = rows.select(F.col("gram").alias("shorter"), *[smooth[c].alias(f"p_{c}") for c in kinds], *(["n"] if k == ORDER else []))
    return cut(below.select(F.col("shorter").alias("gram"), "n", F.round((F.ln("p_yes") - F.ln("p_no")) * UNIT).cast("long").alias("ratio")))


def scored(bodies: DataFrame, fitted: DataFrame) -> DataFrame:
    """id, step: the score of each row of `bodies` (id, body) in steps of 1/STEP, rounded down."""
    places = bodies.select("id", F.explode(grams(F.col("body"))).alias("gram"))
    total = fitted.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(fitted.where(F.col("n") * HOT >= total).select("gram", "ratio"))  # their n add up to `total` at most, so HOT rows at most
    rare = fitted.where(F.col("n") * HOT < total).select("gram", "ratio")
    looked_up = places.join(common, "gram").unionByName(places.join(common.select("gram"), "gram", "left_anti").join(rare, "gram"))
    sums = looked_up.groupBy("id").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("places"))
    return sums.select("id", F.floor(F.col("total") / (F.col("places") * (UNIT // STEP))).alias("step"))


def threshold(held: DataFrame) -> int:
    """The step from which held-out examples (step, yes, no) are accepted; 0 if one kind has none."""
    most = 64 * STEP
    step = F.least(F.greatest(F.col("step"), F.lit(-most)), F.lit(most)).alias("step")
    counts = held.groupBy(step).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # a row for each of 2 * most + 1 steps at most
    all_yes, all_no = sum(r["yes"] for r in counts), sum(r["no"] for r in counts)
    if not all_yes or not all_no:
        return 0
    best, at, above_yes, above_no = -1, 0, 0, 0
    for r in sorted(counts, key=lambda r: -r["step"]):
        above_yes, above_no = above_yes + r["yes"], above_no + r["no"]
        if (index := above_yes * all_no - above_no * all_yes) >= best:
            best, at = index, r["step"]
    return at


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Id, host, path, rule and verdict of each row.

    A null URL or one without `://` has an empty host and path, which no rule fits; the models judge
    the whole string, and a null one as empty. Equal URLs get equal verdicts; ids may be null or
    repeat. With no examples of one kind the models are uniform for it and the threshold is 0. No
    rows give no rows; other columns are not read.
    """
    host, path, body = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), body.alias("body"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumn("rule", rule).withColumn("says", says))
    fold = F.conv(F.substring(F.md5("body"), 1, 4), 16, 10).cast("int") % HOLD_OUT
    examples = {name: F.count(F.when((F.col("says") == verdict) & of_fold, 1)).alias(name) for name, verdict, of_fold in (("yes", "allow", fold > 0), ("no", "block", fold > 0), ("held_yes", "allow", fold == 0), ("held_no", "block", fold == 0))}
    bodies = rows.groupBy("body").agg(*examples.values(), F.max(F.col("says").isNull()).alias("open"))
    bodies = cut(bodies.withColumn("id", F.monotonically_increasing_id()))
    wanted = bodies.where("open or held_yes + held_no > 0")
    steps = cut(scored(wanted, model(bodies)).join(wanted.select("id", "body", "open", F.col("held_yes").alias("yes"), F.col("held_no").alias("no")), "id"))
    least = threshold(steps.where("yes + no > 0"))
    verdicts = steps.where("open").select("body", F.when(F.col("step") >= least, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))
    by_model = rows.where("says is null").join(verdicts, "body").select("id", "host", "path", "rule", "verdict")
    by_rule = rows.where("says is not null").select("id", "host", "path", "rule", F.col("says").alias("verdict"))
    return by_rule.unionByName(by_model).withColumnRenamed("id", id_col)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    lower = f"'{UPPER}', '{UPPER.lower()}'"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    cases = {}
    for k, what in enumerate(("verdict", "rule")):
        whens = []
        for verdict, text in longest:
            domain, _, start = text.partition("/")
            whens.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}') THEN '{(verdict, text)[k]}'")
        cases[what] = f"CASE {' '.join(whens)} END"
    levels, smooth = [], []
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            levels.append(f"s{k} AS (SELECT substr(gram, 2) AS gram, sum(yes) AS yes, sum(no) AS no FROM s{k + 1} GROUP BY 1),")
    one = "CASE WHEN s.all_{0} > 0 THEN (s.{0} + s.kinds_{0} * p.{0}) / (s.all_{0} + s.kinds_{0}) ELSE p.{0} END AS {0}"
    for k in range(ORDER + 1):
        shorter = f"l{k - 1} p ON p.gram = substr(s.gram, 2)" if k else "(SELECT 1.0::DOUBLE / count(*) AS yes, 1.0::DOUBLE / count(*) AS no FROM s0) p ON true"
        smooth.append(f"""
c{k} AS (SELECT gram, yes, no, sum(yes) OVER b AS all_yes, sum(no) OVER b AS all_no, count(*) FILTER (yes > 0) OVER b AS kinds_yes, count(*) FILTER (no > 0) OVER b AS kinds_no
  FROM s{k} WINDOW b AS (PARTITION BY left(gram, {k}))),
l{k} AS (SELECT s.gram, {one.format("yes")}, {one.format("no")} FROM c{k} s JOIN {shorter}),""")
    edges = " || ".join(["chr(1)"] * ORDER)
    return f"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS mark, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {lower}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
h AS (SELECT page_id, host, path, coalesce(CASE WHEN mark > 0 THEN host || substr(rest, length(host) + 1) ELSE url END, '') AS body FROM p),
r AS (SELECT *, {cases["rule"]} AS rule, {cases["verdict"]} AS says, ('0x' || substr(md5(body), 1, 4))::INT % {HOLD_OUT} AS fold FROM h),
w AS (SELECT body, count(*) FILTER (says = 'allow' AND fold > 0) AS yes, count(*) FILTER (says = 'block' AND fold > 0) AS no FROM r GROUP BY body),
e AS (SELECT body, yes, no, {edges} || body || chr(1) AS padded, unnest(range(1, length(body) + 2)) AS i FROM w),
g AS (SELECT body, yes, no, substr(padded, i, {ORDER + 1}) AS gram FROM e),
s{ORDER} AS (SELECT gram, sum(yes) AS yes, sum(no) AS no FROM g GROUP BY gram),
{" ".join(levels)}{"".join(smooth)}
t AS (SELECT body, floor(sum(round((ln(l.yes) - ln(l.no)) * {UNIT}))::DOUBLE / (count(*) * {UNIT // STEP})) AS step FROM g JOIN l{ORDER} l USING (gram) GROUP BY body),
c AS (SELECT step, count(*) FILTER (says = 'allow') AS yes, count(*) FILTER (says = 'block') AS no FROM r JOIN t USING (body) WHERE says IS NOT NULL AND fold = 0 GROUP BY step),
i AS (SELECT step, sum(yes) OVER (ORDER BY step DESC) * sum(no) OVER () - sum(no) OVER (ORDER BY step DESC) * sum(yes) OVER () AS j, sum(yes) OVER () * sum(no) OVER () AS pairs FROM c),
least_step AS (SELECT coalesce((SELECT step FROM i WHERE pairs > 0 ORDER BY j DESC, step LIMIT 1), 0) AS step)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN t.step >= (SELECT step FROM least_step) THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN t USING (body)
"""


OP4_SQL = _sql()
