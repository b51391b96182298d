"""Quality rules whose thresholds keep the risk of rejecting good documents limited.

A rule rejects a document on one side of a cutoff. Its cutoffs are a fixed ladder from lenient to strict, so they don't depend on the data they are tested on. Labelled good documents that
pass the base checks are the holdout. Within a stratum, a cutoff that rejects k of n holdout documents is certified when P(Binomial(n, risk) <= k) <= level, which says the same as
that the exact (Clopper-Pearson) upper bound of its rate of false rejection is at most `risk`. The ladder is climbed as long as cutoffs are certified, a
fixed sequence that needs no correction by itself; the level is shared equally by all pairs of stratum and rule (Bonferroni), and a stratum's risk by its rules. So
with probability 1 - LEVEL, in every stratum, at most RISK of the good documents are rejected by the rules together. A stratum with too few labels has no active rule.

Only DataFrame functions: statistics are higher-order functions on a row's words, the binomial tail is an expression, and no text is shuffled.

Defined cases: a null or empty text has no words and fails the base checks; strata are values of `lang`, null being one of them; an id is good if all its labels are 1 (labels without id or quality
are ignored), and each of its rows is in the holdout; without labels no rule is active; rows that repeat are judged one by one; other columns are ignored by `quality_report` and kept by `keep_clean`; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_GAP, documents, fresh, materialise, table

MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = r"[#*$%&|<>]"
#: Of the good documents of a stratum, at most this share is rejected, but with probability LEVEL.
RISK = 0.02
LEVEL = 0.05

#: Fixed values. Rule: what is counted, by which counts, and the side that is rejected; cutoffs from lenient to strict, in thousandths of the second count.
RULES: dict[str, tuple[str, str, str, list[int]]] = {
    "symbols": ("n_symbols", "n_words", ">", [1000, 700, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30]),
    "long_words": ("word_chars", "n_words", ">", [15_000, 13_000, 12_000, 11_000, 10_000, 9500, 9000, 8500, 8000, 7500, 7000, 6750, 6500]),
    "short_words": ("word_chars", "n_words", "<", [1500, 2000, 2500, 2750, 3000, 3250, 3500, 3750, 4000]),
    "repeated_words": ("n_repeat_words", "n_words", ">", [450, 400, 350, 300, 250, 200, 150, 100]),
    "repeated_lines": ("n_dup_lines", "n_words", ">", [100, 70, 50, 40, 30, 20, 15, 10]),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: a transform of one element gives it a name."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that the array has more than once. Windows are sorted with their places, equal ones are neighbours then."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")))["n"]

    return F.when(F.size(words) >= 3, _named(_named(F.sort_array(windows), places), covered)).otherwise(F.lit(0).cast("long"))


def counts() -> Column:
    """The base counts of `text` as a struct."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(words: Column) -> list[Column]:
        return [F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words")]

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    again = _named(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return _named(F.array_remove(F.split(text, WORD_GAP), ""), lambda w: F.struct(*of_words(w), symbols.alias("n_symbols"), again.alias("n_dup_lines")))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEATED * F.col(n_words))


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts and base_failed of each row, as a table: texts are read once."""
    counted = docs.select("doc_id", F.col(stratum).alias("stratum"), counts().alias("c")).select("doc_id", "stratum", *[F.col(f"c.{x}").alias(x) for x in COUNTS])
    return materialise(counted.withColumn("base_failed", base_failed()))


def _rejects(rule: str, cutoff: Column) -> Column:
    top, bottom, side, _ = RULES[rule]
    a, b = 1000 * F.col(top), cutoff * F.col(bottom)
    return a > b if side == ">" else a < b


def _log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series eight steps on, where it is exact to double precision."""
    z = x + 8
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact for k below n * p and 1 from there on, where no cutoff is certified. The last term by logarithms, the others by their ratios, as far as they count."""
    kd, nd = k.cast("double"), n.cast("double")
    last = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    terms = F.least(k, F.ceil(50 * F.sqrt(nd * p) + 200).cast("long"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def further(a: Column, j: Column) -> Column:
        term = a["term"] * (kd - j + 1) / (nd - kd + j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    ratio = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), zero, further)["sum"]
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(last) * ratio)


def certified(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, rule, step, cutoff, n, k, tail, certified: a row for each stratum with holdout documents and each cutoff. Counting combines within tasks, so a large stratum moves no rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    holdout = stats.where(~F.col("base_failed")).join(known.where("low = 1 and high = 1").select("doc_id"), "doc_id", "left_semi")
    steps = [(rule, s, cutoff) for rule, (*_, ladder) in RULES.items() for s, cutoff in enumerate(ladder)]
    rejected = [F.count_if(_rejects(rule, F.lit(cutoff))).alias(f"k{i}") for i, (rule, _, cutoff) in enumerate(steps)]
    strata = materialise(holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejected))
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(s).alias("step"), F.lit(cutoff).cast("long").alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, s, cutoff) in enumerate(steps)])
    tested = strata.select("stratum", "n", F.explode(rows).alias("r")).select("stratum", "r.rule", "r.step", "r.cutoff", "n", "r.k")
    tested = tested.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    each = level / (len(RULES) * max(1, strata.count()))
    return tested.withColumn("certified", F.max("tail").over(so_far) <= each)


def cutoffs(tested: DataFrame) -> DataFrame:
    """stratum and, by rule, the strictest certified cutoff (null: the rule isn't active). A written table, so that Spark knows its size when it plans the join."""
    return materialise(tested.where("certified").groupBy("stratum").agg(*[F.max_by("cutoff", F.when(F.col("rule") == rule, F.col("step"))).alias(f"cutoff_{rule}") for rule in RULES]))


def judged(stats: DataFrame, active: DataFrame) -> DataFrame:
    """The statistics, rejected_by (the first rule that rejects, null if none does) and kept."""
    found = stats.join(active.withColumnRenamed("stratum", "of_stratum"), F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    by = F.coalesce(*[F.when(_rejects(rule, F.col(f"cutoff_{rule}")), F.lit(rule)) for rule in RULES])
    return found.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(by)).withColumn("kept", F.col("rejected_by").isNull()).drop("of_stratum", *[f"cutoff_{rule}" for rule in RULES])


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of docs: doc_id, stratum, the base counts, base_failed, rejected_by, kept."""
    stats = statistics(docs, stratum)
    return judged(stats, cutoffs(certified(stats, labels, risk, level)))


def keep_clean(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of docs that stay, with all their columns. Texts are read twice, so that they move in no shuffle."""
    active = cutoffs(certified(statistics(docs, stratum), labels, risk, level))
    row = fresh(docs, "row")
    counted = docs.select(F.struct(*docs.columns).alias(row), F.col(stratum).alias("stratum"), counts().alias("c")).select(row, "stratum", *[F.col(f"c.{x}").alias(x) for x in COUNTS])
    return judged(counted.withColumn("base_failed", base_failed()), active).where("kept").select(f"{row}.*")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "rejected_by")


def _sql() -> str:
    ladder = ", ".join(f"('{rule}', {s}, {cutoff})" for rule, (*_, steps) in RULES.items() for s, cutoff in enumerate(steps))
    rejects = "CASE rule " + " ".join(f"WHEN '{rule}' THEN 1000 * {top} {side} cutoff * {bottom}" for rule, (top, bottom, side, _) in RULES.items()) + " END"
    order = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {i}" for i, rule in enumerate(RULES)) + " END"
    risk = RISK / len(RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
p AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
two AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS times FROM p) WHERE times > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM two) GROUP BY r),
li AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
s AS (SELECT w.r, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
  coalesce(li.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN li ON li.r = w.r LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM s),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
ladder(rule, step, cutoff) AS (VALUES {ladder}),
t AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER ({rejects}) AS k FROM (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)), ladder GROUP BY ALL),
m AS (SELECT count(DISTINCT coalesce('=' || lang, '')) * {len(RULES)} AS tests FROM t),
c AS (SELECT *, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS tail FROM t),
a AS (SELECT *, max(tail) OVER (PARTITION BY lang, rule ORDER BY step) <= {LEVEL} / tests AS certified FROM c, m),
best AS (SELECT lang, rule, arg_max(cutoff, step) AS cutoff FROM a WHERE certified GROUP BY lang, rule),
no AS (SELECT r, arg_min(rule, {order}) AS rule FROM b JOIN best ON b.lang IS NOT DISTINCT FROM best.lang WHERE NOT base_failed AND {rejects} GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND no.rule IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE no.rule END AS rejected_by
FROM b LEFT JOIN no ON no.r = b.r
"""


SQL = _sql()
