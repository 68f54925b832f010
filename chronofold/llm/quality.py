"""Quality rules whose cutoffs are certified on labelled documents.

Each rule measures one thing about a document and has a fixed ladder of cutoffs.
Together the ladders make one path, the same for all data: it starts with no
cutoff at all and takes up, one at a time, the most lenient cutoff of each rule,
then the next of each, and so on to the strictest.  A stratum walks the path as
long as the labelled good documents of it prove, by an exact binomial test, that
all cutoffs so far together reject no more than the allowed rate of good ones.
Tests along the path come in a fixed order and end with the first that fails, so
they share one error; the error is divided among the strata (Bonferroni).  So
with probability 1 - ``error`` no stratum that is tested loses more than ``rate``
of its good documents.  Strata with few labels are tested as one pool, and only
the pool is certified then, not each of them.  Where nothing is proved nothing is
rejected.

Only DataFrame and SQL expressions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import stage_table

#: Strata below one part in so many of the labelled good documents are tested as one, so there are few strata.
STRATA = 200
POOLED = "(others)"


@dataclass(frozen=True)
class Rule:
    """A measure (SQL over the statistics), the side that is bad, and its ladder, strict first."""

    name: str
    measure: str
    high: bool
    ladder: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / word_chars", True, (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)),
    Rule("dup_lines", "n_dup_lines * 10 / n_words", True, (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    Rule("repeats", "n_repeat_words / n_words", True, (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18)),
    Rule("long_words", "word_chars / n_words", True, (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0)),
    Rule("short_words", "word_chars / n_words", False, (3.5, 3.2, 3.0, 2.7, 2.4, 2.0, 1.6, 1.2)),
)


@dataclass(frozen=True)
class Risk:
    #: Share of a stratum's good documents that the rules together may reject.
    rate: float = 0.05
    #: Probability that the promise is broken in any stratum that is tested.
    error: float = 0.05


_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs) of whole texts.

    Columns of those names are replaced.  A null text has no words.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c.lower() not in made]
    text = F.coalesce(F.col(text_column), F.lit(""))
    bare = text
    for c in _SPACE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    plain = text
    for c in _SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    many = F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0)
    d = docs.select(
        *kept,
        words.alias("_w"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(plain)).cast("long").alias("n_symbols"),
        many.cast("long").alias("n_dup_lines"),
    )
    # hashes of all windows of five words
    window = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2), F.get("_w", i + 3), F.get("_w", i + 4)),
    )
    d = d.select(*kept, "word_chars", "n_symbols", "n_dup_lines", F.size("_w").cast("long").alias("n_words"), window.alias("_h"))
    # only documents with a repeated window need its places
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = F.when(repeated, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.select(*kept, "word_chars", "n_symbols", "n_dup_lines", "n_words", ranked.alias("_s"))
    same = lambda e, j: F.coalesce(F.get("_s", j).getField("h") == e.getField("h"), F.lit(False))
    places = F.filter("_s", lambda e, j: F.when(j > 0, same(e, j - 1)).otherwise(F.lit(False)) | same(e, j + 1))
    d = d.select(*kept, "word_chars", "n_symbols", "n_dup_lines", "n_words", F.array_sort(F.transform(places, lambda e: e.getField("i"))).alias("_p"))
    steps = F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_p", j + 1) - p, F.lit(5))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return d.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series eight steps up, to about 1e-12."""
    y = x + F.lit(8.0)
    series = (y + 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for k in range(1, 9):
        series = series - F.ln(x + F.lit(float(k)))
    return series


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial with n trials at ``rate``; exact to rounding where k < n * rate, else 1.

    Terms fall off from the k-th one down; so many are summed that those left
    out are below the smallest double relative to it, or all.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    terms = F.least(k, F.ceil(F.sqrt(n * rate) * 64) + 64).cast("int")
    odds = (1 - rate) / rate
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t"), k.alias("j"), n.alias("n")),
        lambda a, _: F.struct(
            (a["s"] + a["t"]).alias("s"),
            (a["t"] * a["j"] / (a["n"] - a["j"] + 1) * odds).alias("t"),
            (a["j"] - 1).alias("j"),
            a["n"].alias("n"),
        ),
        lambda a: a["s"],
    )
    return F.when(n <= 0, F.lit(1.0)).when(k < n * rate, F.exp(top) * total).otherwise(F.lit(1.0))


def _step(rule: Rule) -> Column:
    """How many of the rule's cutoffs a document is beyond."""
    value = F.expr(f"try_divide({rule.measure.split(' / ')[0]}, {rule.measure.split(' / ')[1]})").cast("double")
    beyond = [F.coalesce(value > c if rule.high else value < c, F.lit(False)).cast("int") for c in rule.ladder]
    out = beyond[0]
    for b in beyond[1:]:
        out = out + b
    return out


def first_step(rules: tuple[Rule, ...] = RULES) -> Column:
    """The first step of the path whose cutoffs a document is beyond; null if it is beyond none.

    Step t takes up cutoff (L - 1 - t // R) of rule t % R, where R rules have L
    cutoffs each, strict first.
    """
    return F.least(*_rule_steps(rules)) if len(rules) > 1 else _rule_steps(rules)[0]


def _rule_steps(rules: tuple[Rule, ...]) -> list[Column]:
    # ladders are strict first: a document beyond s of them is beyond the s strictest, of which the last is the most lenient
    length = len(rules[0].ladder)
    if any(len(r.ladder) != length for r in rules):
        raise ValueError("all ladders have the same length")
    return [F.when(_step(r) > 0, (length - _step(r)) * len(rules) + i) for i, r in enumerate(rules)]


def certify(labelled: DataFrame, risk: Risk = Risk(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """How far each tested stratum may go: the last step that is proved (null: none), and the test's n, k and p.

    ``labelled`` has a stratum (null is a stratum of its own), the statistics
    and ``good`` (boolean; rows where it is not true play no part).
    """
    good = labelled.where("good").withColumn("stratum", F.coalesce("stratum", F.lit("(null)")))
    counts = good.groupBy("stratum").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    large = [r[0] for r in counts.where(F.col("count") * STRATA >= total).select("stratum").collect()]  # at most STRATA
    good = good.withColumn("stratum", F.when(F.col("stratum").isin(large), F.col("stratum")).otherwise(F.lit(POOLED)))
    counted = good.groupBy("stratum", first_step(rules).alias("step")).count()
    sizes = counted.groupBy("stratum").agg(F.sum("count").alias("n"))
    path = sizes.select("stratum", "n", F.explode(F.sequence(F.lit(0), F.lit(len(rules) * len(rules[0].ladder) - 1))).alias("at"))
    hit = counted.where("step IS NOT NULL").withColumnRenamed("stratum", "_s")
    beyond = path.join(hit, (F.col("stratum") == F.col("_s")) & (F.col("step") <= F.col("at")), "left").groupBy("stratum", "n", "at").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("k"))
    strata = sizes.agg(F.count("*").alias("strata"))
    tested = beyond.join(F.broadcast(strata)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk.rate))
    # more documents are rejected at each step, so the tests that pass are the first ones
    passed = tested.where(F.col("p") <= risk.error / F.col("strata"))
    best = passed.groupBy("stratum").agg(F.max_by(F.struct(F.col("at").alias("step"), "k", "p"), "at").alias("_b"))
    return sizes.join(best, "stratum", "left").select("stratum", "n", "_b.*")


def apply_rules(stats: DataFrame, proved: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed, failed_rules and kept to rows with a stratum and the statistics.

    ``proved`` has a row for each tested stratum, and there are at most
    STRATA + 1 of them, so it goes to all tasks whole.  A stratum that is not
    tested by itself goes by the pool, if there is one.
    """
    known = F.broadcast(proved.select(F.col("stratum").alias("_stratum"), F.col("step").alias("_own"), F.lit(True).alias("_tested")))
    pooled = proved.where(F.col("stratum") == POOLED).select(F.col("step").alias("_pooled"))
    one = F.broadcast(proved.sparkSession.range(1).join(F.broadcast(pooled), F.lit(True), "left").select("_pooled"))
    rows = stats.join(known, F.coalesce(F.col("stratum"), F.lit("(null)")) == F.col("_stratum"), "left").join(one, F.lit(True), "left")
    upto = F.when(F.col("_tested"), F.col("_own")).otherwise(F.col("_pooled"))
    fails = [F.when(step <= upto, F.lit(r.name)) for r, step in zip(rules, _rule_steps(rules), strict=True)]
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*fails)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return rows.withColumn("kept", kept).drop("_own", "_tested", "_stratum", "_pooled")


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), *, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """Statistics and verdict of each document.

    ``labels`` has the id and quality (1: good); of an id's repeated labels the
    lowest counts, null labels and ids do not.  Documents whose id repeats are
    judged each for itself.  Empty tables give no rows; without labels only the
    base test rejects.
    """
    stats = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(stratum_column).cast("string").alias("stratum"), F.col(text_column).alias("_text"))
    stats = stage_table(statistics(stats, text_column="_text").drop("_text"), "quality")
    marks = labels.where(f"`{id_column}` IS NOT NULL AND quality IS NOT NULL").groupBy(F.col(id_column).cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    proved = stage_table(certify(stats.join(marks, "doc_id"), risk), "proved")
    return apply_rules(stats, proved)
