"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one kind of count of a document and votes reject (-1), keep (1) or
abstains (0); no rule repeats or combines others. How often each vote is right isn't
given: expectation-maximisation estimates, from all documents, how each rule votes on
good and on bad ones, and a document is kept if the posterior probability that it is
good reaches one half. So a rule that rejects many documents that all others speak for
loses its weight, unlike in a filter that every document must pass whole; ``departures``
counts where the two differ. Documents meet the estimation as counts of vote patterns,
of which there are at most 3 ** len(RULES) however many documents.

Defined cases: a null text has no words; documents without words abstain on all
ratios; repeated rows each count; texts of any length are judged whole; with no
documents the starting values stay; extra columns of any name are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved, table

#: name: (reject if, keep if), over the columns of ``counts``; None: never.
RULES: dict[str, tuple[str, str | None]] = {
    "length": ("n_words < 10", None),
    "symbols": ("10 * n_symbols > n_words and n_words > 0", "n_words > 0 and 100 * n_symbols <= n_words"),
    "letters": ("100 * n_letters < 88 * word_chars", "n_words > 0 and 100 * n_letters >= 92 * word_chars"),
    "lines": ("2 * n_dup_lines > n_lines", "n_lines > 0 and n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 15 * n_words", "n_words > 0 and n_repeat_words = 0"),
    "stutter": ("100 * n_stutter > 20 * n_words", "n_words > 0 and 100 * n_stutter <= 2 * n_words"),
    "word_length": ("n_words > 0 and (2 * word_chars < 5 * n_words or word_chars > 12 * n_words)", "n_words > 0 and word_chars between 4 * n_words and 6 * n_words"),
    "case": ("10 * n_upper > 3 * word_chars", "n_words > 0 and 100 * n_upper <= 5 * word_chars"),
    "digits": ("100 * n_digits > 15 * word_chars", "n_words > 0 and 100 * n_digits <= 3 * word_chars"),
    "stops": ("n_words >= 50 and 200 * n_stops < n_words", "n_words > 0 and 25 * n_stops >= n_words"),
}
ROUNDS = 30
#: Starting shares of (reject, abstain, keep) votes, on bad and on good documents; also the
#: mean of the prior that keeps shares off 0 and 1.
START = {"bad": (0.25, 0.25, 0.50), "good": (0.005, 0.195, 0.80)}
START_GOOD = 0.8
PRIOR_WEIGHT = 50.0


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    white = " \t\n\x0b\x0c\r"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("core", F.trim("t", F.lit(white)))
    rows = rows.select(
        "doc_id",
        F.length(F.translate("t", white, "")).cast("bigint").alias("word_chars"),
        _number("t", "#*$%&|<>").alias("n_symbols"),
        _number("t", "0123456789").alias("n_digits"),
        _number("t", ".!?").alias("n_stops"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{L}+", ""))).cast("bigint").alias("n_letters"),
        F.expr(r"filter(split(t, '\n'), x -> trim(both ' \t\u000B\u000C\r' from x) <> '')").alias("lines"),
        F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", r"[ \t-\r]+")).alias("words"))
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    item = lambda i, k: F.get("h", i + k)
    rows = rows.withColumn("windows", F.when(F.size("h") >= 5, F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[item(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_digits", "n_stops", "n_upper", "n_letters", F.size("words").cast("bigint").alias("n_words"),
        F.size(F.filter("h", lambda w, i: w == F.get("h", i - 1))).cast("bigint").alias("n_stutter"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        # the windows only go on where some window stands twice
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"))
    # windows found twice, by sorting (window, place): equal neighbours; then the places again in order
    rows = rows.withColumn("sorted", F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.withColumn("twice", F.expr("filter(sorted, (s, k) -> s.w = get(sorted, k - 1).w or s.w = get(sorted, k + 1).w)"))
    rows = rows.withColumn("places", F.expr("sort_array(transform(twice, s -> s.i))"))
    # each place covers five words, less what the next one covers again
    covered = F.expr("aggregate(transform(places, (p, k) -> least(5, coalesce(get(places, k + 1), p + 5) - p)), 0L, (s, x) -> s + x)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("windows", "sorted", "twice", "places")


def _number(column: str, characters: str):
    return (F.length(column) - F.length(F.translate(column, characters, ""))).cast("bigint")


def votes(counted: DataFrame) -> DataFrame:
    def vote(reject: str, keep: str | None):
        v = F.when(F.expr(reject), -1)
        return (v.when(F.expr(keep), 1) if keep else v).otherwise(0).cast("int")
    return counted.select("*", *[vote(*r).alias(f"vote_{name}") for name, r in RULES.items()])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, dict[str, list[list[float]]]]:
    """Share of good documents and each rule's vote shares on bad and good ones, from
    (votes, number of documents) of each pattern."""
    good = START_GOOD
    shares = {c: [list(START[c]) for _ in RULES] for c in START}
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass = {c: [[PRIOR_WEIGHT * x for x in START[c]] for _ in RULES] for c in START}
        n_good = 0.0
        for pattern, n in patterns:
            p = posterior(pattern, good, shares)
            n_good += n * p
            for r, v in enumerate(pattern):
                mass["good"][r][v + 1] += n * p
                mass["bad"][r][v + 1] += n * (1 - p)
        good = min(0.99, max(0.01, (n_good + PRIOR_WEIGHT * START_GOOD) / (total + PRIOR_WEIGHT)))
        shares = {c: [[x / sum(row) for x in row] for row in m] for c, m in mass.items()}
    return good, shares


def posterior(pattern, good: float, shares) -> float:
    odds = math.log(good / (1 - good))
    for r, v in enumerate(pattern):
        odds += math.log(shares["good"][r][v + 1] / shares["bad"][r][v + 1])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the votes and p_good."""
    voted = saved(votes(counts(docs)), "votes")
    names = [f"vote_{name}" for name in RULES]
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect())
    good, shares = estimate(patterns)
    odds = F.lit(math.log(good / (1 - good)))
    for r, name in enumerate(names):
        weight = [math.log(shares["good"][r][v] / shares["bad"][r][v]) for v in range(3)]
        odds = odds + F.when(F.col(name) == -1, weight[0]).when(F.col(name) == 1, weight[2]).otherwise(weight[1])
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))


def departures(judged: DataFrame) -> DataFrame:
    """Documents by the method's verdict and that of a filter in which every rule must pass: kept, all_pass, n."""
    rejects = F.lit(False)
    for name in RULES:
        rejects = rejects | (F.col(f"vote_{name}") == -1)
    return judged.groupBy((F.col("p_good") >= 0.5).alias("kept"), (~rejects).alias("all_pass")).agg(F.count("*").alias("n"))


def op9(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), F.round("p_good", 4).alias("p_good"))
