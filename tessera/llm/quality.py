"""Weak supervision of text quality: rules vote or abstain, EM weighs them.

Every rule votes good (1), bad (-1) or abstains (0) on counts of the whole text. Each has
two unknown accuracies, that of its votes on good and that of its votes on bad texts; an
abstention says nothing. Expectation-maximisation over the histogram of vote patterns
(at most 3 ** rules rows) estimates them and the share of good texts, until no pattern's
posterior moves; weak pseudo-counts only keep the rates off 0 and 1 and tell the two classes
apart. The posterior probability of a good text decides, so a bad vote that the
other rules' votes contradict can be overruled. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on are be by this at from or an not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur pas avec "
    "el los las y del se con por al lo como más su una"
).split()
FUNCTION_WORDS = tuple(dict.fromkeys(FUNCTION_WORDS))

#: Rule name: (SQL condition of a bad vote, SQL condition of a good vote) over the counts, in integers.
RULES = {
    "symbols": ("20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "repeats": ("100 * n_repeat_words > 15 * n_words", "n_repeat_words = 0"),
    "duplicate_lines": ("100 * n_dup_lines > 25 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "stutter": ("100 * n_stutter > 10 * n_words", "100 * n_stutter <= n_words"),
    "capitals": ("100 * n_upper > 40 * word_chars", "100 * n_upper <= 10 * word_chars"),
    "exclamations": ("5 * n_bangs > n_words", "50 * n_bangs <= n_words"),
    "word_length": ("word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "function_words": ("100 * n_function < 3 * n_words", "100 * n_function >= 8 * n_words"),
}
RIGHT, WRONG = 4, 1  # pseudo-counts of right and wrong votes of each rule on each class
FIRST = 0.9  # first posterior of a pattern without a bad vote; 1 less this with one
SETTLED = 1e-9  # EM ends when no posterior moves by more
ROUNDS_IN_JOB = 500


def _let(value: Column, body) -> Column:
    """Bind a value once for use inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(
        hashes,
        lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ranked, lambda r: F.filter(r, lambda x, k: (F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of every whole text that rules read; null text has no words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    counted = docs.select(F.col("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    long = lambda c, name: c.cast("long").alias(name)
    return counted.select(
        "doc_id",
        long(F.size("words"), "n_words"),
        long(F.length(F.translate("text", " \t\n\x0b\f\r", "")), "word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(_repeat_words(F.col("words")), "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))), "n_stutter"),
        long(F.regexp_count("text", F.lit("\\p{Lu}")), "n_upper"),
        long(F.length("text") - F.length(F.translate("text", "!", "")), "n_bangs"),
        long(F.size(F.filter("words", lambda w: w.isin(*FUNCTION_WORDS))), "n_function"),
    )


def _vote_sql(rule: str) -> str:
    bad, good = RULES[rule]
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{rule}"


def _log_odds(votes: list[Column], state: Column) -> Column:
    """Log-odds of a good text given its votes; an abstention adds nothing."""
    out = F.log(state["prior"] / (1 - state["prior"]))
    for i, vote in enumerate(votes):
        out = out + F.when(vote == 1, state["up"][i]).when(vote == -1, state["down"][i]).otherwise(0.0)
    return out


def _maximise(patterns: Column, rules: int) -> Column:
    """Share of good texts and what each rule's votes add to the log-odds, from patterns (v, n) with posteriors (w)."""
    names = ["good_all", "good_right", "bad_all", "bad_right"]
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("w"), *[F.array_repeat(F.lit(0.0), rules).alias(x) for x in names])

    def add(acc: Column, x: Column) -> Column:
        good, bad = x["n"] * x["w"], x["n"] * (1 - x["w"])
        count = lambda name, mass, counts: F.zip_with(acc[name], x["v"], lambda a, v: a + F.when(counts(v), mass).otherwise(0.0)).alias(name)
        terms = [(good, lambda v: v != 0), (good, lambda v: v == 1), (bad, lambda v: v != 0), (bad, lambda v: v == -1)]
        sums = [count(name, mass, counts) for name, (mass, counts) in zip(names, terms)]
        return F.struct((acc["n"] + x["n"]).alias("n"), (acc["w"] + good).alias("w"), *sums)

    def rates(acc: Column) -> Column:
        held = lambda right, every: F.zip_with(acc[right], acc[every], lambda r, a: (r + RIGHT) / (a + RIGHT + WRONG))
        on_good, on_bad = held("good_right", "good_all"), held("bad_right", "bad_all")
        return F.struct(
            ((acc["w"] + 1) / (acc["n"] + 2)).alias("prior"),
            F.zip_with(on_good, on_bad, lambda g, b: F.log(g / (1 - b))).alias("up"),
            F.zip_with(on_good, on_bad, lambda g, b: F.log((1 - g) / b)).alias("down"),
        )

    return F.aggregate(patterns, zero, add, rates)


def estimate_rates(patterns: DataFrame, rules: list[str]) -> dict:
    """EM over the pattern histogram (v_<rule> columns and n): (prior, up, down, rounds) once it has settled.

    ``up`` and ``down`` are what a good and a bad vote of each rule add to the log-odds.
    All rounds run as higher-order functions over one row that holds the histogram.
    """
    held = F.struct(F.array(*[F.col(f"v_{r}").cast("int") for r in rules]).alias("v"), F.col("n").cast("double").alias("n"))
    first = lambda x: F.when(F.exists(x["v"], lambda v: v == -1), 1 - FIRST).otherwise(FIRST)
    start = F.struct(F.lit(0).alias("rounds"), F.lit(1.0).alias("moved"), F.transform("patterns", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), first(x).alias("w"))).alias("x"))

    def step(s: Column) -> Column:
        def expect(rates: Column) -> Column:
            posterior = lambda x: 1 / (1 + F.exp(-_log_odds([x["v"][i] for i in range(len(rules))], rates)))
            new = F.transform(s["x"], lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x).alias("w")))
            return _let(new, lambda y: F.struct((s["rounds"] + 1).alias("rounds"), F.array_max(F.zip_with(s["x"], y, lambda a, b: F.abs(a["w"] - b["w"]))).alias("moved"), y.alias("x")))

        return _let(_maximise(s["x"], len(rules)), expect)

    state = patterns.agg(F.array_sort(F.collect_list(held)).alias("patterns")).select(start.alias("s"))  # at most 3 ** rules patterns
    kind = state.schema["s"].dataType
    while True:
        settled = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS_IN_JOB)), F.col("s"), lambda s, _: F.when(s["moved"] < SETTLED, s).otherwise(step(s)))
        row = state.select(settled.cast(kind).alias("s")).first()["s"]
        if row["moved"] < SETTLED:
            break
        state = patterns.sparkSession.createDataFrame([(row,)], state.schema)
    final = patterns.sparkSession.createDataFrame([(row,)], state.schema).select(_maximise(F.col("s.x"), len(rules)).alias("r")).first()["r"]
    return {"prior": final["prior"], "up": list(final["up"]), "down": list(final["down"]), "rounds": row["rounds"]}


def judge_quality(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, votes' posterior and whether to keep, for each row of ``docs``.

    Null and empty texts have no words and fail the base; repeated rows are judged each;
    an empty input gives no row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.table(text_counts(docs), "counts")
    voted = counts.selectExpr("*", *[_vote_sql(r) for r in RULES])
    votes = [f"v_{r}" for r in RULES]
    passed = voted.where(~_base_failed())
    patterns = scratch.table(passed.groupBy(*votes).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    posterior = F.lit(0.5)
    if patterns.head(1):
        rates = estimate_rates(patterns, list(RULES))
        state = {"prior": F.lit(rates["prior"]), "up": [F.lit(x) for x in rates["up"]], "down": [F.lit(x) for x in rates["down"]]}
        posterior = 1 / (1 + F.exp(-_log_odds([F.col(v) for v in votes], state)))
    held = voted
    out = held.withColumn("posterior", posterior).withColumn("base_failed", _base_failed())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= THRESHOLD)).alias("kept"), F.round("posterior", 4).alias("posterior")
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the quality of ``documents``."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
twice AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (r, g)) GROUP BY r),
counts AS MATERIALIZED (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, len(list_filter(words, lambda x: x IN (@WORDS@))) AS n_function FROM d LEFT JOIN repeats USING (r)),
base AS MATERIALIZED (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM counts),
votes AS MATERIALIZED (
SELECT r, 'symbols' AS rule, CASE WHEN n_symbols * 20 > n_words THEN -1 WHEN n_symbols * 100 <= n_words THEN 1 ELSE 0 END AS v FROM base
UNION ALL SELECT r, 'repeats', CASE WHEN n_repeat_words * 100 > n_words * 15 THEN -1 WHEN n_repeat_words = 0 THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'lines', CASE WHEN n_dup_lines * 100 > n_lines * 25 THEN -1 WHEN n_lines >= 2 AND n_dup_lines = 0 THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'stutter', CASE WHEN n_stutter * 100 > n_words * 10 THEN -1 WHEN n_stutter * 100 <= n_words THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'capitals', CASE WHEN n_upper * 100 > word_chars * 40 THEN -1 WHEN n_upper * 100 <= word_chars * 10 THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'bangs', CASE WHEN n_bangs * 5 > n_words THEN -1 WHEN n_bangs * 50 <= n_words THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'length', CASE WHEN word_chars > n_words * 15 OR word_chars < n_words * 2 THEN -1 WHEN word_chars >= n_words * 3 AND word_chars <= n_words * 10 THEN 1 ELSE 0 END FROM base
UNION ALL SELECT r, 'function', CASE WHEN n_function * 100 < n_words * 3 THEN -1 WHEN n_function * 100 >= n_words * 8 THEN 1 ELSE 0 END FROM base),
ballots AS MATERIALIZED (SELECT r, string_agg(CAST(v AS VARCHAR), ',' ORDER BY rule) AS p FROM votes GROUP BY r),
tally AS MATERIALIZED (SELECT p, CAST(count(*) FILTER (WHERE NOT base_failed) AS DOUBLE) AS n, min(r) AS r FROM ballots JOIN base USING (r) GROUP BY p),
cast_votes AS MATERIALIZED (SELECT p, n, rule, v FROM tally JOIN votes USING (r) WHERE v <> 0),
em(i, p, w, moved) AS (
SELECT 0, p, CASE WHEN coalesce(min(v), 1) = -1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END, CAST(1 AS DOUBLE) FROM tally LEFT JOIN cast_votes USING (p) GROUP BY p
UNION ALL
SELECT i, p, w_new, max(CASE WHEN n > 0 THEN abs(w_new - w) ELSE 0 END) OVER () FROM (
SELECT any_value(e.i) + 1 AS i, p, any_value(t.n) AS n, any_value(e.w) AS w, 1 / (1 + exp(-any_value(ln(prior / (1 - prior))) - coalesce(sum(CASE WHEN c.v = 1 THEN ln(g / (1 - b)) WHEN c.v = -1 THEN ln((1 - g) / b) END), 0))) AS w_new
FROM em e JOIN tally t USING (p) CROSS JOIN (SELECT (1 + sum(n * w)) / (2 + sum(n)) AS prior FROM em JOIN tally USING (p))
LEFT JOIN cast_votes c USING (p)
LEFT JOIN (SELECT rule, (4 + sum(CASE WHEN v = 1 THEN n * w ELSE 0 END)) / (5 + sum(n * w)) AS g, (4 + sum(CASE WHEN v = -1 THEN n * (1 - w) ELSE 0 END)) / (5 + sum(n * (1 - w))) AS b FROM em JOIN cast_votes USING (p) GROUP BY rule) m ON m.rule = c.rule
WHERE e.moved >= 1e-9 GROUP BY p)),
last AS (SELECT p, w FROM em WHERE i = (SELECT max(i) FROM em))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND w >= 0.5) AS kept, round(w, 4) AS posterior FROM base JOIN ballots USING (r) JOIN last USING (p)
""".replace("@WORDS@", ", ".join(f"'{w}'" for w in FUNCTION_WORDS))
