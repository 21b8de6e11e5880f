"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Column expressions and aggregates only.  What reaches the driver is one row per
vote pattern, 3 ** len(RULES) at most, whatever the number of documents.
Null text counts as empty.  Very long texts: one sort of their 3-word windows.
Repeated rows each get their row; equal vote patterns get equal quality, and a
quality of THRESHOLD itself is kept; other columns are left out, so their names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written
from .spans import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rule: (bad if, good if) over the base counts; otherwise it abstains; short or repetitive texts speak against a document, others not for it.  Conditions are SQL that Spark and DuckDB both read.
RULES = {
    "length": ("n_words < 50", "false"),
    "word_size": ("word_chars < 3 * n_words or word_chars > 7 * n_words", "2 * word_chars between 8 * n_words and 13 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "false"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "false"),
    "letters": ("10 * n_letters < 9 * word_chars", "100 * n_letters >= 94 * word_chars"),
}
#: Rounds of EM at most, and the change of a probability below which it has converged.
ROUNDS = 80
TOLERANCE = 1e-10
#: Where EM starts, and what SMOOTHING pseudo-votes hold: chances of the votes -1, 0 and 1 on a good and on a bad document.
START = ((0.1, 0.3, 0.6), (0.6, 0.3, 0.1))
SMOOTHING = 10.0
START_GOOD = 0.8
THRESHOLD = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash after one sort of (hash, place); the
    places of repeated windows then cover three words each, overlaps once.
    """
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hashes) - 1
        again = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))), lambda x: x["i"]))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n"), (i + 3).alias("end"))
        return let(ordered, lambda s: F.aggregate(again(s), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"])

    return F.when(n < 4, F.lit(0)).otherwise(let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the base counts of each whole text."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    out = df.select(F.col(id_col), text.alias("_t"))
    # word-wise and line-wise counts, each array bound once
    per_words = let(F.regexp_extract_all(F.col("_t"), F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    n_symbols = F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))
    n_letters = F.length(F.regexp_replace("_t", r"[\x00-@\[-`{-\x7F]+", ""))
    out = out.select(id_col, per_words.alias("_w"), per_lines.alias("_l"), n_symbols.alias("n_symbols"), n_letters.alias("n_letters"))
    return out.select(id_col, *(F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in ("_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_letters")))


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}") for name, (bad, good) in RULES.items()]


class Model(NamedTuple):
    """Share of good documents, and for each rule the chances of the votes -1, 0 and 1 on a good and on a bad document.

    A rule that only ever speaks against documents is told by how often it does
    so in either class; that it keeps silent then counts a little in favour.
    """

    good: float
    chances: list[tuple[tuple[float, ...], tuple[float, ...]]]

    def weight(self, rule: int, vote: int) -> float:
        good, bad = self.chances[rule]
        return math.log(good[vote + 1] / bad[vote + 1])

    def odds(self) -> float:
        return math.log(self.good / (1 - self.good))


def posterior(pattern: tuple[int, ...], model: Model) -> float:
    odds = model.odds() + sum(model.weight(j, v) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """By expectation-maximisation over pattern counts, to convergence."""
    model = Model(START_GOOD, [START] * len(RULES))
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        p = [(v, n * q, n * (1 - q)) for v, n in patterns for q in [posterior(v, model)]]
        sums = [sum(x[k] for x in p) for k in (1, 2)]
        votes_of = lambda j, k, v: sum(x[k] for x in p if x[0][j] == v)
        chances = [tuple(tuple((votes_of(j, k + 1, v) + SMOOTHING * START[k][v + 1]) / (sums[k] + SMOOTHING) for v in (-1, 0, 1)) for k in (0, 1)) for j in range(len(RULES))]
        found = Model((sums[0] + SMOOTHING * START_GOOD) / (total + SMOOTHING), chances)
        change = max(abs(a - b) for x, y in zip([*found.chances, ((found.good,), ())], [*model.chances, ((model.good,), ())], strict=True) for c, d in zip(x, y, strict=True) for a, b in zip(c, d, strict=True))
        model = found
        if change < TOLERANCE:
            break
    return model


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, base counts, votes, quality (posterior probability of a good document), base_failed, kept."""
    rows = written(counts(df, id_col, text_col), "quality").select(id_col, *COUNTS, *votes())
    cast = [f"v_{name}" for name in RULES]
    patterns = [(tuple(r[c] for c in cast), r["n"]) for r in rows.groupBy(*cast).agg(F.count("*").alias("n")).orderBy(*cast).collect()]
    model = fit(patterns)
    odds = F.lit(model.odds())
    for j, c in enumerate(cast):
        odds = odds + F.element_at(F.array(*(F.lit(model.weight(j, v)) for v in (-1, 0, 1))), F.col(c) + 2)
    base_failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("quality") >= THRESHOLD))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _sql() -> str:
    names = list(RULES)
    cast = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v_{n}" for n, (bad, good) in RULES.items())
    vs = ", ".join(f"v_{n}" for n in names)
    cols = [(n, k, v) for n in names for k in (0, 1) for v in (-1, 0, 1)]
    at = lambda n, k, v: f"p_{n}_{k}_{v + 1}"
    steps = [f"m0 as (select {START_GOOD}::double as g, " + ", ".join(f"{START[k][v + 1]}::double as {at(n, k, v)}" for n, k, v in cols) + ")"]
    weight = lambda n: f"case v_{n} " + " ".join(f"when {v} then ln({at(n, 0, v)} / {at(n, 1, v)})" for v in (-1, 0, 1)) + " end"
    post = "1 / (1 + exp(-(ln(g / (1 - g)) + " + " + ".join(weight(n) for n in names) + ")))"
    for k in range(ROUNDS):
        share = lambda n, c, v: f"(coalesce(sum(case when v_{n} = {v} then c * {('q', '(1 - q)')[c]} else 0 end), 0) + {SMOOTHING * START[c][v + 1]}::double) / (sum(c * {('q', '(1 - q)')[c]}) + {SMOOTHING}::double) as {at(n, c, v)}"
        steps.append(f"m{k + 1} as materialized (select (sum(c * q) + {SMOOTHING * START_GOOD}::double) / (sum(c) + {SMOOTHING}::double) as g, " + ", ".join(share(*x) for x in cols) + f" from (select {vs}, c, {post} as q from p, m{k}))")
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        w as materialized (select r, doc_id, t, regexp_extract_all(t, '{WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from d),
        u as (select r, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from w),
        k as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as k from u where len(w) >= 3),
        k2 as (select r, i from (select r, i, count(*) over (partition by r, k) as n from k) where n > 1),
        k3 as (select r, sum(least(3, coalesce(nxt - i, 3)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from k2) group by r),
        f as materialized (select w.r as r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
            (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
            length(regexp_replace(t, '[\\x00-@\\[-`{{-\\x7F]+', '', 'g'))::bigint as n_letters from w left join k3 on k3.r = w.r),
        v as (select *, {cast}, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from f),
        p as materialized (select {vs}, count(*) as c from v group by {vs}),
        {", ".join(steps)}
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {post} >= {THRESHOLD} as kept, round({post}, 6) as quality from v, m{ROUNDS}"""


QUERIES = {"op4_quality": op4_quality}
SQL = {"op4_quality": _sql()}
