"""Mixing sources to target weights: raking, then sampling.

Documents fall into cells of source, language and topic; a value that no target
names counts as ``other``, so the number of cells is bounded by the targets.
Iterative proportional fitting scales the cells' token weights until their
marginals are the targets.  A cell's sampling probability is its scale factor
over the largest one, so that no probability is cut off at 1 and the expected
tokens have the raked marginals; the share of all tokens that is kept follows
from the targets.  A document is kept if a hash of its id, as a number from 0 to
1, is below its cell's probability.  ``marginals`` tells targets, shares reached
and what is left between them.

The topic of a text is what it holds: rows of a table, licence notices, contact
data, credentials or code, else prose.

Null source or language: ``other``.  Null text: no tokens, prose.  Very long
texts are matched in time in proportion to them.  Rows with a null id are drawn
by their text, so unlike ones fare each on its own.  Repeated rows fare alike;
extra columns travel as one struct, so their names cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written
from .spans import let

OTHER = "other"
SOURCE_TARGET = {f"src{i}": 0.0495 for i in range(20)} | {OTHER: 0.01}
LANG_TARGET = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.09, OTHER: 0.01}
TOPIC_TARGET = {"prose": 0.9, "table": 0.03, "notice": 0.03, "contact": 0.03, "code": 0.01}
TARGETS = {"source": SOURCE_TARGET, "lang": LANG_TARGET, "topic": TOPIC_TARGET}
ROUNDS = 40
#: Topic: strings of which the lower-cased text holds one, and a pattern that it then has, if any; the first topic that matches.
#: Regular expressions that Java and RE2 read alike.
TOPICS = {
    "table": ([" | "], None),
    "notice": (["license", "licence", "copyright", "rights reserved", "warranty", "warranties"], None),
    "contact": (["@", "+"], r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{8}"),
    "code": (["password", "passwd", "secret", "token", "api_key", "apikey", "akia"], r"(?i)(?:password|passwd|secret|token|api_?key)[\x20\"']*[:=]|AKIA[A-Z0-9]{16}"),
}
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    def found(low: Column) -> Column:
        out = F
        for name, (strings, pattern) in TOPICS.items():
            held = reduce(or_, (F.contains(low, F.lit(x)) for x in strings))
            out = out.when(held & F.rlike(text, F.lit(pattern)) if pattern else held, name)
        return out.otherwise("prose")

    return let(F.lower(text), found)


def cell(column: Column, target: dict[str, float]) -> Column:
    value = column.cast("string")
    return F.when(value.isin(*(k for k in target if k != OTHER)), value).otherwise(OTHER)


def draw(id_col: Column, text: Column) -> Column:
    """0 to 1, by the first 32 bits of the MD5 of the id, or of the text where there is none."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), text, F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: dict[tuple, int], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Scale factor of each cell.  Targets of values that have no tokens are shared out among the others."""
    weights = {c: float(n) for c, n in cells.items()}
    total = sum(weights.values())
    for _ in range(rounds):
        for d, target in enumerate(targets):
            sums: dict[str, float] = {}
            for c, w in weights.items():
                sums[c[d]] = sums.get(c[d], 0.0) + w
            present = sum(target.get(v, 0.0) for v, s in sums.items() if s > 0)
            scale = {v: target.get(v, 0.0) / present * total / s if s > 0 and present > 0 else 1.0 for v, s in sums.items()}
            weights = {c: w * scale[c[d]] for c, w in weights.items()}
    return {c: weights[c] / n if n else 0.0 for c, n in cells.items()}


def calibrate(cells: dict[tuple, int], factors: dict[tuple, float]) -> dict[tuple, float]:
    """Probabilities in proportion to the factors, the largest of them 1; of cells without tokens, 1."""
    most = max((factors[c] for c in cells if cells[c]), default=0.0)
    return {c: factors[c] / most if n and most > 0 else 1.0 for c, n in cells.items()}


def cell_tokens(rows: DataFrame, dims: list[str]) -> dict[tuple, int]:
    """Tokens of each cell; as many cells as the targets allow."""
    return {tuple(r[d] for d in dims): r["n"] for r in rows.groupBy(*dims).agg(F.sum("n_tokens").alias("n")).orderBy(*dims).collect()}


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    """prob of each cell of ``rows`` (columns of the targets' names, n_tokens)."""
    cells = cell_tokens(rows, list(targets))
    found = calibrate(cells, rake(cells, list(targets.values())))
    return rows.sparkSession.createDataFrame([(*c, p) for c, p in found.items()], ", ".join(f"`{d}` string" for d in targets) + ", prob double")


def celled(df: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> Column:
    """struct<n_tokens, source, lang, topic> of a row."""
    text = text_or_empty(text_col)
    return F.struct(n_tokens(text).alias("n_tokens"), cell(F.col(source_col), SOURCE_TARGET).alias("source"), cell(F.col(lang_col), LANG_TARGET).alias("lang"), topic(text).alias("topic"))


def weigh(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id_col``, n_tokens, source, lang and topic as cells, prob and kept of each row."""
    rows = written(df.select(F.col(id_col).alias("id"), draw(F.col(id_col), F.col(text_col)).alias("draw"), celled(df, text_col, source_col, lang_col).alias("c")).select("id", "draw", "c.*"), "cells")
    joined = rows.join(F.broadcast(probabilities(rows)), list(TARGETS))
    return joined.select(F.col("id").alias(id_col), "n_tokens", *TARGETS, "prob", (F.col("draw") < F.col("prob")).alias("kept"))


def marginals(judged: DataFrame, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    """dim, value, target (shared out among the values that have tokens), expected and sampled share of the tokens, and the residual
    (expected less target), of the rows of ``weigh``."""
    out = []
    for d, target in targets.items():
        rows = judged.groupBy(d).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("prob")).alias("e"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("s")).filter("n > 0").collect()
        named, expected, sampled = sum(target.get(r[d], 0.0) for r in rows), sum(r["e"] for r in rows), sum(r["s"] for r in rows)
        for r in rows:
            wanted, reached = target.get(r[d], 0.0) / named if named else 0.0, r["e"] / expected if expected else 0.0
            out.append((d, r[d], wanted, reached, r["s"] / sampled if sampled else 0.0, reached - wanted))
    return judged.sparkSession.createDataFrame(out, "dim string, value string, target double, expected double, sampled double, residual double")


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns."""
    tagged = df.select(F.struct("*").alias("row"), draw(F.col(id_col), F.col(text_col)).alias("draw"), celled(df, text_col, source_col, lang_col).alias("c"))
    probs = probabilities(written(tagged.select("c.*"), "cells"))
    joined = tagged.join(F.broadcast(probs), [F.col(f"c.{d}") == probs[d] for d in TARGETS])
    return joined.filter(F.col("draw") < F.col("prob")).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(documents(spark, sf_dir)).select("doc_id", "n_tokens", F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), "topic", F.round("prob", 6).alias("prob"), "kept")


def _sql() -> str:
    dims = list(TARGETS)
    named = lambda d: f"case when {d} in (" + ", ".join(f"'{k}'" for k in TARGETS[d] if k != OTHER) + f") then {d} else '{OTHER}' end as {d}"
    steps, last = [], "c0"
    for k in range(ROUNDS * len(dims)):
        d = dims[k % len(dims)]
        steps.append(
            f"""s{k} as (select {d}, sum(w) as s from {last} group by {d}), p{k} as (select {d}, s, share, sum(share) filter (s > 0) over () as present from s{k} join t_{d} using ({d})),
            c{k + 1} as materialized (select c.* replace (case when s > 0 and present > 0 then w * (share / present * total / s) else w end as w) from {last} c join p{k} using ({d}), total)"""
        )
        last = f"c{k + 1}"
    targets = ", ".join(f"t_{d}({d}, share) as (values " + ", ".join(f"('{v}', {x}::double)" for v, x in TARGETS[d].items()) + ")" for d in dims)
    held = lambda strings: "(" + " or ".join(f"contains(lower(t), '{x}')" for x in strings) + ")"
    topics = " ".join(f"when {held(strings)}" + (f""" and regexp_matches(t, '{pattern.replace("'", "''")}')""" if pattern else "") + f" then '{k}'" for k, (strings, pattern) in TOPICS.items())
    return f"""with d as (select doc_id, text, coalesce(text, '') as t, source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens from documents),
        f as materialized (select doc_id, text, n_tokens, {named("source")}, {named("lang")}, case {topics} else 'prose' end as topic from d),
        {targets}, c0 as materialized (select source, lang, topic, sum(n_tokens)::double as n, sum(n_tokens)::double as w from f group by all),
        total as (select sum(n) as total from c0), {", ".join(steps)},
        o as (select *, w / n as x from {last} where n > 0), m as (select max(x) as most from o),
        q as (select c0.source as source, c0.lang as lang, c0.topic as topic, case when c0.n = 0 or most is null or most = 0 then 1.0::double else x / most end as prob
            from c0 left join o on o.source = c0.source and o.lang = c0.lang and o.topic = c0.topic, m)
        select doc_id, n_tokens, source as cell_source, lang as cell_lang, topic, round(prob, 6) as prob,
            ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 8))::bigint / 4294967296.0::double < prob as kept from f join q using (source, lang, topic)"""


QUERIES = {"op5_mixing": op5_mixing}
SQL = {"op5_mixing": _sql()}
