"""Language identification: multinomial naive Bayes over hashed character n-grams.

The prior of a language is its share of the rows that are learnt from.  A null
text, or one without a letter, is ``und`` with score 0.  Where nothing can be
learnt (no labelled rows) every text is ``und``.  Ties go to the language that
sorts first.  A very long text is scored from its slot counts, SCORED slots at a
time, so memory does not grow with it beyond its own n-grams.  Repeated rows
each get their row; columns are passed on by place, so their names cannot clash;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, slices

#: Lengths of n-grams and slots that they are hashed to.
GRAMS = (1, 2, 3)
SLOTS = 1 << 16
#: Languages of a part of the model, which is what a task holds at once.
PART_LANGUAGES = 64
SMOOTHING = 0.5
#: Standard deviations that a text's mean log likelihood may lie below that of its language.
MOST_BELOW = 5.0
#: Characters of a batch, n-grams that are hashed at once, and slots that are looked up at once.
BATCH_CHARS = 400_000
HASHED = 1 << 20
SCORED = 1 << 14
_letter = re.compile(r"[^\W\d_]")
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slots_of(lowered: str) -> np.ndarray:
    """Slot of every n-gram of a lower-cased text, repeats included, shorter ones first."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for n in GRAMS:
        if len(points) < n:
            break
        mixed = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            mixed = (mixed ^ points[k : len(points) - n + 1 + k]) * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
        parts.append(mixed & np.uint32(SLOTS - 1))
    return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)


def slot_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text's n-grams and how often each occurs: its row of the sparse matrix."""
    counts, text = np.zeros(SLOTS, np.int64), text.lower()
    for at in range(0, max(1, len(text)), HASHED):
        # n-grams are counted in the piece that they start in
        piece = text[at : at + HASHED + max(GRAMS) - 1]
        slots = slots_of(piece)
        if at + HASHED < len(text):
            sizes = [max(0, len(piece) - n + 1) for n in GRAMS]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            slots = np.concatenate([slots[b : b + min(HASHED, n)] for b, n in zip(begins.tolist(), sizes, strict=True)])
        counts += np.bincount(slots, minlength=SLOTS)
    found = np.flatnonzero(counts)
    return found, counts[found]


class Model:
    """Languages in order, log priors, and log probabilities as parts of (SLOTS x PART_LANGUAGES) float32, broadcast one by one."""

    def __init__(self, langs: list[str], prior: np.ndarray, parts: list) -> None:
        self.langs, self.prior, self.parts = langs, prior, parts

    def spread(self) -> dict[str, float]:
        """Variance of an n-gram's log likelihood in each language."""
        out = []
        for part in self.parts:
            table = part.value.astype(np.float64)
            chance = np.exp(table)
            out += ((chance * table**2).sum(axis=0) - (chance * table).sum(axis=0) ** 2).tolist()
        return dict(zip(self.langs, out, strict=True))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learnt from rows that are not held out and have text and language, all of them."""
    rows = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    totals = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy("_lang").collect()}  # a row a language
    langs = sorted(totals)
    parts = [_part(rows, {x: totals[x] for x in langs[i : i + PART_LANGUAGES]}) for i in range(0, len(langs), PART_LANGUAGES)]
    return Model(langs, np.log(np.array([totals[x] for x in langs]) / max(1, sum(totals.values()))), parts)


def _part(rows: DataFrame, totals: dict[str, int]) -> object:
    langs = sorted(totals)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting, held = np.zeros((len(langs), SLOTS), np.int64), {}, 0

        def settle() -> None:
            for i, slots in waiting.items():
                sums[i] += np.bincount(np.concatenate(slots), minlength=SLOTS)
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lowered = text.as_py().lower()
                if len(lowered) > HASHED:
                    slots, n = slot_counts(lowered)
                    sums[place[lang], slots] += n
                    continue
                waiting.setdefault(place[lang], []).append(slots_of(lowered))
                held += len(lowered)
                if held > HASHED:
                    settle()
                    held = 0
        settle()
        for i, own in enumerate(sums):
            slots = np.flatnonzero(own)
            if len(slots):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), i, np.int32)), pa.array(slots.astype(np.int32)), pa.array(own[slots])], names=["lang", "slot", "n"])

    counted = np.zeros((SLOTS, len(langs)))
    learnt = rows.filter(F.col("_lang").isin(langs)).select("_lang", "_text").mapInArrow(count, "lang int, slot int, n long")
    sums = learnt.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows a language at most
    lang, slot, n = (sums.column(c).to_numpy() for c in ("lang", "slot", "n"))
    counted[slot, lang] = n
    table = counted + SMOOTHING
    return rows.sparkSession.sparkContext.broadcast(np.log(table / table.sum(axis=0)).astype(np.float32))


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log likelihood (texts x languages): the sparse matrix of slot counts times the table, row by row."""
    out = np.zeros((len(texts), table.shape[1]))
    for i, text in enumerate(texts):
        slots, counts = slot_counts(text)
        for at in range(0, len(slots), SCORED):
            out[i] += counts[at : at + SCORED] @ table[slots[at : at + SCORED]].astype(np.float64)
    return out


def best_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the likeliest language of each text, its posterior probability, and its log likelihood without the prior; a part of the model at a time."""
    n = len(texts)
    best, top, own, rest, at = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n), np.zeros(n), 0
    for part in model.parts:
        bare = scores(texts, part.value)
        likely = bare + model.prior[at : at + bare.shape[1]]
        k = likely.argmax(axis=1)
        here = likely[np.arange(n), k]
        higher = np.maximum(top, here)
        rest = rest * np.exp(top - higher) + np.exp(likely - higher[:, None]).sum(axis=1)
        better = here > top
        best, own, top = np.where(better, k + at, best), np.where(better, bare[np.arange(n), k], own), higher
        at += bare.shape[1]
    return best, 1 / rest, own


def _tagged(df: DataFrame, model: Model, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """``columns`` as c0, c1, ..., then held_out, lang_pred, score, n_grams and per_gram."""
    added = StructType.fromDDL("held_out boolean, lang_pred string, score double, n_grams long, per_gram double")
    given = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    taken = df.select(*given, F.coalesce(held_out(id_col), F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    n = len(columns)
    full = StructType([*taken.schema[:n], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            column = batch.column(n + 1)
            for start, end in slices((x or 0 for x in pa.compute.binary_length(column).to_pylist()), BATCH_CHARS):
                texts = column.slice(start, end - start).to_pylist()
                known = [i for i, x in enumerate(texts) if model.langs and x and _letter.search(x)]
                found, score = ["und"] * len(texts), [0.0] * len(texts)
                grams, mean = [0] * len(texts), [None] * len(texts)
                if known:
                    for i, k, p, top in zip(known, *best_of([texts[i] for i in known], model), strict=True):
                        found[i], score[i] = model.langs[k], float(p)
                        length = len(texts[i].lower())
                        grams[i] = sum(max(0, length - g + 1) for g in GRAMS)
                        mean[i] = float(top) / grams[i]
                passed = [batch.column(i).slice(start, end - start).cast(arrow.field(i).type) for i in range(n + 1)]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(grams, pa.int64()), pa.array(mean, pa.float64())], schema=arrow)

    return taken.mapInArrow(run, full)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred and score, the posterior probability of that language, of each row."""
    return _tagged(df, model, [id_col], id_col, text_col).select(F.col("c0").alias(id_col), "held_out", "lang_pred", "score")


def evident(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Column:
    """Whether a tagged row is as likely in its language as texts of that language are.

    per_gram, the mean log likelihood of an n-gram, does not grow with length as
    the score does.  The bound lies MOST_BELOW standard deviations below the mean
    of all held-out labelled rows; short texts, whose means vary more, get the variance of their n-grams besides.  Without such
    rows, true.
    """
    rows = df.filter(held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    bound = F.lit(True)
    judged = _tagged(rows.filter(F.col("lang").isin(model.langs)), model, ["lang"], "id", "text").filter("lang_pred = c0")
    spread = model.spread()
    for r in judged.groupBy("c0").agg(F.avg("per_gram").alias("mean"), F.var_pop("per_gram").alias("var")).orderBy("c0").collect():
        # n-grams of all lengths start at each character, so so many fewer are independent
        own = F.lit(r["var"]) + len(GRAMS) * spread[r["c0"]] / F.greatest(F.col("n_grams"), F.lit(1))
        bound = F.when(F.col("lang_pred") == r["c0"], F.col("per_gram") >= F.lit(r["mean"]) - MOST_BELOW * F.sqrt(own)).otherwise(bound)
    return bound


def accepted(df: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without the rows of no learnt language, of a score below ``least``, or unlike the texts of all that were learnt; a null language is filled in."""
    model = fit(df, id_col, text_col, lang_col)
    tagged = _tagged(df, model, df.columns, id_col, text_col)
    kept = tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least) & evident(df, model, id_col, text_col, lang_col))
    filled = {c: F.coalesce(F.col(f"c{i}"), F.col("lang_pred").cast(df.schema[c].dataType)) if c == lang_col else F.col(f"c{i}") for i, c in enumerate(df.columns)}
    return kept.select(*(x.alias(c) for c, x in filled.items()))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))


QUERIES = {"op8_langid": op8_langid}
