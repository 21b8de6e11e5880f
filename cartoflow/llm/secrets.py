"""Secrets: patterns propose, ownership across the corpus tells live credentials from examples.

Column expressions, joins and aggregates only.  Null or empty text: no spans.
Very long texts: time in proportion to the text, and n log n for n matches.  A
null source counts as one owner of its own.  Repeated rows each get their row
and count as one repository; ties (spans of one start) are ordered by kind as
listed.  Columns other than the three named are left out of ``find``, and
carried as one struct by ``redact_rows``, so their names cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written
from .spans import PIECE, cut, digest, let, matches, pieces, running

WORDS = "password|passwd|secret|token|api_?key"
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""(?i:{WORDS})["']?\x20*[:=]\x20*["']?{VALUE}"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Long unbroken runs of the alphabet that keys are written in.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}+"
KINDS = ("assign", "access", "hex", "opaque")
#: A widely copied example is held by this share of the corpus' owners, and EXAMPLE_OWNERS at least, in as many distinct texts.
OWNER_SHARE = 0.25
EXAMPLE_OWNERS = 2
#: So is one in this share of the corpus' rows as distinct texts, and EXAMPLE_REPOS at least, whoever owns them.
REPO_SHARE = 1e-4
EXAMPLE_REPOS = 100
#: Distinct characters that a live-looking value has at least.
DISTINCT_CHARS = 8


def live_looking(value: Column) -> Column:
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS)


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """A row per input row: _row, id, repo (hash of the whole text), owner, and arrays assign, access, hex, opaque of struct<s,e,m,h>."""
    text = text_or_empty(text_col)
    # the value is what follows the first separator, spaces and a quote
    value = lambda m: F.regexp_extract(m, rf"""^(?i:{WORDS})["']?\x20*[:=]\x20*["']?({VALUE})$""", 1)
    mixed = lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]"))
    found = {
        "assign": F.filter(matches(text, ASSIGN), lambda x: F.length(value(x["m"])) >= 6),
        "access": matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": matches(text, HEX),
        "opaque": F.filter(matches(text, OPAQUE), lambda x: mixed(x["m"])),
    }
    secret = {k: value if k == "assign" else (lambda m: m) for k in KINDS}
    hashing = lambda of: lambda x: let(of(x["m"]), lambda v: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.md5(v).alias("h"), live_looking(v).alias("live")))
    hashed = {k: F.transform(c, hashing(secret[k])) for k, c in found.items()}
    return df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.md5(text).alias("_repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("_owner"), *(c.alias(k) for k, c in hashed.items()))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col``, arrays assign, access, hex, opaque of struct<s,e,h,live>,
    live and example, arrays of struct<s,e,k,owners,repos,looks>, and gone, an
    array of struct<s,e>: what ``redact_rows`` replaces.

    A candidate's hash is counted over all rows: by owner (``owner_col``) and by
    repository (a distinct whole text, so exact copies count once); live and
    example spans carry both counts.  What counts as widely copied grows with
    the corpus, see OWNER_SHARE and REPO_SHARE; copies of one text never make an
    example.  Live: no example, and a mix of letters and digits.  An opaque run
    counts as a span only if it is live.
    """
    rows = written(candidates(df, id_col, text_col, owner_col), "secrets")
    named = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), x["h"].alias("h"), x["live"].alias("live"))
    each = rows.select("_row", "_repo", "_owner", F.explode(F.concat(*(F.transform(k, named(k)) for k in KINDS))).alias("x")).select("_row", "_repo", "_owner", "x.*")
    # one row a (hash, owner, repository) first, summed up on the map side, so a hash that a third of the rows hold is spread
    held = each.groupBy("h", "_owner", "_repo").agg(F.lit(1).alias("one"))
    owners = held.groupBy("h", "_owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("owners"))
    repos = held.groupBy("h", "_repo").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("repos"))
    corpus = rows.groupBy("_owner").agg(F.count("*").alias("n")).agg(F.count("*").alias("owners"), F.sum("n").alias("rows")).first()  # two numbers
    least = max(EXAMPLE_OWNERS, math.ceil(OWNER_SHARE * corpus["owners"]))
    copied = (F.col("owners") >= least) & (F.col("repos") >= least) | (F.col("repos") >= max(EXAMPLE_REPOS, math.ceil(REPO_SHARE * (corpus["rows"] or 0))))
    judged = each.join(owners.join(repos, "h"), "h").withColumn("class", F.when(copied, "example").when(F.col("live"), "live"))
    spans = lambda c: F.array_sort(F.collect_list(F.when(F.col("class") == c, F.struct("s", "e", "k", "owners", "repos", F.col("live").alias("looks")))))
    secret = F.expr("if(k = 'opaque', class <=> 'live', live or not class <=> 'example')")
    gone = F.sort_array(F.collect_list(F.when(secret, F.struct("s", "e"))))
    by_row = judged.groupBy("_row").agg(spans("live").alias("live"), spans("example").alias("example"), gone.alias("gone"))
    none = F.array().cast("array<struct<s:int,e:int,k:string,owners:bigint,repos:bigint,looks:boolean>>")
    return rows.join(by_row, "_row", "left").select(F.col("_id").alias(id_col), *KINDS, F.coalesce("live", none).alias("live"), F.coalesce("example", none).alias("example"), F.coalesce("gone", F.array().cast("array<struct<s:int,e:int>>")).alias("gone"))


def opaque_spans() -> Column:
    """The opaque runs that are live."""
    return F.filter("live", lambda x: x["k"] == "opaque")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with the union of ``spans`` (array of struct<s,e,..>, any order) replaced by ``mark``; touching spans get a mark each."""

    def joined(of: Column, ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda x: x["e"]), F.greatest)

        def around(until: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(until, i - 1))
            parts = F.transform(ordered, lambda x, i: F.when(x["s"] >= before(i), F.concat(cut(of, before(i), x["s"]), F.lit(mark))).otherwise(""))
            last = F.get(until, F.size(until) - 1)
            return F.concat(F.array_join(parts, ""), cut(of, last, F.greatest(last, F.size(of) * PIECE)))

        return let(ends, around)

    return F.when(F.size(spans) == 0, text).otherwise(let(pieces(text), lambda of: let(F.sort_array(spans), lambda x: joined(of, x))))


def redact_rows(df: DataFrame, text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``df`` with credentials replaced in ``text_col``; null texts stay null.

    Replaced are all base spans, but for widely copied examples that do not look
    live (placeholders), and opaque runs of the class live.  What is replaced
    depends on the text alone, so texts meet their spans by hash; the row
    travels as one struct.
    """
    rows = df.select(F.struct("*").alias("row"), F.md5(text_or_empty(text_col)).alias("key"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"))
    found = find(rows, "key", "text", "owner")
    todo = found.select("key", F.col("gone").alias("spans")).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    joined = rows.join(todo, "key", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("spans")))
    return joined.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m")))
    arrays = [(k, bare(F.col(k))) for k in KINDS[:3]]
    _, base_sha = digest(arrays)
    spans, _ = digest([*arrays, ("opaque", bare(opaque_spans()))])
    most = lambda c: F.coalesce(F.array_max(F.transform(F.concat("live", "example"), lambda x: x[c])), F.lit(0)).alias(f"most_{c}")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base_sha.alias("base_sha256"), spans.alias("spans"), F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"), most("owners"), most("repos"))


def _sql() -> str:
    from .pii import _sql_spans

    assign = rf"""(?i:{WORDS})["'']?\x20*[:=]\x20*["'']?{VALUE}"""
    value = rf"""regexp_extract(x.m, '^(?i:{WORDS})["'']?\x20*[:=]\x20*["'']?({VALUE})$', 1)"""
    live = lambda v: f"(regexp_matches({v}, '[0-9]') and regexp_matches({v}, '[A-Za-z]') and len(list_distinct(string_split({v}, ''))) >= {DISTINCT_CHARS})"
    found = {
        "assign": _sql_spans(assign, f"length({value}) >= 6"),
        "access": _sql_spans(r"AKIA[A-Z0-9]+", "length(x.m) >= 20"),
        "hex": _sql_spans(r"[0-9a-f]{24,}"),
        "opaque": _sql_spans(r"[A-Za-z0-9+/_=-]{24,}", "regexp_matches(x.m, '[0-9]') and regexp_matches(x.m, '[A-Z]') and regexp_matches(x.m, '[a-z]')"),
    }
    named = {k: f"list_transform({v}, lambda x: struct_pack(s := x.s, i := {i}, e := x.s + length(x.m), k := '{k}', v := {value if k == 'assign' else 'x.m'}))" for i, (k, v) in enumerate(found.items())}
    joined = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source::varchar, chr(1)) as o from documents),
        f as materialized (select r, doc_id, md5(t) as repo, o, {", ".join(f"{v} as {k}" for k, v in named.items())} from d),
        x as (select r, repo, o, unnest(flatten([{", ".join(named)}])) as x from f),
        h as (select x.v as v, count(distinct o) as owners, count(distinct repo) as repos from x group by 1),
        n as (select greatest({EXAMPLE_OWNERS}, ceil({OWNER_SHARE}::double * count(distinct o))) as least, greatest({EXAMPLE_REPOS}, ceil({REPO_SHARE}::double * count(*))) as most from d),
        j as (select r, x.x as x, owners, repos, case when (owners >= least and repos >= least) or repos >= most then 'example' when {live("x.x.v")} then 'live' end as c from x join h on h.v = x.x.v, n),
        b as (select r, list(x) filter (c = 'live' and x.k = 'opaque') as opaque_live, count(*) filter (c = 'live') as n_live, count(*) filter (c = 'example') as n_example, max(owners) filter (c is not null) as most_owners, max(repos) filter (c is not null) as most_repos from j group by r)
        select doc_id, len(assign)::bigint as n_assign, len(access)::bigint as n_access, len(hex)::bigint as n_hex,
        sha256({joined("flatten([assign, access, hex])")}) as base_sha256, {joined("flatten([assign, access, hex, coalesce(opaque_live, [])])")} as spans,
        coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example, coalesce(most_owners, 0)::bigint as most_owners, coalesce(most_repos, 0)::bigint as most_repos from f left join b using (r)"""


QUERIES = {"op3_secrets": op3_secrets}
SQL = {"op3_secrets": _sql()}
