"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Column expressions only.  Null or empty text: no spans.  Very long texts: time
in proportion to the text, and n log n for n matches.  Repeated rows each get
their row; ties (spans of one start) are ordered by kind as listed; other
columns are left out, so their names cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .spans import cut, digest, let, matches, pieces

#: Java patterns that find what the base patterns find: a run is entered at its first character only, and quantifiers are possessive where nothing after them could use a shorter run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number, by country.
IBAN_LENGTHS = "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"


def national() -> str:
    """Pattern of account numbers of their country's length, in one piece or with single spaces."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS.split():
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    return "(?:" + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in by_length.items()) + ")"


IBAN = national()
#: Cheap necessary condition of an account number.
IBAN_HINT = r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"
#: Nine digits in the groups of a social security number.
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score without context, and the words that raise it when one stands within WINDOW characters.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|payment|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
WINDOW = 40
BONUS = 0.2
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 over letters as 10 to 35, the first four characters last."""
    plain = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(plain, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def valid_account(x: Column) -> Column:
    return mod97(F.regexp_replace(x["m"], " ", ""))


def edged(text: Column, spans: Column) -> Column:
    """Those of ``spans`` that end their run of capitals and digits, or that no ASCII letter or digit stands next to."""
    word = lambda c: F.rlike(c, F.lit("[A-Za-z0-9]"))

    def stands(of: Column, x: Column) -> Column:
        after = cut(of, x["e"], x["e"] + 2)
        return ~F.rlike(after, F.lit(r"^\x20?[A-Z0-9]")) | ~word(cut(of, F.greatest(x["s"] - 1, F.lit(0)), x["s"])) & ~word(F.substring(after, 1, 1))

    return F.when(F.size(spans) == 0, spans).otherwise(let(pieces(text), lambda of: F.filter(spans, lambda x: stands(of, x))))


def context(kind: str) -> str:
    return f"(?i)(?:^|[^a-z])(?:{CONTEXT[kind]})"


def scored(kind: str, of: Column, spans: Column) -> Column:
    """Spans with a score: what the pattern and checksum give, more if a context word is near; ``of``: the text's pieces."""
    near = lambda x: F.rlike(cut(of, F.greatest(F.lit(0), x["s"] - WINDOW), x["e"] + WINDOW), F.lit(context(kind)))
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), (F.lit(BASE_SCORE[kind]) + F.when(near(x), BONUS).otherwise(0.0)).alias("score")))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and, for each kind, an array of struct<s,e,m,score>.

    email, ip, card (Luhn) and phone are all kept; iban (mod 97) and ssn are
    kept if their score reaches THRESHOLD, so a bare ssn needs a context word.
    """
    text = text_or_empty(text_col)
    digits = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    has = lambda s: F.contains(text, F.lit(s))
    parts_ok = lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.length(F.ltrim(F.regexp_replace(p, "^0+", ""))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    found = {
        "email": matches(text, EMAIL, has("@")),
        "ip": F.filter(matches(text, IP, has(".")), parts_ok),
        "card": F.filter(matches(text, CARD), lambda x: let(digits(x), lambda d: F.length(d).between(14, 19) & luhn(d))),
        "phone": F.filter(matches(text, PHONE, has("+")), lambda x: F.length(digits(x)).between(10, 15)),
        "iban": F.filter(edged(text, matches(text, IBAN, F.rlike(text, F.lit(IBAN_HINT)))), valid_account),
        "ssn": matches(text, SSN, has("-")),
    }
    out = df.select(F.col(id_col).alias("_id"), text.alias("_text"), *(c.alias(k) for k, c in found.items()))
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    out = out.withColumn("_of", F.when(some, pieces(F.col("_text"))))  # for rows with spans alone
    out = out.select(F.col("_id").alias(id_col), *(scored(k, F.col("_of"), F.col(k)).alias(k) for k in KINDS))
    return out.withColumns({k: F.filter(k, lambda x: x["score"] >= THRESHOLD) for k in ("iban", "ssn")})


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    base, base_sha = digest([(k, F.col(k)) for k in KINDS[:4]])
    spans, _ = digest([(k, F.col(k)) for k in KINDS])
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), base_sha.alias("base_sha256"), spans.alias("spans"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[4:]))


def _sql_spans(pattern: str, keep: str = "true") -> str:
    """DuckDB: list of {s, e, m} of a pattern's matches in ``t``; ``keep`` is a condition on x.m."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: struct_pack(
        s := (coalesce(list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda y: length(y))), 0))::bigint,
        m := regexp_extract_all(t, '{pattern}')[i])), lambda x: {keep})"""


_LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when (length({d}) - i) % 2 = 0 then substr({d}, i, 1)::int
    when substr({d}, i, 1)::int * 2 > 9 then substr({d}, i, 1)::int * 2 - 9 else substr({d}, i, 1)::int * 2 end)) % 10 = 0"""


def _sql() -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    plain = "replace(x.m, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    mod97 = f"list_reduce(list_prepend(0::bigint, list_transform(string_split({turned}, ''), lambda c: (ascii(c) - 48)::bigint)), lambda a, b: case when b < 10 then (a * 10 + b) % 97 else (a * 100 + b - 7) % 97 end) = 1"
    near = lambda k: f"regexp_matches(substr(t, greatest(0, x.s - {WINDOW}) + 1, x.s + length(x.m) + {WINDOW} - greatest(0, x.s - {WINDOW})), '{context(k)}')"
    edges = r"(not regexp_matches(substr(t, x.s + length(x.m) + 1, 2), '^\x20?[A-Z0-9]') or not regexp_matches(case when x.s > 0 then substr(t, x.s, 1) else '' end || substr(t, x.s + length(x.m) + 1, 1), '[A-Za-z0-9]'))"
    ok = lambda k: f"{BASE_SCORE[k]} + case when {near(k)} then {BONUS} else 0.0 end >= {THRESHOLD}"
    found = {
        "email": _sql_spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        "ip": _sql_spans(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(x.m, '.'), lambda p: case when length(ltrim(p, '0')) > 3 then false else ('0' || ltrim(p, '0'))::int <= 255 end))"),
        "card": _sql_spans(r"[0-9](?:[\x20-]?[0-9])+", f"case when length({digits}) between 14 and 19 then {_LUHN.format(d=digits)} else false end"),
        "phone": _sql_spans(r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 10 and 15"),
        "iban": _sql_spans(IBAN, f"case when {edges} and {ok('iban')} then {mod97} else false end"),
        "ssn": _sql_spans(SSN, ok("ssn")),
    }
    joined = lambda ks: "array_to_string(list_transform(list_sort(flatten([" + ", ".join(f"list_transform({k}, lambda x: struct_pack(s := x.s, i := {KINDS.index(k)}, e := x.s + length(x.m), k := '{k}'))" for k in ks) + "])), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), f as materialized (select doc_id, "
        + ", ".join(f"{v} as {k}" for k, v in found.items())
        + " from d) select doc_id, "
        + ", ".join(f"len({k})::bigint as n_{k}" for k in KINDS[:4])
        + f", sha256({joined(KINDS[:4])}) as base_sha256, {joined(KINDS)} as spans, "
        + ", ".join(f"len({k})::bigint as n_{k}" for k in KINDS[4:])
        + " from f"
    )


QUERIES = {"op10_pii": op10_pii}
SQL = {"op10_pii": _sql()}
