"""Personal data by patterns, checksum validators and context words, in DataFrame functions only.

Patterns propose spans.  Digits of cards pass Luhn, account numbers pass mod-97, addresses have parts up to 255, telephone numbers a
plausible number of digits.  Words near a span raise its score.  The base kinds are kept whenever their rule holds; the added kinds
(``iban``, ``short_card`` of 13 to 15 digits, ``ssn``) need a score of at least ``min_score``, so that a bare number without support is left alone.

Positions come without a loop over the text: the text split at the matches gives the gaps between them, and the running sum of lengths of
gaps and matches is the start of each match.  Patterns are written with possessive loops, which use no stack and no second try, whatever the
length of a run; where a base pattern could begin anew inside a run, the end of the previous match (``\\G``) allows it.

Defined cases: null text counts as empty and gives no span; repeated rows are searched each; other columns are carried as they are,
whatever their names.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, table

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "short_card", "ssn"]

# Fixed patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Fixed lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def sized_iban() -> str:
    """The pattern of account numbers: as long as the country prescribes, or, for other letters, ``PATTERNS["iban"]``."""
    def one(n: int, codes: str) -> str:
        fours, rest = divmod(n - 4, 4)
        return rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    return "|".join([*[one(n, c) for n, c in IBAN_LENGTHS.items()], f"(?!{known}){PATTERNS['iban']}"])


# Fixed words that support a kind when they stand near it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|master|credit|debit|pay",
    "short_card": "card|visa|amex|diners|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
}
# Fixed scores: the pattern alone, the validator's share, the context's share.
SCORES = {
    "email": (0.6, 0.0, 0.3), "ip": (0.4, 0.2, 0.3), "card": (0.3, 0.5, 0.2), "phone": (0.4, 0.2, 0.3),
    "iban": (0.2, 0.6, 0.2), "short_card": (0.1, 0.3, 0.4), "ssn": (0.2, 0.1, 0.5),
}


@dataclass(frozen=True)
class PiiSettings:
    window: int = 40
    min_score: float = 0.75


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def small_part(p: Column) -> Column:
    """A decimal number of any length that is at most 255."""
    t = F.trim(F.regexp_replace(p, "^0+", ""))
    return (F.length(t) <= 3) & (F.coalesce(F.substring(t, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def mod97(v: Column) -> Column:
    """The remainder of an account number: four leading characters moved to the end, letters as 10 to 35."""
    s = F.regexp_replace(v, r"\x20", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        d = F.ascii(c)
        return F.when(d >= 65, (acc * 100 + (d - 55)) % 97).otherwise((acc * 10 + (d - 48)) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), small_part)
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(v))
    if kind == "short_card":
        return n.between(13, 15) & F.call_function("luhn_check", digits(v))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(v, r"\x20", "")).between(15, 34) & (mod97(v) == 1)
    if kind == "ssn":
        return ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 1, 1) != "9")
    return F.lit(True)


def located(matches: Column, gaps: Column) -> Column:
    """array<struct<value, start, stop>>: where each match lies."""
    n = F.size(matches)
    rows = F.arrays_zip(F.slice(gaps, 1, n).alias("before"), matches.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<value:string,start:bigint,stop:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["pos"] + F.length(x["before"])
        hi = lo + F.length(x["value"])
        one = F.struct(x["value"].alias("value"), lo.alias("start"), hi.alias("stop"))
        return F.struct(hi.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, start, step)["out"]


def near(text: Column, x: Column, window: int) -> Column:
    """The lower-case text of ``window`` characters on each side of a span, whatever else matches there."""
    lo = F.greatest(x["start"] - window, F.lit(0))
    left = F.substring(text, (lo + 1).cast("int"), (x["start"] - lo).cast("int"))
    return F.lower(F.concat(left, F.lit(" "), F.substring(text, (x["stop"] + 1).cast("int"), F.lit(window))))


def scored(kind: str, spans: Column, text: Column, cfg: PiiSettings) -> Column:
    """array<struct<kind, start, stop, score>> of the spans that hold."""
    base, check, context = SCORES[kind]
    # only validated spans are left, so each has the validator's share; tenths keep the sum exact
    tenths = lambda x: round(base * 10) + round(check * 10) + F.when(near(text, x, cfg.window).rlike(CONTEXT[kind]), round(context * 10)).otherwise(0)
    cast = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"
    ok = F.filter(spans, lambda x: valid(kind, x["value"]))
    all_ = F.transform(ok, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), (tenths(x) / 10).alias("score")))
    kept = all_ if kind in BASE else F.filter(all_, lambda x: x["score"] >= cfg.min_score)
    return F.coalesce(kept.cast(cast), F.array().cast(cast))


def pii_spans(docs: DataFrame, text: str = "text", out: str = "spans", cfg: PiiSettings = PiiSettings()) -> DataFrame:
    """``docs`` and an array column ``out`` of (kind, start, stop, score), kinds in the order of BASE and ADDED, then by start."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # plain tests that spare most texts the patterns
    has_digit = t.rlike("[0-9]")
    may = {
        "email": F.contains(t, F.lit("@")), "ip": F.contains(t, F.lit(".")) & has_digit, "card": has_digit,
        "phone": F.contains(t, F.lit("+")), "iban": has_digit, "ssn": F.contains(t, F.lit("-")) & has_digit,
    }
    patterns = {**PATTERNS, "iban": sized_iban()}
    kinds = list(patterns)
    m = dict(zip(kinds, fresh(docs, *[f"match_{k}" for k in kinds])))
    empty = F.array().cast("array<string>")
    df = docs.withColumns({m[k]: F.when(may[k], F.regexp_extract_all(t, F.lit(patterns[k]), F.lit(0))).otherwise(empty) for k in kinds})
    at = dict(zip(kinds, fresh(df, *[f"at_{k}" for k in kinds])))
    none = F.lit(None).cast("array<struct<value:string,start:bigint,stop:bigint>>")
    df = df.withColumns({
        at[k]: F.when(F.size(m[k]) > 0, located(F.col(m[k]), F.split(t, patterns[k], -1))).otherwise(none) for k in kinds
    })
    source = {k: F.col(at["card" if k == "short_card" else k]) for k in BASE + ADDED}
    spans = F.concat(*[F.when(source[k].isNull(), F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,score:double>>"))
                       .otherwise(scored(k, source[k], t, cfg)) for k in BASE + ADDED])
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias(out))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_pii(spark, d) -> DataFrame:
    s = pii_spans(table(spark, d, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return s.select("doc_id", *[of(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PATTERNS["phone"], "iban": PATTERNS["iban"], "ssn": PATTERNS["ssn"],
    }
    n = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
    luhn = ("(SELECT sum(CASE WHEN (length(dg) - i) % 2 = 1 THEN (CASE WHEN 2 * c > 9 THEN 2 * c - 9 ELSE 2 * c END) ELSE c END) % 10 = 0 "
            "FROM (SELECT i, substr(dg, i::INT, 1)::INT AS c FROM range(1, length(dg) + 1) r(i)))")
    iban = ("(SELECT list_reduce([0]::BIGINT[] || list_transform(string_split(substr(sp, 5) || substr(sp, 1, 4), ''), "
            "lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END), "
            "lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1)")
    ok = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(substr(ltrim(p, '0'), 1, 3) AS INT), 0) > 255)) = 0",
        "card": f"{n} BETWEEN 16 AND 19 AND {luhn}", "phone": f"{n} BETWEEN 8 AND 15", "iban": f"length(sp) BETWEEN 15 AND 34 AND {iban}",
        "short_card": f"{n} BETWEEN 13 AND 15 AND {luhn}", "ssn": "substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 1, 1) <> '9'",
    }
    parts = []
    for i, k in enumerate(BASE + ADDED):
        p = plain["card" if k == "short_card" else k]
        b, c, x = SCORES[k]
        enough = "true" if k in BASE else f"({round(b * 10)} + {round(c * 10)} + CASE WHEN regexp_matches(near, '{CONTEXT[k]}') THEN {round(x * 10)} ELSE 0 END) / 10.0 >= {PiiSettings().min_score}"
        parts.append(f"""SELECT doc_id, {i} AS o, '{k}' AS kind, lo, lo + length(v) AS hi FROM (
  SELECT doc_id, ms[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS dg, replace(ms[i], ' ', '') AS sp,
    (list_sum([length(g) FOR g IN gs[1:i]]) + coalesce(list_sum([length(y) FOR y IN ms[1:i - 1]]), 0))::BIGINT AS lo,
    lower(right(gs[i], 40) || ' ' || left(gs[i + 1], 40)) AS near
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM t))) WHERE {ok[k]} AND {enough}""")
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone,
  string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY o, lo) FILTER (o < 4) AS b, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY o, lo) AS a FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""


OP6_SQL = _sql()
