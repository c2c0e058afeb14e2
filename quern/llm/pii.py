"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Spans are found with Spark's own regular expressions. ``split`` gives the gaps between
the matches and ``regexp_extract_all`` the matches, so running lengths give positions
in code points without Python. Running lengths are summed in blocks, and the words
nearby are read from the gaps beside a match, so a text with a hundred thousand matches
costs a hundred times one with a thousand. Possessive quantifiers and the guard in front
of a run keep every pattern linear on long texts, and match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    # runs shorter than 16 digits can't be a card: the others match as the open pattern does
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]++(?:-[0-9]++)++",
    # keys and tokens: long runs that mix letters and digits
    "secret": r"[A-Za-z0-9_/-]{20,}+",
}
_HINT = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}
#: Only texts with one of a kind's words can have an accepted span of it.
_NEEDS = ("secret",)
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
SSN_FORM = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$"
#: A kind's score before the words nearby are read. A checksum that holds is the larger part of it.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
WORDS = {
    "email": "mail|contact|address|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
    "secret": "token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key|bearer|credential|key",
}
AGAINST = "version|example|invoice|order|serial|isbn|test"
NEARBY, RAISE, LOWER, ACCEPT = 40, 0.2, 0.2, 0.5
#: Different characters that a secret has at least; matches of which running lengths are summed at a time.
VARIED, STEP = 8, 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn sum."""

    def part(i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    n = F.length(digits)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x)
    return (n > 0) & F.when(n > 0, total % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)).cast("int")) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        return F.length(bare).between(15, 34) & mod97(bare)
    if kind == "ssn":
        return m.rlike(SSN_FORM)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= VARIED)
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """Sums of an array of numbers up to each of them: within blocks, then over the blocks before."""
    zero, empty = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    add = lambda a, x: a + x
    grow = lambda acc, x: F.concat(acc, F.array(x + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(zero)))

    def block(i: Column, xs: Column) -> Column:
        return F.slice(xs, i * STEP + 1, STEP)

    def of(numbers: Column) -> Column:
        xs, totals = numbers["xs"], numbers["totals"]

        def summed(i: Column) -> Column:
            before = F.aggregate(F.slice(totals, 1, i), zero, add)
            return F.transform(F.aggregate(block(i, xs), empty, grow), lambda x: x + before)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(totals) - 1), summed))

    def with_totals(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int"))
        return F.struct(xs.alias("xs"), F.transform(blocks, lambda i: F.aggregate(block(i, xs), zero, add)).alias("totals"))

    # one-element arrays bind what is used more than once
    return F.flatten(F.transform(F.transform(F.array(sizes), with_totals), of))


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind: an array of (kind, start, end, score), by start."""
    p = F.lit(PATTERNS[kind])
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def found(both: Column) -> Column:
        m, gaps, starts = both["m"], both["g"], both["s"]
        good = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: _confirmed(kind, m[i]))

        def span(i: Column) -> Column:
            # what stands before in the text, back to the match before last
            before = F.when(i > 0, F.concat(gaps[i - 1], m[i - 1], gaps[i])).otherwise(gaps[i])
            after = F.when(i + 1 < F.size(m), F.concat(gaps[i + 1], m[i + 1], gaps[i + 2])).otherwise(gaps[i + 1])
            near = F.concat(F.right(before, F.lit(NEARBY)), F.lit(" "), F.left(after, F.lit(NEARBY)))
            score = F.lit(SCORE[kind]) + F.when(near.rlike(rf"(?i)\b(?:{WORDS[kind]})"), RAISE).otherwise(0.0) - F.when(near.rlike(rf"(?i)\b(?:{AGAINST})"), LOWER).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), starts[i].alias("start"), (starts[i] + F.length(m[i])).alias("end"), F.round(F.least(F.lit(1.0), score), 2).alias("score"))

        return F.transform(good, span)

    def placed(both: Column) -> Column:
        """The matches, the gaps and where each match starts."""
        m, gaps = both["m"], both["g"]
        sizes = F.transform(m, lambda x, i: (F.length(gaps[i]) + F.when(i > 0, F.length(m[i - 1])).otherwise(0)).cast("bigint"))
        return F.struct(m.alias("m"), gaps.alias("g"), _running(sizes).alias("s"))

    both = F.transform(F.array(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("g"))), placed)
    has = text.rlike(PATTERNS[kind])
    if kind in _HINT:
        has = text.contains(_HINT[kind]) & has
    if kind in _NEEDS:
        has = text.rlike(rf"(?i)\b(?:{WORDS[kind]})") & has
    # the one-element array binds what both uses of a match share
    out = F.when(has, F.flatten(F.transform(both, found))).otherwise(none)
    return F.filter(out, lambda s: s["score"] >= ACCEPT) if kind in ADDED else out


def find_pii(documents: DataFrame) -> DataFrame:
    """The spans of every text: ``doc_id, spans``, an array of (kind, start, end, score).

    Positions are code points, the end exclusive. Kinds come in the order email, ip,
    card, phone, iban, ssn, secret, then by start. The first four are always reported, with a
    score that the words within 40 characters (and no further than the match before the
    last, or after the next, of the kind) raise or lower; the others only at a score of
    0.5 or more. Spans of one kind don't overlap; of different kinds they may.

    A null or empty text has no spans. Repeated rows and ids are each reported. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select("doc_id", text.alias("text"))
    return d.select("doc_id", F.concat(*[spans_of(k, F.col("text")) for k in (*BASE, *ADDED)]).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in (*BASE, *ADDED)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def _sql_spans(kind: str, pattern: str, good: str) -> str:
    return rf"""list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: struct_pack(kind := '{kind}', m := m_{kind}[i],
    b := coalesce(g_{kind}[i - 1] || m_{kind}[i - 1], '') || g_{kind}[i], f := g_{kind}[i + 1] || coalesce(m_{kind}[i + 1] || g_{kind}[i + 2], ''),
    a := coalesce(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{kind}[1:i-1], lambda x: length(x))), 0))), lambda s: {good})"""


_SQL_DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_SQL_DIGITS}[-i]::INT
    ELSE ({_SQL_DIGITS}[-i]::INT * 2) // 10 + ({_SQL_DIGITS}[-i]::INT * 2) % 10 END)) % 10 = 0"""
_SQL_MOD97 = """list_reduce([0::BIGINT] || list_transform(string_split(replace(s.m, ' ', '')[5:] || s.m[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT),
    lambda r, x: CASE WHEN x >= 1000 THEN (r * 100 + x - 1000) % 97 ELSE (r * 10 + x) % 97 END) = 1"""
_SQL_NEAR = f"(right(s.b, {NEARBY}) || ' ' || left(s.f, {NEARBY}))"
_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_matches(s.m, '{IP_PARTS}')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 16 AND 19 AND {_SQL_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 8 AND 15"),
    "iban": (PATTERNS["iban"], f"length(replace(s.m, ' ', '')) BETWEEN 15 AND 34 AND {_SQL_MOD97}"),
    "ssn": (r"[0-9]+(?:-[0-9]+)+", f"regexp_matches(s.m, '{SSN_FORM}') AND regexp_matches({_SQL_NEAR}, '(?i)\\b(?:{WORDS['ssn']})') AND NOT regexp_matches({_SQL_NEAR}, '(?i)\\b(?:{AGAINST})')"),
    "secret": (r"[A-Za-z0-9_/-]{20,}", f"regexp_matches(s.m, '[0-9]') AND regexp_matches(s.m, '[A-Za-z]') AND len(list_distinct(string_split(s.m, ''))) >= {VARIED} AND regexp_matches({_SQL_NEAR}, '(?i)\\b(?:{WORDS['secret']})') AND NOT regexp_matches({_SQL_NEAR}, '(?i)\\b(?:{AGAINST})')"),
}
_SQL_SCORE = "list_transform(%s, lambda s: round(least(1.0, %r + CASE WHEN regexp_matches(" + _SQL_NEAR + ", '(?i)\\b(?:%s)') THEN " + str(RAISE) + " ELSE 0 END - CASE WHEN regexp_matches(" + _SQL_NEAR + ", '(?i)\\b(?:" + AGAINST + ")') THEN " + str(LOWER) + " ELSE 0 END), 2)::DOUBLE)"
_SQL_TEXT = "list_transform(%s, lambda s: s.kind || ':' || s.a::BIGINT || ':' || (s.a + length(s.m))::BIGINT)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, {", ".join(f"regexp_extract_all(text, '{p}') AS m_{k}, string_split_regex(text, '{p}') AS g_{k}" for k, (p, _) in _SQL.items())} FROM d),
s AS (SELECT doc_id, {", ".join(f"{_sql_spans(k, p, good)} AS s_{k}" for k, (p, good) in _SQL.items())} FROM f)
SELECT doc_id, {", ".join(f"len(s_{k})::BIGINT AS n_{k}" for k in _SQL)},
  sha256(array_to_string({" || ".join(_SQL_TEXT % f"s_{k}" for k in BASE)}, ',')) AS base_sha256,
  array_to_string({" || ".join(_SQL_TEXT % f"s_{k}" for k in _SQL)}, ',') AS spans,
  ({" + ".join(f"len(s_{k})" for k in _SQL)})::BIGINT AS n_spans,
  coalesce(list_max({" || ".join(_SQL_SCORE % (f"s_{k}", SCORE[k], WORDS[k]) for k in _SQL)}), 0.0) AS score
FROM s
"""
