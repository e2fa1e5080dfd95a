"""Personal data, with DataFrame functions only: one pass, nothing shuffled.

Regular expressions propose spans; arithmetic confirms them (Luhn for cards, mod 97 for IBANs, 255 for addresses, digit
counts); words nearby adjust the score of each, which decides on the kinds beyond the base (IBANs, and keys and tokens). A column function can't tell where a match was, but the pieces between
matches and the matches, in turn, make up the whole text, so lengths added up give every position, in code points.

The patterns are written so that a text of any length takes linear time and no deep recursion: quantifiers that can't
profit from giving back are possessive, and a run of characters is tried from its start (or from the end of the last
match, \\G) only, as no later start in it could match.

Defined cases: null texts are empty ones; a kind's matches that fail their check are dropped and not tried again; every row
is judged by itself; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import private_name, table

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Two letters, two check digits and 11 to 30 more, in groups or not, not inside a longer word.
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])"
#: A run as long as keys and tokens are, in hex, base 64 and the like.
SECRET = r"[A-Za-z0-9_-]{20,}+"

#: The score that a confirmed match starts with, and words nearby that speak for or against it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.4}
FOR = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|tel|call|mobil|fax|whatsapp",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "secret": r"(?i)token|secret|passw|api.?key|private.?key|bearer|credential",
}
AGAINST = r"(?i)version|example|sample|order|invoice|isbn|serial|test"
CONTEXT, NEAR, STEP = 40, 0.2, 0.3
#: Spans of the kinds beyond the base count from this score on: a long run of letters and digits is a secret only beside such a word.
LEAST = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass the Luhn check: every second one from the right doubled, digits summed."""
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(_digits(text)), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN's check digits fit: first four characters last, letters as 10 to 35, remainder 1."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), "")
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _digit_count(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


def _octet(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


#: kind, pattern, what a text must hold for a confirmed match (a cheap test), the check. In the order of the digest: base kinds first.
KINDS: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = [
    ("email", EMAIL, lambda t: F.instr(t, "@") > 0, lambda m: F.lit(True)),
    ("ip", IP, lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda m: F.forall(F.split(m, r"\."), _octet)),
    ("card", CARD, lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda m: F.when(_digit_count(m, 12, 19), luhn(m)).otherwise(False)),
    ("phone", PHONE, lambda t: F.instr(t, "+") > 0, lambda m: _digit_count(m, 9, 15)),
    ("iban", IBAN, lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")), mod97),
    ("secret", SECRET, lambda t: F.rlike(t, F.lit(SECRET)), lambda m: F.length(_digits(m)).between(4, F.length(F.regexp_replace(m, "[^A-Za-z0-9]", "")) - 4)),
]
BASE = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start:int,no:int,end:int,kind:string,score:double>>"


def _located(text: Column, matches: Column, no: int) -> Column:
    """The matches of one kind that pass its check, with their places: array of struct<start, end>."""
    _, pattern, _, check = KINDS[no]
    pieces = F.arrays_zip(F.slice(F.split(text, pattern), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        more = F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(check(x["match"]), more).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, zero, step, lambda a: a["out"])


def _scored_all(text: Column, spans: Column, no: int) -> Column:
    return F.transform(spans, lambda s: _scored(text, s, no))


def _scored(text: Column, span: Column, no: int) -> Column:
    kind = KINDS[no][0]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    near = F.concat(before, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT // 2)))
    score = F.lit(PRIOR[kind]) + F.when(F.rlike(near, F.lit(FOR[kind])), NEAR).otherwise(0.0) - F.when(F.rlike(near, F.lit(AGAINST)), STEP).otherwise(0.0)
    return F.struct(span["start"].alias("start"), F.lit(no).alias("no"), span["end"].alias("end"), F.lit(kind).alias("kind"), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)).alias("score"))


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with `into`: array of struct<start, no, end, kind, score>, sorted by start and then kind; code points, end exclusive.

    A column of docs that is named so already is left alone: the new one then has underscores before its name.
    """
    into = private_name(docs, into)
    body = private_name(docs, "pii_text")
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    names = [private_name(docs, f"pii_{k[0]}") for k in KINDS]
    t = F.col(body)
    out = out.withColumns({n: F.when(may(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (_, pattern, may, _) in zip(names, KINDS, strict=True)})
    out = out.withColumns({n: F.when(F.size(n) > 0, _scored_all(t, _located(t, F.col(n), i), i)).otherwise(F.array().cast(_SPAN)) for i, n in enumerate(names)})
    return out.withColumn(into, F.sort_array(F.concat(*[F.col(n) for n in names]))).drop(body, *names)


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with each span of a score of `least` or more replaced by its kind in angle brackets; overlapping spans by one, the first's."""
    spans = private_name(docs, "pii")
    out = find(docs, text, spans)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        gap = F.substring(F.col(text), a["at"] + 1, x["start"] - a["at"])
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], gap, F.lit("<"), x["kind"], F.lit(">")).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate(F.filter(F.col(spans), lambda x: x["score"] >= least), zero, step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)))
    return out.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop(spans)


def certain(spans: Column) -> Column:
    """The base kinds' spans, and others whose score reaches LEAST."""
    return F.filter(spans, lambda s: (s["no"] < len(BASE)) | (s["score"] >= LEAST))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, n_iban, n_secret, n_spans, and risk: the greatest score, in tenths."""
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("pii", certain(F.col("pii")))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k, _, _, _ in KINDS]
    risk = F.coalesce(F.array_max(F.transform("pii", lambda s: F.round(s["score"] * 10).cast("int"))), F.lit(0))
    return out.select("doc_id", *counts, F.sha2(listed(F.filter("pii", lambda s: s["no"] < len(BASE))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), risk.alias("risk"))


#: For each kind, gaps (by splitting at matches) and matches in turn give the places, as in the query; the checks are written anew.
OP10_SQL = r"""
WITH k(no, kind, pattern) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'iban', '\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b'), (5, 'secret', '[A-Za-z0-9_-]{20,}')),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, no, kind, CASE no
  WHEN 0 THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
  WHEN 2 THEN regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+') WHEN 3 THEN regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')
  WHEN 4 THEN regexp_extract_all(text, '\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b') ELSE regexp_extract_all(text, '[A-Za-z0-9_-]{20,}') END AS ms FROM d, k),
g AS (SELECT doc_id, no, kind, text, ms, CASE no
  WHEN 0 THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 1 THEN string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
  WHEN 2 THEN string_split_regex(text, '[0-9]([\x20-]?[0-9])+') WHEN 3 THEN string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]')
  WHEN 4 THEN string_split_regex(text, '\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b') ELSE string_split_regex(text, '[A-Za-z0-9_-]{20,}') END AS gs FROM m WHERE len(ms) > 0),
u AS (SELECT doc_id, no, kind, text, unnest(ms) AS s, unnest(gs[1 : len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM g),
p AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, no ORDER BY i) AS e, regexp_replace(s, '[^0-9]', '', 'g') AS digits FROM u),
c AS (SELECT doc_id, no, kind, text, CAST(e - length(s) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE CASE no WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda j: CASE WHEN (length(digits) - j) % 2 = 0 THEN CAST(digits[j] AS INTEGER)
    ELSE (CAST(digits[j] AS INTEGER) * 2) // 10 + (CAST(digits[j] AS INTEGER) * 2) % 10 END)) % 10 = 0
  WHEN 3 THEN length(digits) BETWEEN 9 AND 15
  WHEN 5 THEN length(digits) >= 4 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 4
  ELSE list_reduce(list_transform(string_split(replace(substr(replace(s, ' ', ''), 5), ' ', '') || substr(s, 1, 4), ''), lambda x: CAST(CASE WHEN x <= '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS INTEGER)),
    lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97, 0) = 1 END),
n AS (SELECT doc_id, no, kind, b, e, substr(text, greatest(b - 39, 1), least(b, 40)) || ' ' || substr(text, e + 1, 20) AS near FROM c),
r AS (SELECT *, least(10, greatest(0, [9, 6, 8, 6, 9, 4][no + 1] + CASE WHEN CASE no WHEN 0 THEN regexp_matches(near, '(?i)mail|contact|kontakt|correo|courriel')
  WHEN 1 THEN regexp_matches(near, '(?i)\bip\b|address|host|server|login') WHEN 2 THEN regexp_matches(near, '(?i)card|visa|credit|karte|carte|tarjeta|payment')
  WHEN 3 THEN regexp_matches(near, '(?i)phone|tel|call|mobil|fax|whatsapp') WHEN 4 THEN regexp_matches(near, '(?i)iban|account|bank|konto|compte|cuenta')
  ELSE regexp_matches(near, '(?i)token|secret|passw|api.?key|private.?key|bearer|credential') END THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(near, '(?i)version|example|sample|order|invoice|isbn|serial|test') THEN 3 ELSE 0 END)) AS score FROM n),
a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card, count(*) FILTER (no = 3) AS n_phone,
  count(*) FILTER (no = 4) AS n_iban, count(*) FILTER (no = 5) AS n_secret, count(*) AS n_spans, max(score) AS risk,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (no < 4) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) AS spans FROM r WHERE no < 4 OR score >= 5 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_secret, 0) AS n_secret,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(risk, 0) AS INTEGER) AS risk
FROM d LEFT JOIN a USING (doc_id)
"""
