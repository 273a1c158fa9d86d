"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Defined results: a null text is empty and has no spans; repeated rows give repeated results; a proposed
span that its validator rejects is dropped and the search goes on behind it. A column that has the result's name is replaced. One row in, one row out:
no shuffle, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import find_spans, whole_text

#: Kinds in the order in which ties are listed; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "access_key", "secret")

#: Characters of an account number by country. The length ends a number that an upper-case word follows.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: A run of characters is entered only at its first character (or where the last match ended), so a long
#: run without the deciding character costs its length once, not its square.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9_/+.-]{8,200}",
}
#: Score before context; words within CONTEXT characters before a span that raise or lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "access_key": 0.9, "secret": 0.7}
CONTEXT = 48
RAISING = {
    "email": r"(?i)\b(?:e-?mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|cvv)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|contact)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "access_key": r"(?i)\b(?:key|aws|access|credential)\b",
    "secret": r"(?i)\b(?:login|user|config|credential|export)\b",
}
LOWERING = r"(?i)\b(?:example|sample|version|section|isbn|part no|figure)\b"


def luhn_valid(number: Column) -> Column:
    """The checksum over the ASCII digits of a string: every second digit from the right counts double."""
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)),
        F.lit(0),
        lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97_valid(iban: Column) -> Column:
    """ISO 7064 mod 97-10: four leading characters go last, letters count 10 to 35, the remainder is 1."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    chars = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97).cast("int"),
    )
    return rest == 1


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


#: IPv4 with every part at most 255, leading zeros allowed.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALIDATORS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.regexp_like(s, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": lambda s: _digits(s).between(12, 19) & luhn_valid(s),
    "phone": lambda s: _digits(s).between(9, 15),
    "iban": mod97_valid,
    "access_key": lambda s: F.lit(True),
    "secret": lambda s: F.lit(True),
}


def _spans_of(kind: str, text: Column) -> Column:
    proposed = F.filter(find_spans(text, PATTERNS[kind], CONTEXT), lambda s: VALIDATORS[kind](s["match"]))

    def scored(s: Column) -> Column:
        before = s["before"]
        score = (
            F.lit(SCORES[kind])
            + F.when(F.regexp_like(before, F.lit(RAISING[kind])), 0.1).otherwise(0.0)
            - F.when(F.regexp_like(before, F.lit(LOWERING)), 0.2).otherwise(0.0)
        )
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            s["match"].alias("match"),
            F.round(F.least(score, F.lit(1.0)), 2).alias("score"),
        )

    return F.transform(proposed, scored)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Adds array<struct<start,rank,kind,end,match,score>>, sorted by start and then kind."""
    text = whole_text(text_col)
    return docs.withColumn(out_col, F.array_sort(F.concat(*(_spans_of(k, text) for k in KINDS))))


def op2_pii(spark, sf_dir):
    from trajframe.llm.common import read

    spans = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return spans.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(joined(F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
