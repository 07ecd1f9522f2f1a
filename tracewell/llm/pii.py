"""Personal data by DataFrame functions alone: patterns, validators, context words.

A pattern proposes spans. The text is marked around every match and split at the marks, so the
lengths of the pieces give the places of the matches in code points; that needs no Python. Validators
decide which proposals stay: number ranges for addresses, Luhn for cards, digit counts for phones,
mod-97 for bank accounts. Context words near a proposal raise its score; proposals of weak patterns
stay only with such words. Patterns use possessive quantifiers where nothing can follow, and start at
the head of a run of their characters, so that no text makes them slow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, quoted

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: Matches whose places are summed up at once.
GROUP = 256
#: Code points before a span in which context words count.
NEAR = 40
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    d = F.reverse(F.split(digits(value), ""))
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, twice(x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether value, without spaces, is a bank account number with the right check digits."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.filter(F.split(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)), ""), lambda x: x != "")
    number = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.transform(moved, number), F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)
    return (F.length(v) >= 15) & (F.length(v) <= 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    """base: the score without context words; a span whose score is under LEAST goes."""

    name: str
    pattern: str
    valid: object
    words: str
    base: float
    needs: str  # a text without this character has no match


LEAST, BONUS = 0.5, 0.4
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++", lambda v: F.lit(True), "e-?mail|mail|contact|write to", 0.6, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), "ip|address|host|server|login", 0.6, "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda v: F.length(digits(v)).between(16, 19) & luhn(v), "card|visa|credit|debit|payment", 0.6, ""),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(digits(v)).between(8, 15), "phone|call|tel|mobile|fax|contact", 0.6, "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, "iban|account|bank|transfer|konto", 0.5, ""),
    Kind("national_phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", lambda v: F.lit(True), "phone|call|tel|mobile|fax|contact", 0.2, ""),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), "ssn|social security|tax id", 0.2, "-"),
)
BASE = ("email", "ip", "card", "phone")


def pieces(text: Column, pattern: str) -> Column:
    """The text before the first match, then each match, a CLOSE, and the text up to the next match."""
    clean = F.translate(text, OPEN + CLOSE, OTHER + OTHER)
    return F.split(F.regexp_replace(clean, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


SPANS = "array<struct<start:int,value:string,near:string>>"


def places(parts: Column) -> Column:
    """start and value of each match, from pieces, and near: the NEAR code points before it. The places are
    summed up in groups of GROUP and the text before goes along, so that nothing looks for a place in
    the text and the work stays near linear in texts with very many matches."""
    n = F.size(parts) - 1
    last = lambda x: F.right(F.replace(x, F.lit(CLOSE), F.lit("")), F.lit(NEAR))
    # A piece has a code point at least, so NEAR pieces hold what is near the first match of a group.
    before = lambda g: last(F.array_join(F.slice(parts, F.greatest(g * GROUP + 2 - NEAR, F.lit(1)), F.least(g * GROUP + 1, F.lit(NEAR))), ""))
    start = lambda g: F.struct(F.lit(0).alias("at"), before(g).alias("tail"), F.expr(f"CAST(array() AS {SPANS})").alias("m"))
    match = lambda x: F.substring_index(x, CLOSE, 1)
    found = lambda a, x: F.struct(a["at"].alias("start"), match(x).alias("value"), a["tail"].alias("near"))
    one = lambda a, x: F.struct((a["at"] + F.length(x) - 1).alias("at"), last(F.concat(a["tail"], x)).alias("tail"), F.concat(a["m"], F.array(found(a, x))).alias("m"))
    within = lambda g: F.aggregate(F.slice(parts, g * GROUP + 2, GROUP), start(g), one)
    groups = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int")), within)
    outer = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.expr(f"CAST(array() AS array<{SPANS}>)").alias("m"))
    moved = lambda a, g: F.transform(g["m"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["value"].alias("value"), s["near"].alias("near")))
    joined = lambda a, g: F.struct((a["at"] + g["at"]).alias("at"), F.concat(a["m"], F.array(moved(a, g))).alias("m"))
    return F.when(n > 0, F.flatten(F.aggregate(groups, outer, joined)["m"])).otherwise(F.expr(f"CAST(array() AS {SPANS})"))


def scan(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans (kind, start, end, score) of personal data in each whole text.

    By kind in the order of KINDS, then start; places in code points, end exclusive. The first four
    kinds score enough without context; the others need a valid check number or a context word. Null
    and empty texts have none; of a text of any length every match counts. Repeated rows get equal spans; a
    column of df named like out gives way to the last one. Others may have any names. No rows: no rows."""
    body, work, names = F.coalesce(quoted(text), F.lit("")), df, []
    for k in KINDS:
        names.append(fresh(df, f"pii_{k.name}"))
    for k, name in zip(KINDS, names, strict=True):
        parts = pieces(body, k.pattern)
        work = work.withColumn(name, F.when(F.contains(body, F.lit(k.needs)), parts).otherwise(F.array(F.lit(""))) if k.needs else parts)
    for k, name in zip(KINDS, names, strict=True):
        work = work.withColumn(name, F.when(F.size(name) > 1, places(F.col(name))))
    found = F.concat(*[confirmed(k, F.col(name)) for k, name in zip(KINDS, names, strict=True)]).alias(out)
    return work.select(*[quoted(c) for c in df.columns if c != out], found)


def confirmed(kind: Kind, proposed: Column) -> Column:
    """The proposed spans of a kind that are valid and score enough."""
    score = lambda s: F.lit(kind.base) + F.when(s["near"].rlike(rf"(?i)\b(?:{kind.words})\b"), F.lit(BONUS)).otherwise(F.lit(0.0))
    valid = F.filter(proposed, lambda s: kind.valid(s["value"]))
    spans = F.transform(valid, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), score(s).alias("score")))
    return F.filter(F.coalesce(spans, F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,score:double>>)")), lambda s: s["score"] >= LEAST)
