"""Personal data in whole texts: proposed by patterns, confirmed by checks,
scored with nearby words. DataFrame functions only.

Per kind, the pattern's matches (leftmost, non-overlapping) and the gaps
between them give the spans' places by adding up lengths, in code points. Base
kinds: email, ip, card (Luhn), phone; a match that fails its check is dropped
and not tried again. Added by the method: iban (mod 97) and nin (a 3-2-4 number
with a context word before or after it). A context word near a span raises its
score; base spans stay at any score, added ones need ``MIN_SCORE``.

Every place where an IBAN could begin is tried, and there every end of a word:
of those that pass mod 97 the one with its country's length counts, else the
longest; the leftmost wins where two overlap. National numbers that only
separators part are one list, and a context word near the list is near each.

The patterns are possessive, so that runs of any length are read without
backtracking; ``\\G`` lets a match begin where the one before it ended.

Nulls: a null text is empty and has no spans; every row gives one row, repeated
rows too. An empty table gives an empty result. Only the id and the text are
read by ``find``; ``mask`` keeps every other column as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,score:double>"
MIN_SCORE = 0.8
CONTEXT_CHARS = 40

# kind: pattern, a cheap condition on the text, score, words that raise it
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
_NIN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}", None, 0.9, "iban|account|bank"),
    "nin": (rf"{_NIN}(?:[\s,;/&|]++(?:(?:and|or)\s++)?{_NIN})*+", "-", 0.5, "ssn|social security|national id|insurance number"),
}
BASE = ("email", "ip", "card", "phone")
_BONUS = {"nin": 0.4}
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC", 33: "RU"}
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit(_ALNUM), F.substring(turned, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(8, 15)
    if kind == "nin":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _iban_end(candidate: Column) -> Column:
    """Length of the IBAN that ``candidate``, read from its start, begins with;
    null if none does."""
    words = F.split(candidate, " ")

    def at(i: Column) -> Column:
        iban = F.array_join(F.slice(words, 1, i), "")
        own = iban.rlike("|".join(f"^(?:{codes}).{{{n - 2}}}$" for n, codes in _IBAN_LENGTHS.items()))
        passes = F.when(F.length(iban) >= 15, mod97(iban)).otherwise(False)
        return F.when(passes, F.struct(own.alias("own"), (F.length(iban) + i - 1).alias("n")))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(words)), at))["n"]


def _places(kind: str, found: Column, start: Column, until: Column) -> Column:
    """array<struct<start,end>> of the confirmed spans in one match at ``start``,
    none of them before ``until``."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    place = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    if kind == "iban":
        return F.filter(F.array(place(start, start + _iban_end(found))), lambda p: p["end"].isNotNull() & (p["start"] >= until))
    if kind == "nin":
        each = F.zip_with(F.split(found, _NIN, -1), F.regexp_extract_all(found, F.lit(_NIN), F.lit(0)), lambda gap, one: F.struct(gap.alias("gap"), one.alias("one")))

        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["gap"])
            end = at + F.length(x["one"])
            ok = x["one"].isNotNull() & _confirmed(kind, x["one"])
            return F.struct(F.coalesce(end, at).alias("at"), F.when(ok, F.concat(acc["out"], F.array(place(at, end)))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(each, F.struct(start.alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(_confirmed(kind, found), F.array(place(start, start + F.length(found)))).otherwise(none)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind,start,end,score>> of one kind, by start, end exclusive."""
    pattern, mark, score, words = KINDS[kind]
    none = F.array().cast(f"array<{SPAN}>")
    group = 1 if kind == "iban" else 0  # an IBAN's match is its first four characters, its candidate is looked ahead for
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def joined(gaps: Column) -> Column:
        here = F.zip_with(gaps, matches, lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
        return F.zip_with(here, F.slice(gaps, 2, F.size(gaps)), lambda x, after: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), after.alias("after")))
    both = F.transform(F.array(F.split(text, pattern, -1)), joined)[0]  # the text is split once

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + (F.lit(4) if kind == "iban" else F.length(x["found"]))
        after = F.substring(x["after"], F.length(x["found"]) - 3, F.lit(CONTEXT_CHARS)) if kind == "iban" else F.left(x["after"], F.lit(CONTEXT_CHARS))
        near = F.lower(F.right(x["gap"], F.lit(CONTEXT_CHARS))).rlike(words) | F.lower(after).rlike(words)
        sure = F.lit(score) + F.when(near, _BONUS.get(kind, 0.1)).otherwise(0.0)
        places = F.when(x["found"].isNotNull(), _places(kind, x["found"], start, acc["until"]))
        if kind not in BASE:
            places = F.when(sure >= MIN_SCORE, places)
        spans = F.transform(places, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), sure.alias("score")))
        step = lambda new: F.struct(
            F.when(x["found"].isNull(), start).otherwise(end).alias("at"), F.coalesce(F.array_max(new["end"]), acc["until"]).alias("until"),
            F.when(F.size(new) > 0, F.concat(acc["spans"], new)).otherwise(acc["spans"]).alias("spans"))
        return F.transform(F.array(spans), step)[0]  # the spans are found once

    all_of = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), none.alias("spans")), add, lambda acc: acc["spans"])
    worth = F.contains(text, F.lit(mark)) if mark else F.lit(True)
    if kind != "email":
        worth = worth & text.rlike("[0-9]")
    return F.when(worth & text.rlike(pattern), all_of).otherwise(none)


def with_spans(docs: DataFrame, text: Column, prefix: str) -> DataFrame:
    return docs.withColumns({f"{prefix}{k}": spans_of(text, k) for k in KINDS})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one array of spans per kind (named by the kind)."""
    return with_spans(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), F.col("text"), "").drop("text")


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping
    spans become one, named by the first. Texts without spans do not change;
    ``length_col``, if there is one, is the new length of a changed text."""
    text, columns = F.col(text_col), docs.columns
    prefix = "_" * (1 + max((len(c) for c in columns), default=0))  # longer than any column: clashes with none
    found = with_spans(docs, text, prefix)
    joined = F.array_sort(F.transform(F.concat(*[F.col(f"{prefix}{k}") for k in KINDS]),
                                      lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        end = -s["back"]
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate(F.col(f"{prefix}all"), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = found.withColumn(f"{prefix}all", joined).withColumn(f"{prefix}new", F.when(F.size(f"{prefix}all") > 0, new))
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.coalesce(F.col(f"{prefix}new"), text).alias(c))
        elif c == length_col:
            out.append(F.when(F.col(f"{prefix}new").isNotNull(), F.length(f"{prefix}new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return found.select(*out)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    added = [k for k in KINDS if k not in BASE]
    base = F.concat(*[F.col(k) for k in BASE])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, *[F.col(k) for k in added])).alias("spans"),
        F.array_max(F.transform(F.concat(base, *[F.col(k) for k in added]), lambda s: s["score"])).alias("top_score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .base import table
    return digest(find(table(spark, sf_dir, "documents")))
