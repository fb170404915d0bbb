"""Personal data: expressions propose spans, checks confirm them, words nearby adjust the score.

Everything is DataFrame expressions.  Each expression is written so that it can only start where
the plain pattern's leftmost match would start and never backtracks over a long run, so it finds
the same matches in linear time.  Positions are code points: the texts between the matches
(``split``) and the matches themselves alternate, so running lengths give every start and end.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"
# Code points looked at before and after a span for its context words.
BEFORE, AFTER = 40, 20
ACCEPT = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn check."""
    d = F.reverse(_digits(m))

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number passes the mod-97 check: first four characters last, letters as 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(s, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), step) == 1


def _between(n: Column, lo: int, hi: int) -> Column:
    return (n >= lo) & (n <= hi)


@dataclass(frozen=True)
class Kind:
    name: str
    # Texts without a match of this cannot hold one of ``pattern``.
    hint: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    # Words nearby that raise the score by ``raised``.
    words: str
    raised: float = 0.2
    base: bool = True


KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "mail|contact|write to|reach"),
    Kind("ip", r"\.", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"), 0.6, "ip|address|host|server|login"),
    Kind("card", "[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", luhn, 0.7, "card|visa|credit|payment|carte|tarjeta|karte"),
    Kind("phone", r"\+", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _between(F.length(_digits(m)), 9, 15), 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", "[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod97, 0.8, "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.4, "ssn|social security|social-security", base=False),
)


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    listed = "array<struct<start:int,end:int,text:string>>"
    state = f"struct<at:int,out:{listed}>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], one).alias("out")).cast(state))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(listed).alias("out")).cast(state)
    spans = F.aggregate(F.arrays_zip(found.alias("m"), between.alias("b")), zero, step)["out"]
    return F.when(text.rlike(kind.hint), spans).otherwise(F.array().cast(listed))


def _scored(text: Column, kind: Kind) -> Column:
    def score(s: Column) -> Column:
        lo = F.greatest(s["start"] - BEFORE, F.lit(0))
        near = F.concat_ws(" ", F.substr(text, lo + 1, s["start"] - lo), F.substr(text, s["end"] + 1, F.lit(AFTER)))
        hit = F.lower(near).rlike(rf"(?<![a-z])(?:{kind.words})")
        return F.least(F.lit(kind.score) + F.when(hit, kind.raised).otherwise(0.0), F.lit(1.0))

    kept = F.filter(_matches(text, kind), lambda s: kind.confirmed(s["text"]))
    spans = F.transform(kept, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score(s).alias("score")))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= ACCEPT)


def spans(text: Column) -> Column:
    """All spans of a text by kind as listed, then start; NULL and empty texts have none."""
    return F.concat(*[_scored(F.coalesce(text, F.lit("")), k) for k in KINDS]).cast(f"array<{SPAN}>")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: one row per row of ``docs``; spans have kind, start, end (exclusive), text and score."""
    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("spans"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def report(found: DataFrame) -> DataFrame:
    """Counts and the written spans of each document."""
    names = [k.name for k in KINDS if k.base]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [F.size(F.filter("spans", _of_kind(n))).cast("long").alias(f"n_{n}") for n in names]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first (then longest) counts.

    NULL stays NULL.
    """
    plain_text = F.coalesce(text, F.lit(""))
    in_place = F.array_sort(spans(text), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    state = "struct<at:int,out:array<string>>"

    def step(a: Column, s: Column) -> Column:
        kept = F.substr(plain_text, a["at"] + 1, s["start"] - a["at"])
        after = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(kept, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] >= a["at"], after.cast(state)).otherwise(a)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    done = F.aggregate(in_place, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(plain_text, a["at"] + 1, F.length(plain_text))))
    return F.when(text.isNotNull(), done)
