"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

DataFrame functions only, map-side: a text's spans are an array column of its own row.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.binding import let

NEAR = 40  # code points of context on either side, as far as the neighbouring proposals of the same kind
LEAST = 0.6  # score from which a span that is not of a base kind is reported
CONTEXT = 0.3  # what a word of the kind nearby adds, or one against it takes away
BLOCK = 256  # elements summed one after the other
SPAN = "array<struct<start: int, rank: int, end: int, kind: string, value: string, score: double, base: boolean>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes (in possessive form, so that no run of characters is read twice); ``needs`` is a cheap
    test of the whole text; ``confirmed`` decides on the value, the code point before and the one after.

    ``score`` is what a confirmed span has without context; of a base kind every confirmed span is reported.
    """

    name: str
    pattern: str
    needs: str
    score: float
    confirmed: Callable[[Column, Column, Column], Column]
    words: str
    against: str = ""
    base: bool = False


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    return let(digits(value), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def mod97(value: Column) -> Column:
    """The check of an account number: country and check digits go to the end, letters count from 10, the rest is 1."""
    plain = F.replace(value, F.lit(" "))

    def rest(s: Column) -> Column:
        step = lambda acc, i: let(F.ascii(F.substr(s, i, F.lit(1))), lambda c: F.when(c < 65, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)

    return let(plain, lambda p: F.length(p).between(15, 34) & (rest(F.concat(F.substr(p, F.lit(5)), F.left(p, F.lit(4)))) == 1))


def apart(before: Column, after: Column, inside: str) -> Column:
    """Whether neither neighbour is of the class ``inside``; the ends of a text are no neighbours."""
    return ~before.rlike(f"^[{inside}]$") & ~after.rlike(f"^[{inside}]$")


#: Base kinds first, in the order of the report. The pattern of an address starts where a run of its characters starts or
#: where the last address ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, lambda v, a, b: F.lit(True), "mail|email|contact|write", base=True),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]", 0.6,
        lambda v, a, b: F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "ip|address|host|server|login|client", "version|release|section|chapter", base=True,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.7, lambda v, a, b: luhn(v), "card|visa|mastercard|payment|credit|debit|carte|karte|tarjeta", "order|isbn|serial|tracking", base=True),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", 0.7, lambda v, a, b: F.length(digits(v)).between(9, 15),
        "phone|tel|call|mobile|fax|telefon|telephone|telefono", base=True,
    ),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z][A-Z][0-9][0-9]", 0.8, lambda v, a, b: apart(a, b, "A-Za-z0-9") & mod97(v), "iban|account|bank|konto|compte|cuenta"),
    Kind(
        "national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9][0-9]-[0-9]", 0.4,
        lambda v, a, b: apart(a, b, "0-9A-Za-z-") & ~v.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn|social|security|national|identity|taxpayer", "order|part|item|invoice",
    ),
    Kind(
        "local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "[0-9][ .-][0-9]", 0.4, lambda v, a, b: apart(a, b, "0-9A-Za-z.+-"),
        "phone|tel|call|mobile|fax|telefon|telephone|telefono", "order|part|item|invoice",
    ),
)


def running_sums(values: Column) -> Column:
    """Sums up to and with each element, in blocks: appending to one array would copy it once an element."""

    def chain(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

    def shifted(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.get(p, F.size(p) - 1))
        return let(chain(totals), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))))

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, chain(xs)).otherwise(let(F.transform(blocks(xs), chain), shifted)))


def has_word(near: Column, words: str) -> Column:
    return F.translate(near, _UPPER, _LOWER).rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)") if words else F.lit(False)


def proposals(text: Column, kind: Kind, rank: int, least: float) -> Column:
    """Reported spans of one kind. What lies between the matches gives both their places and their context."""
    parts = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))

        def span(h: Column, i: Column, starts: Column) -> Column:
            before, after = F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))
            at = F.get(starts, i)
            return F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("value"), before.alias("before"), after.alias("after"))

        return let(running_sums(steps), lambda starts: F.transform(hits, lambda h, i: span(h, i, starts)))

    def scored(s: Column) -> Column:
        near = lambda words: has_word(s["before"], words) | has_word(s["after"], words)
        change = F.when(near(kind.words), CONTEXT).otherwise(0.0) - F.when(near(kind.against), CONTEXT).otherwise(0.0)
        score = F.round(F.least(F.greatest(F.lit(kind.score) + change, F.lit(0.0)), F.lit(1.0)), 2)
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), s["value"].alias("value"),
            score.alias("score"), F.lit(kind.base).alias("base"),
        )

    found = F.filter(let(parts, placed), lambda s: kind.confirmed(s["value"], F.right(s["before"], F.lit(1)), F.left(s["after"], F.lit(1))))
    found = F.transform(found, scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= least)
    return F.when(text.rlike(kind.needs), found).otherwise(F.array()).cast(SPAN)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> DataFrame:
    """``doc_id, text, spans`` per row: spans by start, then kind, as ``start, rank, end, kind, value, score, base``.

    Places are code points, the end is exclusive. Matches of a kind do not overlap and are tried once, those of
    different kinds may overlap. A null text is the empty one and has no span; rows without a doc_id and rows that
    share one are searched like any other; other columns are not read. No rows: no rows.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = [proposals(F.col("text"), kind, rank, least) for rank, kind in enumerate(kinds)]
    return own.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in brackets; of overlapping spans the first start, then the first kind, is shown."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def redact_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> DataFrame:
    """``doc_id, text, n_spans`` per row, the text with its spans redacted."""
    return find_pii(docs, kinds, least).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text"), F.size("spans").cast("long").alias("n_spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans, and the scores in the order of the spans."""
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _of_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return find_pii(docs).select(
        "doc_id", *counts, F.sha2(_listed(F.filter(spans, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
