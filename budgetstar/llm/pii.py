"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust the score.

Base kinds are found leftmost and non-overlapping per kind. Every expression reads a text once:
runs are entered at their first character only (or where the last match ended) and repeated groups
are written as one character class with a look-ahead, so neither time nor stack grows with the
square or the length of a run. Positions of the matches are running totals, summed in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.text import plain

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float  # score of a confirmed span without context
    context: tuple[str, ...]  # words nearby that speak for it


# [local]+@label(.label)+ : the host part stops before a dot that no label follows.
EMAIL = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++\.[{_HOST}]"
    rf"[{_HOST}.]*?(?=\.?(?:[^{_HOST}.]|\z)|\.\.)"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# digit([ -]?digit)+ : goes on while a digit follows directly or after one separator.
CARD = r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """Blocks of four with or without blanks; the country says where the number ends."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        blocks, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{blocks}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


IBAN = _iban_pattern()

BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", EMAIL, 0.8, ("mail", "contact", "kontakt", "correo", "courriel", "write")),
    Kind("ip", IP, 0.6, ("ip", "host", "server", "address", "adresse", "login")),
    Kind("card", CARD, 0.8, ("card", "visa", "pay", "karte", "tarjeta", "carte", "credit")),
    Kind("phone", PHONE, 0.6, ("call", "phone", "tel", "mobile", "fax", "anruf", "llama")),
    Kind("iban", IBAN, 0.9, ("iban", "bank", "account", "konto", "cuenta", "compte")),
)
NEARBY = 40  # characters on each side that are searched for context
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def mod97(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN written without blanks; 1 means valid."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    digit = F.split(moved, "")

    def step(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.when(c == "", rest).when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(digit, F.lit(0), step)


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(lengths: Column) -> Column:
    """The sum of all elements before each one.

    A fold that grows a list copies it at every step, so lists are folded in blocks of about the
    square root of their number, then the totals of the blocks.
    """
    none = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def fold(values: Column, length) -> Column:
        def step(state: Column, value: Column) -> Column:
            before = F.concat(state["before"], F.array(state["total"]))
            return F.struct((state["total"] + length(value)).alias("total"), before.alias("before"))

        return F.aggregate(values, none, step)

    def placed(blocks: Column) -> Column:
        offsets = fold(blocks, lambda block: block["total"])["before"]
        return F.flatten(F.zip_with(blocks, offsets, lambda block, by: F.transform(block["before"], lambda x: x + by)))

    def cut(values: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values))).cast("int"))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(values) - 1), width)
        return F.transform(starts, lambda at: fold(F.slice(values, at + 1, width), lambda x: x.cast("bigint")))

    return once(once(lengths, cut), placed)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed matches as structs (kind, start, end, score), positions in code points.

    Matches and the pieces between them alternate; running totals of their lengths give the positions.
    """
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def zipped(found: Column, between: Column) -> Column:
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.char_length(b) + F.char_length(f))
        return F.arrays_zip(
            found.alias("found"),
            F.slice(between, F.lit(1), F.size(found)).alias("before"),
            F.slice(between, F.lit(2), F.size(found)).alias("after"),
            running_totals(steps).alias("base"),
        )

    def span(pair: Column) -> Column:
        start = pair["base"] + F.char_length(pair["before"])
        context = F.lower(F.concat(F.right(pair["before"], F.lit(NEARBY)), F.lit(" "), F.left(pair["after"], F.lit(NEARBY))))
        near = F.lit(False)
        for word in kind.context:
            near = near | F.contains(context, F.lit(word))
        score = F.when(near, F.lit(min(1.0, kind.prior + 0.2))).otherwise(F.lit(kind.prior))
        end = start + F.char_length(pair["found"])
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    def spans(found: Column) -> Column:
        pairs = once(F.split(text, kind.pattern, -1), lambda between: zipped(found, between))
        listed = F.transform(F.filter(pairs, lambda p: confirmed(kind.name, p["found"])), span)
        return F.when(F.size(found) > 0, listed).otherwise(empty)

    return once(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), spans)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``spans``: all confirmed spans by kind as listed, then by start.

    Null text counts as empty and has no spans; each input row gives one row, repeated or not.
    """
    docs = plain(docs, key, text)
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.concat(*[spans_of(body, k) for k in kinds]).alias("spans"))


def written(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests per document, and the best score of its spans (null without any)."""
    found = find_spans(docs, key=key, text=text)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"),
    )
