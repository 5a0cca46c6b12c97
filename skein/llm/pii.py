"""Operator 12, personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

1. A kind's pattern is applied once for its matches and once for the pieces between them (`regexp_extract_all`, `split`); the
   running sum of their lengths gives code-point offsets. Sums double their reach each pass, so n matches cost n log n.
2. A validator (Luhn, mod-97, parts of an address, numbers of digits) drops what it can't confirm; nothing is tried again
   within a dropped match.
3. The score is the kind's own, plus `NEAR` if one of its words stands within `WINDOW` characters before or after the match
   (as far as the next match of the kind), less `NEAR` if a word of `AGAINST` does. Base kinds stay whatever their score
   is; others need `LEAST`.

Patterns are possessive and look behind instead of trying every letter of a run, so a text of one million digits is read
in a pass and no repeated group recurses. All works within a row: nothing is exploded, joined or shuffled, so a
very long text or many matches in it stay in their row, and skew can't arise.

Defined results: a null or empty text has no spans; every row is judged on its own, so null or repeated ids stay as they
are; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters looked at on each side of a match; what a word near it adds or takes; the least score of kinds that aren't base ones.
WINDOW, NEAR, LEAST = 40, 0.35, 0.5
#: Words that speak against personal data, in texts of any kind.
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "sku", "build", "release", "example")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] = lambda value: F.lit(True)
    words: tuple[str, ...] = ()
    #: A letter or sign that every match holds, where there is one: texts without it aren't searched.
    sign: str = ""
    base: bool = False


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of 10."""
    return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))


def mod97(value: Column) -> Column:
    """The first four letters go to the end, letters become 10 to 35; the number is 1 modulo 97."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def address(value: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


_L = "A-Za-z0-9._%+-"
#: The base kinds. Each equals the plain pattern of its comment, leftmost and without overlaps.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a local part starts where its letters do, or where the last match ended
    Kind("email", rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, words=("mail", "contact", "write", "kontakt", "contacto", "courriel"), sign="@", base=True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) : starts where its run of digits does, as no match ends within a run
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.5, address, ("ip", "host", "server", "login", "address", "adresse"), sign=".", base=True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.6, luhn, ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), base=True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, lambda v: F.length(digits(v)).between(9, 15), ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"), sign="+", base=True),
)
#: Kinds that the method adds: a checksum or a word near them makes the difference.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.85, mod97, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, words=("ssn", "social", "security", "insurance", "ausweis", "identity"), sign="-"),
    Kind("passport", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])", 0.2, words=("passport", "pass", "passeport", "pasaporte", "reisepass")),
    Kind("birth_date", r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])", 0.2, words=("born", "birth", "birthday", "geboren", "naissance", "nacimiento", "nacido"), sign="-"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The array that body makes of an array, which is computed once."""
    return F.flatten(F.transform(F.array(value), body))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's first 1, 2, 3, ... numbers. Each pass adds the sum that ends a power of two before."""
    powers = F.array(*[F.lit(1 << k) for k in range(30)])

    def passes(given: Column) -> Column:
        reaches = F.filter(powers, lambda reach: reach < F.size(given))
        return F.aggregate(reaches, given, lambda sums, reach: F.transform(sums, lambda x, k: x + F.coalesce(F.get(sums, k - reach), F.lit(0))))

    return let(numbers, passes)


def _near(words: tuple[str, ...], text: Column) -> Column:
    return F.lower(text).rlike(rf"(?<![\p{{L}}])(?:{'|'.join(words)})s?(?![\p{{L}}])") if words else F.lit(False)


def _spans(kind: Kind, rank: int, found: Column, between: Column) -> Column:
    """The kind's confirmed spans out of its matches and the pieces between them."""
    ends = running_sums(F.transform(found, lambda x, k: F.length(x) + F.length(F.get(between, k))))

    def scored(s: Column) -> Column:
        around = F.concat_ws(" ", s.before, s.after)
        score = F.lit(kind.score) + F.when(_near(kind.words, around), NEAR).otherwise(0.0) - F.when(_near(AGAINST, around), NEAR).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        return F.struct((s.end - F.length(s.value)).cast("long").alias("start"), F.lit(rank).alias("rank"), s.end.cast("long").alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), s.value.alias("value"))

    def placed(sums: Column) -> Column:
        return F.transform(found, lambda x, k: F.struct(F.get(sums, k).alias("end"), x.alias("value"), F.right(F.get(between, k), F.lit(WINDOW)).alias("before"), F.left(F.get(between, k + 1), F.lit(WINDOW)).alias("after")))

    spans = let(ends, placed)
    kept = F.transform(F.filter(spans, lambda s: kind.valid(s.value)), scored)
    return kept if kind.base else F.filter(kept, lambda s: s.score >= LEAST)


def find(df: DataFrame, kinds: tuple[Kind, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, rank, end, kind, score, value) by start, then by the kinds' order; ends are exclusive, all in code points."""
    none, text = F.array().cast("array<string>"), F.col("text")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = {k: F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)) for k, kind in enumerate(kinds)}
    rows = rows.select("*", *[(F.when(F.contains(text, F.lit(kinds[k].sign)), m).otherwise(none) if kinds[k].sign else m).alias(f"found{k}") for k, m in found.items()])
    # most texts hold no candidate of a kind: they aren't split
    rows = rows.select("doc_id", *[f"found{k}" for k in found], *[F.when(F.size(f"found{k}") > 0, F.split("text", kind.pattern, -1)).otherwise(none).alias(f"between{k}") for k, kind in enumerate(kinds)])
    spans = [_spans(kind, k, F.col(f"found{k}"), F.col(f"between{k}")) for k, kind in enumerate(kinds)]
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _of(*names: str) -> Column:
    return F.filter("spans", lambda s: s.kind.isin(*names))


def digest(df: DataFrame, kinds: tuple[Kind, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of each base kind's spans, the digest of the base spans, all spans."""
    names = [k.name for k in kinds if k.base]
    counts = [F.size(_of(name)).cast("long").alias(f"n_{name}") for name in names]
    return find(df, kinds, id_col, text_col).select("doc_id", *counts, F.sha2(listed(_of(*names)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
