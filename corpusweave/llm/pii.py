"""Personal data, in DataFrame functions only: expressions propose, checksums confirm, context adjusts.

One regular expression a kind proposes leftmost non-overlapping spans. A match is marked in the
text with control characters (which the text's own are first replaced by a third of the same
length, so places stay right), the text is split at the marks, and places are running sums of the
pieces' lengths in code points. Validators confirm: number parts up to 255 (ip), digit counts and
Luhn (card), digit counts (phone), mod-97 (iban), the ranges that are issued (ssn), letters and
digits mixed (key, token). A confirmed
span has its kind's score, raised when one of the kind's context words stands in the ``NEAR`` code
points before it and lowered when a contrary word does, kept in 0 to 1.

The four base kinds are reported whatever their score; kinds the method adds (iban, ssn, and the
secrets: key, in a form that issuers of access keys publish, and token, any long mixed run after a
word that announces one) only from ``LEAST`` on. The expressions are written without nested backtracking, so long runs of digits or
letters stay linear and don't use the stack. A row depends on itself alone: there is no shuffle
and no Python on the executors. Null and empty texts have no spans, repeated rows agree, other
columns are kept, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.frames import fresh

NEAR = 48
LEAST = 0.5
RAISE, LOWER = 0.25, 0.30
OPEN, CLOSE, SPARE = "\x01", "\x02", "\x03"
STEP = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def one(i: Column) -> Column:
        d = F.ascii(F.substr(number, i, F.lit(1))) - 48
        twice = 2 * d
        return F.when((F.length(number) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return total(F.transform(F.sequence(F.lit(1), F.length(number)), one)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits) leaves 1 modulo 97 with its first four moved last."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def small_parts(address: Column) -> Column:
    """Whether all parts between dots are 255 at most; leading zeros don't count."""
    bare = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(F.lit(256)) <= 255))


def between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


def card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(F.lit(False)))


def mixed(m: Column) -> Column:
    """Whether a secret is a private key's first line or holds both letters and digits."""
    return m.startswith("-----") | (m.rlike("[A-Za-z]") & m.rlike("[0-9]"))


def random_looking(m: Column) -> Column:
    """Whether a run holds upper case, lower case and digits, or is at least 32 hexadecimal digits of both sorts."""
    return (m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")) | ((F.length(m) >= 32) & m.rlike("^[0-9a-f]+$") & m.rlike("[a-f]") & m.rlike("[0-9]"))


@dataclass(frozen=True)
class Kind:
    """``guard``: strings of which a text with a span holds one (in any case where the score needs a context word), or none; ``base``: reported whatever its score."""

    name: str
    pattern: str
    guard: tuple[str, ...]
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    contrary: str
    base: bool


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), None, 0.8, r"mail|contact|write|address", r"git@|noreply", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", (".",), small_parts, 0.6, r"\bip\b|host|server|address", r"version|\bv\b|section|release", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", (), card, 0.6, r"card|visa|credit|debit|payment", r"order|isbn|serial|tracking", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), between(9, 15), 0.6, r"phone|\btel\b|call|mobile|fax", r"equals|plus", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", (), iban, 0.8, r"iban|account|bank|konto|compte|cuenta", r"serial|part no", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", ("-",), None, 0.35, r"\bssn\b|social|security|tax", r"order|part", False),
    Kind("key", r"(?<![A-Za-z0-9_-])(?:A(?:KIA|SIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[opsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}+|[rs]k_live_[0-9A-Za-z]{16,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![0-9A-Za-z])", ("AKIA", "ASIA", "AIza", "gho_", "ghp_", "ghs_", "ghu_", "xox", "k_live_", "eyJ", "-----BEGIN"), mixed, 0.75, r"key|token|secret|bearer", r"example|sample|dummy|placeholder", False),
    Kind("token", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", ("key", "token", "secret", "passw", "bearer", "credential"), random_looking, 0.35, r"key|token|secret|passw|bearer|credential", r"example|sample|dummy|placeholder|sha|md5|checksum|commit", False),
)


def found(text: Column, lower: Column, order: int, kind: Kind) -> Column:
    """Confirmed spans of one kind: start, place of the kind, kind, end, score; ``lower`` is the text in lower case."""
    marked = F.regexp_replace(text, kind.pattern, f"{OPEN}$0{CLOSE}")
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,score:double>>")

    def spans(pieces: Column, lengths: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int"))
        before = F.aggregate(groups, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + total(F.slice(lengths, g * STEP + 1, F.lit(STEP))))))

        def at(starts: Column, i: Column) -> Column:
            group = F.floor(i / STEP).cast("int")
            return F.element_at(starts, group + 1) + total(F.slice(lengths, group * STEP + 1, i % STEP))

        def one(starts: Column, i: Column) -> Column:
            near = F.lower(F.right(F.element_at(pieces, i), F.lit(NEAR)))
            score = F.lit(kind.score) + F.when(near.rlike(kind.context), RAISE).otherwise(0.0) - F.when(near.rlike(kind.contrary), LOWER).otherwise(0.0)
            return let(at(starts, i), lambda s: F.struct(s.alias("start"), F.lit(order).alias("place"), F.lit(kind.name).alias("kind"), (s + F.element_at(lengths, i + 1)).alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")))

        odd = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
        kept = F.filter(odd, lambda i: F.coalesce(kind.valid(F.element_at(pieces, i + 1)), F.lit(False))) if kind.valid else odd
        out = let(before, lambda starts: F.transform(kept, lambda i: one(starts, i)))
        return out if kind.base else F.filter(out, lambda s: s["score"] >= LEAST)

    split = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    out = let(split, lambda p: F.when(F.size(p) > 1, let(F.transform(p, lambda x: F.char_length(x)), lambda n: spans(p, n)).cast("array<struct<start:int,place:int,kind:string,end:int,score:double>>")).otherwise(none))
    where = text if kind.base or kind.score >= LEAST else lower
    guarded = [F.contains(where, F.lit(g)) for g in kind.guard]
    return F.when(functools.reduce(Column.__or__, guarded), out).otherwise(none) if guarded else out


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: all confirmed spans by start and kind, places in code points."""
    name = fresh(docs, "pii")
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, SPARE + SPARE)
    spans = let(F.struct(clean.alias("text"), F.lower(clean).alias("lower")), lambda t: F.array_sort(F.concat(*(found(t["text"], t["lower"], k, kind) for k, kind in enumerate(KINDS)))))
    return docs.withColumn(name, spans)


def redact(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with every span of score ``least`` or more replaced by its kind in brackets."""
    seen = detect(docs, text)
    name = seen.columns[-1]
    strong = F.filter(F.col(name), lambda s: s["score"] >= least)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh_span = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh_span, s["end"]).otherwise(a["at"]).alias("at"), F.when(fresh_span, piece).otherwise(a["out"]).alias("out"))

    whole = F.aggregate(strong, state, step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)))
    return seen.withColumn(text, F.when(F.size(strong) > 0, whole).otherwise(F.col(text))).drop(name)
