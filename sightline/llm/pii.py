"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches that pass their check (Luhn for
cards, part and digit counts for the others); they always stay. Further kinds are proposed by looser
patterns and kept if their score reaches `threshold`: a bank account number needs mod-97, and
identity numbers, access keys and hexadecimal tokens gain from words in the characters before or after them. DataFrame and SQL functions only.

Defined cases: a null or empty text has no spans; kinds may overlap each other; a repeated row gets the
same answer twice; positions are code points, ends exclusive; an empty table gives an empty table;
columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++"
IP = r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
IDENTITY = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
HEX_TOKEN = r"\b[0-9a-f]{32,64}\b"
#: Characters that a leftmost match of the kind never follows, but where the last match ended: a run is tried once, not from each place.
RUNS = {"email": "[A-Za-z0-9._%+-]", "ip": "[0-9]"}
BASE = ("email", "ip", "card", "phone")
#: kind: (pattern, a substring pattern that every match needs, base score, context words).
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write"),
    "ip": (IP, "[0-9][.][0-9]", 0.6, "address|host|server|login|ip"),
    "card": (CARD, "[0-9]", 0.8, "card|visa|credit|pay"),
    "phone": (PHONE, "[+][0-9]", 0.7, "call|phone|tel|mobile|fax"),
    "iban": (IBAN, "[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|compte|cuenta"),
    "identity": (IDENTITY, "[0-9]{3}-[0-9]{2}-", 0.3, "ssn|social|security|identity"),
    "key": (ACCESS_KEY, "A[KS]IA", 0.8, "aws|key|secret"),
    "token": (HEX_TOKEN, "[0-9a-f]{32}", 0.3, "token|secret|password|passwd|api|key"),
}
THRESHOLD, CONTEXT_GAIN, CONTEXT_CHARS = 0.5, 0.3, 40
SPAN = "struct<start:int,end:int,value:string,score:double>"
#: Items of one run of a running total: appending within runs keeps the work in proportion to the items.
RUN = 256
#: Characters of the parts that a text is cut into, so that reading near a place does not walk the text from its beginning.
PART = 1024


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_runs(items: Column) -> Column:
    """The array cut into arrays of RUN items."""
    runs = lambda x: F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / RUN).cast("int"))
    return let(items, lambda x: F.transform(runs(x), lambda k: F.slice(x, k * RUN + 1, F.lit(RUN))))


def before_each(numbers: Column, join) -> Column:
    """For each number, join() of 0 and all numbers before it; a last entry has all of them. join: sum or greatest of two."""

    def scan(some: Column, first: Column) -> Column:
        return F.aggregate(some, F.array(first), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x)))

    def joined(runs: Column, firsts: Column) -> Column:
        inner = F.transform(runs, lambda r, i: F.slice(scan(r, F.get(firsts, i)), F.lit(1), F.size(r)))
        return F.concat(F.flatten(inner), F.array(F.element_at(firsts, -1)))

    return let(in_runs(numbers), lambda runs: let(scan(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), join)), F.lit(0)), lambda firsts: joined(runs, firsts)))


def parts_of(text: str) -> Column:
    """The text in parts of PART code points."""
    return F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PART}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive), of which `parts` are the parts."""
    first = F.floor(start / PART).cast("int")
    some = F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1)
    return F.substr(F.array_join(some, ""), start - first * PART + 1, end - start)


def matches(text: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: what stands between them gives the places."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)

    def spans(found: Column, at: Column) -> Column:
        """at: where what stands before each match begins."""

        def span(x: Column, i: Column) -> Column:
            end = F.get(at, i + 1)
            return F.struct((end - F.char_length(x)).alias("start"), end.alias("end"), x.alias("value"))

        return F.transform(found, span)

    def placed(found: Column, apart: Column) -> Column:
        steps = F.transform(found, lambda x, i: F.char_length(F.get(apart, i)) + F.char_length(x))
        return let(before_each(steps, lambda a, x: a + x), lambda at: spans(found, at))

    return let(values, lambda found: let(gaps, lambda apart: placed(found, apart)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) + 1 - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Is the account number, its first four characters moved to the end and letters as 10 to 35, 1 mod 97?"""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = digits_of(value)
        return F.char_length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(digits_of(value)).between(9, 15)
    if kind == "iban":
        return F.char_length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def spans_of(kind: str, text: str = "text") -> Column:
    """Confirmed spans of one kind with their scores, in order."""
    pattern, needed, base, words = KINDS[kind]
    if kind in RUNS:
        pattern = rf"(?:\G|(?<!{RUNS[kind]})){pattern}"
    found = F.filter(matches(text, pattern), lambda s: confirmed(kind, s["value"]))

    def scored(s: Column, parts: Column) -> Column:
        before = F.lower(between(parts, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))
        after = F.lower(between(parts, s["end"], s["end"] + CONTEXT_CHARS))
        score = F.lit(base) + F.when(before.rlike(words) | after.rlike(words), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    every = let(found, lambda spans: F.when(F.size(spans) > 0, let(parts_of(text), lambda parts: F.transform(spans, lambda s: scored(s, parts)))).otherwise(none))
    return F.when(F.col(text).rlike(needed), every).otherwise(none)


def _kept(threshold: float) -> list[Column]:
    """For each kind, an array _<kind> of the spans that stay."""
    stays = lambda k: spans_of(k) if k in BASE else F.filter(spans_of(k), lambda s: s["score"] >= threshold)
    return [stays(k).alias(f"_{k}") for k in KINDS]


def find(docs: DataFrame, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with doc_id, text, the columns of `keep` and one array of spans for each kind."""
    return common.text_rows(docs, *keep).select("*", *_kept(threshold))


def _listed(kinds) -> Column:
    one = lambda k: F.transform(f"_{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    found = find(docs)
    return found.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind.

    n_chars, where docs has it, follows the new text. The other columns may have any names: they travel inside one struct.
    """
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", "text", *_kept(THRESHOLD))
    every = F.array_sort(F.concat(*(F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(f"[{k.upper()}]").alias("name"))) for k in KINDS)))

    def cleaned(spans: Column, reach: Column, parts: Column) -> Column:
        """reach: where the spans before each one end at the furthest."""

        def piece(s: Column, i: Column) -> Column:
            at = F.get(reach, i)
            return F.when(s["start"] >= at, F.concat(between(parts, at, s["start"]), s["name"])).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(F.col("text"), F.element_at(reach, -1) + 1))

    def reached(spans: Column) -> Column:
        return before_each(F.transform(spans, lambda s: -s["end"]), lambda a, x: F.greatest(a, x))

    clean = let(every, lambda spans: let(reached(spans), lambda reach: let(parts_of("text"), lambda parts: cleaned(spans, reach, parts))))
    rows = rows.select("row", F.when(F.size(every) == 0, F.col("text")).otherwise(clean).alias("text"))
    known = F.col("row")["text"].isNotNull()
    changed = {"text": F.when(known, F.col("text")), "n_chars": F.when(known, F.char_length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
