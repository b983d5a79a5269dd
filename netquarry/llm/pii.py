"""Personal data by patterns, checksums and context, in column expressions only (operator 8).

Patterns propose spans; part ranges, digit counts, Luhn and mod 97 confirm them; words nearby change the
score. Positions come from splitting a text by a pattern: pieces and matches alternate, so running
lengths give each start. Runs such as digits with single separators are first marked by characters of the
same length, so that every pattern is a plain loop over a character class: no pattern recurses or
backtracks over a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import whole

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
KINDS = BASE + ADDED
#: Score of a confirmed span without context, and the words nearby that add CONTEXT to it.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
WORDS = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": r"\bip\b|address|server|host|adresse|direcci",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|contact|telefon|anruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|\bss\b|taxpayer",
    "local_phone": r"phone|\btel|call|mobile|fax|contact|telefon|anruf|appel|llam",
}
CONTEXT = 0.3
NEARBY = 40
#: Added kinds need this score; base kinds always stay.
LEAST = 0.6

SPAN = "struct<at:int,kind:int,to:int,score:double>"
#: Marks for a separator between digits and a dot between name characters; in texts they become line ends.
DIGIT_MARK, DOT_MARK = "\x01", "\x02"


def found(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (at, to, hit) of all matches, leftmost first; at and to count code points."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,to:int,hit:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        to = at + F.length(x["hit"])
        hit = F.struct(at.alias("at"), to.alias("to"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(to.alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out")))

    none = F.array().cast("array<struct<at:int,to:int,hit:string>>")
    return F.when(guard, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    chars = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add,
                       lambda acc: acc["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 by mod 97 once its first four characters are last."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(chars, F.lit(0), add, lambda acc: acc == 1)


def spans(text: Column) -> Column:
    """Array of (at, kind, to, score) in order of start, then kind; text must not be null."""
    plain = F.translate(text, DIGIT_MARK + DOT_MARK, "\n\n")
    numbered = F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", DIGIT_MARK)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT_MARK)
    name = r"[A-Za-z0-9._%+\x02-]"
    hits = {
        # A start within a run of name characters can't match if the run's own start doesn't.
        "email": found(dotted, rf"(?:\G|(?<!{name})){name}++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++", text.contains("@")),
        "ip": found(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text.rlike(r"[0-9]\.[0-9]")),
        # Shorter runs can't hold 12 digits; runs are maximal, so leaving them out moves no other match.
        "card": found(numbered, r"(?<![0-9\x01])[0-9][0-9\x01]{11,}+", text.rlike("[0-9][0-9 -]{11}")),
        "phone": found(text, r"\+[0-9][ ().0-9-]+[0-9]", text.rlike(r"\+[0-9]")),
        "iban": found(text, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
                      text.rlike("[A-Z]{2}[0-9]{2}")),
        "ssn": found(text, r"(?<![0-9+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text.rlike("[0-9]-[0-9]{2}-[0-9]")),
        "local_phone": found(text, r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
                             text.rlike("[0-9]{3}[ .-][0-9]{4}")),
    }
    low = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    right = {
        "email": lambda h: F.lit(True),
        "ip": lambda h: h.rlike(rf"^{low}\.{low}\.{low}\.{low}$"),
        "card": lambda h: F.when(F.length(digits(h)).between(12, 19), luhn(digits(h))).otherwise(False),
        "phone": lambda h: F.length(digits(h)).between(9, 15),
        "iban": lambda h: F.when(F.length(F.replace(h, F.lit(" "))).between(15, 34),
                                 mod97(F.replace(h, F.lit(" ")))).otherwise(False),
        "ssn": lambda h: ~h.rlike("^(?:000|666|9)|-00-|-0000$"),
        "local_phone": lambda h: F.lit(True),
    }

    def scored(kind: str) -> Column:
        def one(h: Column) -> Column:
            near = F.lower(F.substr(text, F.greatest(h["at"] - NEARBY, F.lit(0)) + 1, h["to"] - h["at"] + 2 * NEARBY))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(WORDS[kind]), CONTEXT).otherwise(0.0)
            return F.struct(h["at"].alias("at"), F.lit(KINDS.index(kind)).alias("kind"), h["to"].alias("to"),
                            F.least(score, F.lit(1.0)).alias("score"))

        return F.transform(F.filter(hits[kind], lambda h: right[kind](h["hit"])), one).cast(f"array<{SPAN}>")

    base = F.concat(*map(scored, BASE))
    added = F.filter(F.concat(*map(scored, ADDED)), lambda s: s["score"] >= LEAST)
    return F.array_sort(F.concat(base, added))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """The table with an array of spans (at, kind as an index of KINDS, to, score), by start, then kind.

    at and to count code points, to is exclusive. A null text is an empty one and has no spans. Every row,
    repeated or not, gives one row; a column named like out is replaced. Kinds may overlap one another.
    """
    return docs.withColumn(out, spans(whole(F.col(text))))


def names(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def joined(array: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", names(s["kind"]), s["at"], s["to"])), ",")


def base_only(array: Column) -> Column:
    return F.filter(array, lambda s: s["kind"] < len(BASE))


def count_of(array: Column, kind: str) -> Column:
    return F.size(F.filter(array, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def masked(text: Column, array: Column) -> Column:
    """The text with each stretch of spans replaced by the first one's kind, such as [EMAIL]."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["pos"] + 1, s["at"] - acc["pos"])
        tag = F.concat(gap, F.lit("["), F.upper(names(s["kind"])), F.lit("]"))
        return F.when(s["at"] < acc["pos"], F.struct(F.greatest(acc["pos"], s["to"]).alias("pos"), acc["out"].alias("out"))
                      ).otherwise(F.struct(s["to"].alias("pos"), F.concat(acc["out"], F.array(tag)).alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(array, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1)))
    return F.when(F.size(array) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The table with personal data masked in its text; n_chars, if there, counts the new text. Null texts stay null."""
    out = "__pii_spans"
    new = find_pii(docs, text, out).withColumn(text, F.when(F.col(text).isNotNull(), masked(F.col(text), F.col(out))))
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        new = new.withColumn(n_chars, F.when(F.size(out) > 0, F.length(text)).otherwise(F.col(n_chars)).cast(kind))
    return new.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of the contract."""
    pii = F.col("pii")
    return find_pii(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count_of(pii, kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base_only(pii)), 256).alias("base_sha256"),
        joined(pii).alias("spans"),
        F.aggregate(pii, F.lit(0.0), lambda a, s: a + s["score"]).alias("score_sum"),
    )
