"""Personal data in whole texts, in Spark SQL alone.

Patterns propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs, octets for IP
addresses, digit counts for phones, letters with digits for secrets) and nearby context words move the score. The base kinds are
fixed by their patterns and checks; of the kinds that the method adds, IBANs and secrets, only spans with a score of ``LEAST`` or more
count, so a long code is a secret where words near it say so. Positions come from one
pass of the pattern: ``split`` gives the gaps, ``regexp_extract_all`` the matches between them, and
running sums of their lengths the offsets. Quantifiers are possessive and starts are held to run
borders, so a pass is linear even in texts of one endless run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
PATTERNS = {
    # A leftmost match starts where a run starts, or where the last match ended (\G).
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of under 14 digits fail in any case and are left in the gaps.
    "card": r"(?=(?:[0-9][ -]?){13}[0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){13}[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9+/_-]{20}"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|reply|address|courriel|correo|kontakt",
    "ip": "ip|host|server|address|login|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "secret": "token|secret|password|passwd|pwd|credential|credentials|api key|api_key|apikey|access key|access_key|private key|private_key|bearer|passwort|contraseña",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "secret": 0.3}
LEAST = 0.5
NEAR = 40
CHUNK = 256


def luhn(digits: Column) -> Column:
    """Luhn check of a string of 1 to 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616 check: four characters to the end, letters to numbers, remainder 1."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + value(c)) % 97))
    return rest == 1


def confirmed(kind: str, m: Column, before: Column, after: Column) -> Column:
    """Whether a match is of its kind; ``before`` and ``after`` are the texts around it, null where another match adjoins."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        # The inner substring keeps a rejected long run from being summed.
        return F.length(digits).between(14, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    plain = F.replace(m, F.lit(" "), F.lit(""))
    apart = before.isNotNull() & after.isNotNull() & ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9]")
    return apart & F.length(plain).between(15, 34) & mod97(plain)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def kind_spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind in a text that is not null."""
    rank = KINDS.index(kind)
    word = f"(?i)(?<!\\p{{L}})(?:{CONTEXT[kind]})(?!\\p{{L}})"
    total = lambda a, n, k: F.aggregate(F.slice(a, n, k), F.lit(0), lambda x, y: x + y)

    def lengths(x: Column) -> Column:
        z = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.element_at(x["g"], i + 1)))
        return let(z, lambda z: sums(x, z))

    def sums(x: Column, z: Column) -> Column:
        # Offsets are running sums: of blocks first, so that many matches in one text stay cheap.
        blocks = F.sequence(F.lit(0), F.floor(F.size(z) / CHUNK).cast("int"))
        return let(F.transform(blocks, lambda b: total(z, b * CHUNK + 1, F.lit(CHUNK))), lambda b: F.filter(F.transform(x["m"], lambda m, i: one(x, z, b, m, i)), lambda s: s.isNotNull()))

    def one(x: Column, z: Column, b: Column, m: Column, i: Column) -> Column:
        gaps, n = x["g"], F.size(x["m"])
        before, after = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
        whole = F.floor(i / CHUNK).cast("int")
        start = total(b, F.lit(1), whole) + total(z, whole * CHUNK + 1, i % CHUNK) + F.length(before)
        # What is near goes on behind the next match of the kind.
        ahead = F.when(i > 0, F.concat(F.element_at(gaps, F.greatest(i, F.lit(1))), F.element_at(x["m"], F.greatest(i, F.lit(1))), before)).otherwise(before)
        behind = F.when(i + 1 < n, F.concat(after, F.element_at(x["m"], F.least(i + 2, n)), F.element_at(gaps, F.least(i + 3, n + 1)))).otherwise(after)
        near = F.right(ahead, F.lit(NEAR)).rlike(word) | F.left(behind, F.lit(NEAR)).rlike(word)
        score = F.when(near, PRIOR[kind] + 0.75 * (1 - PRIOR[kind])).otherwise(PRIOR[kind])
        span = let(start, lambda s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), score.alias("score")))
        edge = F.when((i == 0) | (before != ""), before), F.when((i + 1 == n) | (after != ""), after)
        sound = confirmed(kind, m, *edge)
        return F.when(sound if kind in BASE else sound & (score >= LEAST), span)

    parts = F.struct(F.split(text, PATTERNS[kind], -1).alias("g"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"))
    none = F.array().cast(SPAN)
    return F.when(text.rlike(NEEDS[kind]), let(parts, lambda x: F.when(F.size(x["m"]) > 0, lengths(x).cast(SPAN)).otherwise(none))).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: all confirmed spans (start, rank, end, kind, score) by start, then kind; offsets in code points, end exclusive.

    Spans of one kind do not overlap; spans of different kinds may. Null text counts as empty and has
    none. Base kinds (email, ip, card, phone) are never withdrawn by context; the method adds IBANs and secrets.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("pii", F.array_sort(F.flatten(F.array(*[kind_spans(k, text) for k in KINDS]))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_secret, scores) of every row."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 3)), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), *map(count, KINDS[len(BASE):]), scores)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's characters in ``text`` replaced by its kind in brackets and n_chars renewed.

    Overlapping spans are replaced once, by the kind of the first. Null texts stay null.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    found = find(docs.select(row.alias("row"), "text")).withColumn("t_", F.col("text").cast("string"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut_out(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        kept = F.substring(F.col("t_"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"))

    done = F.aggregate("pii", start, cut_out, lambda a: F.concat(a["out"], F.substring(F.col("t_"), a["at"] + 1, F.length("t_"))))
    new = found.withColumn("text", F.when(F.size("pii") > 0, done).otherwise(F.col("t_")))
    fresh = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return new.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`") for c in columns])
