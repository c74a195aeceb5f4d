"""Personal data: expressions propose, checksums confirm, context adjusts.

Four base kinds (e-mail, IP address, payment card, telephone number) follow
fixed rules. The method adds international bank account numbers, confirmed by
the remainder modulo 97, and social security numbers, which have no checksum and
so count only where a nearby word raises their score to the threshold.

Only DataFrame functions. The expressions are written so that a scan stays
linear in the text: repeats are possessive, and a match may start only where the
run of its first class starts or where the match before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm import spans as S
from sparkfathom.llm.shared import held

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The head of an account number; its group looks ahead at what the body may be and one character more.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: The kinds in their order, base kinds first.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: What a confirmed span scores without context, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.3}

#: Words near a span that raise its score by RAISE, by kind.
CONTEXT = {
    "email": "e-?mail|mail|contact|write to",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|debit|payment|cvv",
    "phone": "phone|tel|call|mobile|cell|fax",
    "iban": "iban|bank|account|transfer|swift",
    "ssn": "ssn|social security|tax id",
}

#: Characters of an account number by country, those of countries outside the register too.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
        27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: Words near a span that lower its score by LOWER, any kind.
DOUBT = "example|sample|dummy|version|isbn|serial|part number"

RAISE, LOWER, LEAST = 0.3, 0.2, 0.5

#: The Spark type of what is near the spans of one kind, and of spans with scores.
MARKS = "array<struct<start:bigint,end:bigint,up:boolean,down:boolean>>"
SCORED = "array<struct<start:bigint,ord:int,end:bigint,kind:string,body:string,score:double>>"

#: Code points before and after a span that count as near.
NEAR = 48


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(d: Column, doubled: Column) -> Column:
        twice = d * 2
        return F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    marks = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(marks, lambda c, i: worth(c.cast("int"), i % 2 == 1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether an account number leaves the remainder 1 modulo 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def whole_ibans(heads: Column, tails: Column) -> Column:
    """Spans of account numbers from their heads and what follows each.

    A country of ``IBAN_LENGTH`` says where its numbers end; those of others end
    where the run of capitals and digits does. No number goes on without a space.
    """
    sizes = F.create_map(*[F.lit(x) for c, n in IBAN_LENGTH.items() for x in (c, str(n - 4))])

    def whole(head: Column, tail: Column) -> Column:
        size = F.coalesce(F.element_at(sizes, F.substring(head["body"], 1, 2)), F.lit("11,30"))
        rule = F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), size, F.lit(r"}+(?![A-Za-z0-9])"))
        body = F.call_function("regexp_extract", tail, rule, F.lit(0))
        end = head["end"] + F.length(body)
        return F.when(
            body != "",
            F.struct(
                head["start"].alias("start"), head["ord"].alias("ord"), end.alias("end"),
                head["kind"].alias("kind"), F.concat(head["body"], body).alias("body"),
            ),
        )

    return F.filter(F.zip_with(heads, tails, whole), lambda s: s.isNotNull()).cast(S.SPANS)


def apart(found: Column) -> Column:
    """Sorted spans of one kind without those that start inside one that stays."""
    overlaps = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: a["end"] > b["start"])
    stays = lambda acc, s: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= s["start"]
    fold = F.aggregate(
        found, F.array().cast(S.SPANS), lambda acc, s: F.when(stays(acc, s), F.concat(acc, F.array(s))).otherwise(acc)
    )
    return F.when(F.exists(overlaps, lambda x: F.coalesce(x, F.lit(False))), fold).otherwise(found)


def confirmed(found: Column, kind: str) -> Column:
    """The spans of one kind that pass its check."""
    if kind == "email":
        return found
    if kind == "ip":
        return F.filter(found, lambda s: s["body"].rlike(_IP_OK))
    bare = lambda s: F.regexp_replace(s["body"], "[^0-9]", "")
    if kind == "card":
        return F.filter(
            found,
            lambda s: (s["end"] - s["start"] >= 14)
            & F.length(bare(s)).between(14, 19)
            & F.when(F.length(bare(s)).between(14, 19), luhn_ok(bare(s))).otherwise(F.lit(False)),
        )
    if kind == "phone":
        return F.filter(found, lambda s: F.length(bare(s)).between(10, 15))
    if kind == "iban":
        return F.filter(found, lambda s: mod97_ok(s["body"]))
    return found


def worth(kind: str, up: Column, down: Column) -> Column:
    """Prior of the kind, raised or lowered by what is near."""
    moved = F.lit(PRIOR[kind]) + F.when(up, RAISE).otherwise(0.0) - F.when(down, LOWER).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))


def marks(text: Column, found: Column, kind: str) -> Column:
    """``(start, end, up, down)`` of each span: whether words on either side raise or lower it."""

    def mark(span: Column) -> Column:
        start = F.greatest(span["start"] - NEAR, F.lit(0))
        before = F.substring(text, (start + 1).cast("int"), (span["start"] - start).cast("int"))
        after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(NEAR))
        near = F.lower(F.concat(before, F.lit("\n"), after))
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            near.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})").alias("up"),
            near.rlike(rf"(?<![a-z])(?:{DOUBT})").alias("down"),
        )

    return F.transform(found, mark).cast(MARKS)


def spread(marked: Column, kind: str) -> Column:
    """Marks where a raised span that is confirmed raises the next one of its kind, if near."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.greatest(x["start"] - last["end"], last["start"] - x["end"])
        reached = last["up"] & (worth(kind, last["up"], last["down"]) >= LEAST) & (gap <= NEAR)
        up = x["up"] | F.coalesce(reached, F.lit(False))
        return F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), up.alias("up"), x["down"].alias("down"))))

    fold = F.aggregate(marked, F.array().cast(MARKS), lambda acc, x: step(acc, x).cast(MARKS))
    mixed = F.exists(marked, lambda x: x["up"]) & F.exists(marked, lambda x: ~x["up"])
    return F.when(mixed, fold).otherwise(marked)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_base``, ``pii_all`` (lists of spans) and ``pii_scores``.

    Null texts count as empty and have no spans. Texts of any length are scanned
    whole. Base spans always stay; added ones need their check and a score of
    LEAST. Spans of one kind never overlap; spans of different kinds may.
    ``pii_scores`` holds one double for each span of ``pii_all``.
    """
    body, patterns = F.col("__pii_text"), {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    possible = {k: F.contains(body, F.lit(c)) for k, c in (("email", "@"), ("phone", "+"), ("ssn", "-"))}
    out = docs.withColumn("__pii_text", F.coalesce(docs[text_col], F.lit("")))
    out = S.with_matches(out, "__pii_text", patterns, possible, "__pii_")
    tails = F.regexp_extract_all(body, F.lit(IBAN), F.lit(1))
    out = held(out, __pii_tails=F.when(F.size("__pii_iban") > 0, tails).otherwise(F.array().cast("array<string>")))
    out = held(out, __pii_iban=whole_ibans(F.col("__pii_iban"), F.col("__pii_tails"))).drop("__pii_tails")
    out = held(out, **{f"__pii_{k}": confirmed(F.col(f"__pii_{k}"), k) for k in KINDS})
    out = held(out, __pii_iban=apart(F.col("__pii_iban")))

    near = {k: f"__pii_{k}__near" for k in KINDS}
    out = held(out, **{n: marks(body, F.col(f"__pii_{k}"), k) for k, n in near.items()})
    out = held(out, **{n: F.reverse(spread(F.col(n), k)) for k, n in near.items()})
    out = held(out, **{n: F.reverse(spread(F.col(n), k)) for k, n in near.items()})

    def scored(kind: str) -> Column:
        both = F.zip_with(
            f"__pii_{kind}",
            near[kind],
            lambda s, m: F.struct(
                *[s[c].alias(c) for c in ("start", "ord", "end", "kind", "body")],
                worth(kind, m["up"], m["down"]).alias("score"),
            ),
        ).cast(SCORED)
        return both if kind in BASE else F.filter(both, lambda s: s["score"] >= LEAST)

    out = held(out, __pii_scored=F.array_sort(F.concat(*[scored(k) for k in KINDS])))
    spans = F.transform("__pii_scored", lambda s: s.dropFields("score")).cast(S.SPANS)
    base = F.array_sort(F.concat(*[F.col(f"__pii_{k}") for k in BASE]))
    out = held(out, pii_base=base, pii_all=spans, pii_scores=F.transform("__pii_scored", lambda s: s["score"]))
    return out.drop("__pii_text", "__pii_scored", *near.values(), *[f"__pii_{k}" for k in KINDS])
