"""Personal data: expressions propose, checksums confirm, context scores
(operator 5).

Base kinds are email, ip, card and phone; the method adds ``iban`` (ISO 7064
mod-97), ``ssn`` and ``pan`` (a card number standing inside a longer run of
digit groups that fails as a whole).  Every span has a score: a start value
for its kind, raised by words of that kind nearby and lowered by words that
tell of other numbers.  Base spans always stay; added ones need
``LEAST_SCORE``.

Built from DataFrame functions throughout.  Offsets are code points, end
exclusive; repeats are possessive or guarded, so long runs of one character
class take linear time.

Defined results: null text counts as empty and has no spans; repeated rows
are scanned alike; an empty table gives an empty result; columns other than
``text`` pass through (``pii_spans`` is replaced).  Redaction leaves null
texts null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, in_blocks, let, listed

CONTEXT = 48                    # characters looked at on each side
LEAST_SCORE = 0.5

# The base expressions.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds.
# ISO 13616 lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_regex() -> str:
    """A number of a listed country ends at its country's length, whatever
    follows behind a blank; else the longest run of groups that ends with a
    word, else the longest run."""
    def run(n):
        return rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    listed = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{run(n)}" for n, c in IBAN_LENGTHS.items())
    other = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    end = "(?![A-Za-z0-9])"
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{listed}){end}|{other}{end}|{other})"


IBAN = _iban_regex()
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PAN = r"[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn", "pan")
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "pan": 0.6}
_CARD_WORDS = "(?i)(card|visa|mastercard|amex|credit|karte|carte|tarjeta)"
NEAR = {
    "email": "(?i)(mail|contact|correo|courriel)",
    "ip": "(?i)(host|server|address|adresse|client)",
    "card": _CARD_WORDS,
    "phone": "(?i)(phone|mobile|call|telefon|téléphone|teléfono)",
    "iban": "(?i)(iban|account|bank|konto|compte|cuenta)",
    "ssn": "(?i)(ssn|social|security|insurance)",
    "pan": _CARD_WORDS,
}
OTHER = "(?i)(version|order|invoice|isbn|serial|bestellung|commande|pedido)"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 mod-97: letters count 10 to 35, the first four go last."""
    s = F.regexp_replace(iban, r"\x20", "")
    turned = F.split(F.concat(s.substr(F.lit(5), F.length(s)), F.substring(s, 1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).when(
        c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))
    return rest == 1


def small_parts(ip: Column) -> Column:
    """Every dotted part is at most 255, leading zeros aside."""
    return F.forall(F.split(ip, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (
        (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))


def _scored(spans: Column, kind: str) -> Column:
    def one(s):
        near = F.concat_ws(" ", s["before"], s["after"])
        score = (F.lit(START[kind]) + F.when(near.rlike(NEAR[kind]), 0.3).otherwise(0.0)
                 - F.when(near.rlike(OTHER), 0.2).otherwise(0.0))
        return F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"),
                        s["end"].alias("end"), s["text"].alias("text"),
                        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score"))
    return F.transform(spans, one)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_spans``: (kind, rank, start, end, text, score)."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "pii_spans"]
    base = docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    t = F.col("_text")
    rank = {k: i for i, k in enumerate(KINDS)}

    def found(kind, regex, ok, guard=None):
        spans = find_spans(t, kind, rank[kind], regex, context=CONTEXT, guard=guard)
        return F.filter(spans, lambda s: ok(s["text"])) if ok else spans

    n = lambda x: F.length(digits_of(x))                                   # noqa: E731
    base = base.withColumns({
        "_email": _scored(found("email", EMAIL, None, t.contains("@")), "email"),
        "_ip": _scored(found("ip", IP, small_parts, t.contains(".")), "ip"),
        # only runs of 13 digits and more can pass
        "_card": _scored(found("card", CARD, lambda x: n(x).between(13, 19) & luhn_ok(digits_of(x)),
                               t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), "card"),
        "_phone": _scored(found("phone", PHONE, lambda x: n(x).between(9, 15), t.contains("+")), "phone"),
        "_iban": _scored(found("iban", IBAN, mod97_ok), "iban"),
        "_ssn": _scored(found("ssn", SSN, None, t.contains("-")), "ssn"),
        "_pan": _scored(found("pan", PAN, lambda x: luhn_ok(digits_of(x)),
                              t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), "pan"),
    })
    inside = lambda s, whole: F.exists(                                    # noqa: E731
        whole, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    sure = lambda c: F.filter(F.col(c), lambda s: s["score"] >= LEAST_SCORE)
    return base.select("row.*", F.concat(
        *[F.col(f"_{k}") for k in BASE_KINDS], sure("_iban"), sure("_ssn"),
        F.filter(sure("_pan"), lambda s: ~inside(s, F.col("_card")))).alias("pii_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Texts with every span replaced by its kind in brackets (overlapping
    spans by the first kind); ``n_chars`` follows when present."""
    entry = "struct<from:int,start:int,kind:string>"
    text = F.col("text")

    def place(acc, s):
        # text goes on behind everything seen so far; a span that begins before is covered
        kept = F.struct(acc["pos"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.when(s["start"] >= acc["pos"], F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out"))

    def place_block(acc, spans):
        done = F.aggregate(spans, F.struct(acc["pos"].alias("pos"), F.expr(f"CAST(array() AS array<{entry}>)").alias("out")), place)
        return let(done, lambda d: F.struct(d["pos"].alias("pos"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def written(block):
        base = F.element_at(block, 1)["from"]
        chunk = F.substr(text, base + 1, F.element_at(block, -1)["start"] - base)      # one cut of the text a block
        return let(chunk, lambda c: F.array_join(F.transform(block, lambda e: F.concat(
            F.substr(c, e["from"] - base + 1, e["start"] - e["from"]), F.lit("["), F.upper(e["kind"]), F.lit("]"))), ""))

    spans = F.sort_array(F.transform("pii_spans", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = let(spans, lambda s: F.aggregate(
        in_blocks(s), F.struct(F.lit(0).alias("pos"), F.expr(f"CAST(array() AS array<array<{entry}>>)").alias("out")), place_block,
        lambda a: F.concat(F.array_join(F.transform(F.filter(a["out"], lambda b: F.size(b) > 0), written), ""), F.substr(text, a["pos"] + 1))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    changed = F.col("text").isNotNull() & (F.size("pii_spans") > 0)
    marked = scan(docs.select(row, "text")).select("row", changed.alias("changed"), F.when(changed, done).otherwise(text).alias("new"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return marked.select(*[v.alias(c) for c, v in out.items()])


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans as text."""
    s, order = F.col("pii_spans"), ["rank", "start"]
    of = lambda *kinds: F.filter(s, lambda x: x["kind"].isin(*kinds))      # noqa: E731
    return scanned.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of(*BASE_KINDS), order), 256).alias("base_sha256"),
        listed(s, order).alias("spans"))
