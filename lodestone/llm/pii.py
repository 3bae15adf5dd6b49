"""Personal data and secrets: patterns propose spans, validators confirm them, context words move their score.

The base kinds (email, ip, card, phone) are found by their patterns alone, leftmost and non-overlapping within a kind, and
always stay. The method adds kinds that need more than a pattern: iban and nir (mod-97), dni (mod-23), imei (Luhn), aba (a weighted
sum mod 10), ssn (a valid number) and secret (a value that is assigned to a telling name, or has a provider's form, or is a long
hexadecimal number, with the entropy of a random string). Words nearby that name a kind raise the score of its spans, words that
speak against it lower it; added spans stay from LEAST on. Every pattern reads a text in linear time, whatever it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, with_fields

BASE_KINDS, MORE_KINDS = ("email", "ip", "card", "phone"), ("iban", "nir", "dni", "imei", "aba", "ssn", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Patterns begin with a class of characters, which the engine skips to, and look back from there. Of a run of digits only its start
#: can begin an address.
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: At every place where one may start, the longest proposal; it may run into the words that follow, and over the start of another.
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))")
IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
#: Characters of an IBAN by its country.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
        26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
SSN = re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NIR = re.compile(r"[12](?<![0-9].) ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
DNI = re.compile(r"[0-9](?<![A-Za-z0-9].)[0-9]{7}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
IMEI, ABA = (re.compile(rf"[0-9](?<![0-9.+-].)[0-9]{{{n}}}(?![0-9.-])") for n in (14, 8))
NOT_DIGIT = re.compile(r"[^0-9]+")
#: An assignment and its value, and a name before it that tells of a secret.
ASSIGNED = re.compile(r"[:=][=>]?[ \t]{0,3}[\"']?([A-Za-z0-9+/_.~!@#$%^&*-]{8,}+={0,2})")
NAMED = re.compile(r"(?i)(?<![A-Za-z])(?:(?:api|access|secret|client|auth|private|session|signing)[ _-]?)?(?:key|secret|token|password|passwd|passwort|contraseña|pwd|credential)s?[\"']?[ \t]{0,3}\Z")
NAME_CHARS = 48
#: Forms that providers give their secrets.
PROVIDED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_-]{20,}+|[rs]k_live_[A-Za-z0-9]{16,}+"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
)
PROVIDED_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "k_live_", "xox", "AIza", "-----BEGIN")
#: Web tokens: parts between dots of which two begin so, and their least length. Every run of parts is read once.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
TOKEN_PART, TOKEN_START = 11, re.compile(r"(?<![A-Za-z0-9])eyJ")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f](?<![A-Za-z0-9].)(?:(?<![A-F])[0-9a-f]{31,}+|(?<![a-f])[0-9A-F]{31,}+)(?![A-Za-z0-9])")
#: Bits that a character of a secret must tell at least, on average over the value.
LEAST_ENTROPY = 2.5

#: Score of a confirmed span, what a context word within NEAR code points before or after adds or takes, and the words.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "nir": 0.6, "dni": 0.4, "imei": 0.3, "aba": 0.3, "ssn": 0.3, "secret": 0.9}
#: A hexadecimal number alone may be any digest.
HEX_SCORE = 0.3
CONTEXT_MOVES, NEAR, LEAST = 0.2, 40, 0.5
CONTEXT = {
    "email": r"e-?mails?|mail|contact|kontakt|contacto|write|correo|courriel|adresse",
    "ip": r"ips?|ipv4|address|adresse|dirección|server|serveur|servidor|host|client|login|gateway",
    "card": r"cards?|credit|debit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta|cvv",
    "phone": r"phone|call|tel|telephone|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil|whatsapp",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta|überweisung|virement",
    "nir": r"nir|insee|sécu|sociale|sécurité",
    "dni": r"dni|nif|documento|identidad|identificación",
    "imei": r"imei|device|handset|gerät|appareil|dispositivo",
    "aba": r"aba|routing|rtn|wire|ach",
    "ssn": r"ssn|social|security|taxpayer",
    "secret": r"keys?|tokens?|secrets?|passwords?|credentials?|auth|authorization|bearer|api|passwort|clé|clave",
}
AGAINST = {
    "email": r"example|noreply|no-reply",
    "ip": r"version|release|section|chapter|kapitel|chapitre|capítulo",
    "card": r"order|tracking|isbn|serial|invoice",
    "phone": r"order|isbn|serial|invoice|reference",
    "iban": r"serial|part",
    "nir": r"serial|part|order",
    "dni": r"serial|part|order",
    "imei": r"order|tracking|isbn|invoice",
    "aba": r"order|tracking|isbn|invoice|serial|part",
    "ssn": r"order|tracking|isbn|serial|part|phone",
    "secret": r"commit|revision|checksum|sha1|sha256|md5|digest|example|placeholder",
}
_CONTEXT, _AGAINST = ({k: re.compile(rf"(?<!\w)(?:{x})(?!\w)") for k, x in table.items()} for table in (CONTEXT, AGAINST))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN: its first four characters moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each proposal, leftmost first, the part up to the end of a word that has its country's length and that mod-97 confirms;
    for a country without a known length the longest that mod-97 confirms."""
    done = 0
    for m in IBAN.finditer(text):
        start, end = m.span(1)
        n = IBAN_LENGTH.get(text[start : start + 2])
        while start >= done and end > start:
            if (n is None or n == len(text[start:end].replace(" ", ""))) and mod97(text[start:end]):
                yield start, end
                done = end
            else:
                end = text.rfind(" ", start, end)


def entropy(text: str) -> float:
    """Bits a character tells, by the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _random(value: str) -> bool:
    """Whether a value looks drawn and not written: letters and digits, or digits and signs, with LEAST_ENTROPY."""
    return any(c.isdigit() for c in value) and not value.isdigit() and entropy(value) >= LEAST_ENTROPY


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three parts of a dotted run, the first two with the start of an encoded object; the first may have something before it, up to a sign."""
    for m in DOTTED.finditer(text):
        parts, at, done = m[0].split("."), m.start(), m.start()
        for i, part in enumerate(parts[:-2]):
            head = TOKEN_START.search(part)
            if head and at >= done and len(part) - head.start() >= TOKEN_PART <= len(parts[i + 1]) and parts[i + 1].startswith("eyJ") and len(parts[i + 2]) >= 8:
                done = at + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                yield at + head.start(), done
            at += len(part) + 1


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the values, leftmost first, not overlapping; of two that start together the one of the higher score."""
    found = [(*m.span(), SCORE["secret"]) for m in PROVIDED.finditer(text)] if any(x in text for x in PROVIDED_PARTS) else []
    found += [(a, z, SCORE["secret"]) for a, z in web_tokens(text)] if "eyJ" in text else []
    if "=" in text or ":" in text:
        found += [(*m.span(1), SCORE["secret"]) for m in ASSIGNED.finditer(text) if _random(m[1]) and NAMED.search(text, max(0, m.start() - NAME_CHARS), m.start())]
    found += [(*m.span(), HEX_SCORE) for m in HEXADECIMAL.finditer(text) if _random(m[0])]
    done = 0
    for a, z, score in sorted(found, key=lambda x: (x[0], -x[2], -x[1])):
        if a >= done:
            yield a, z, score
            done = z


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern of local part, @ and dotted domain finds them; each @ looks back over its own local part only."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _scored(text: str, kind: str, start: int, end: int, score: float | None = None) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    moves = bool(_CONTEXT[kind].search(near)) - bool(_AGAINST[kind].search(near))
    return round(min(1.0, max(0.0, (SCORE[kind] if score is None else score) + CONTEXT_MOVES * moves)), 3)


def _small(part: str) -> bool:
    """Whether an address's part is at most 255, however many zeros it begins with."""
    digits = part.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and int(digits) <= 255)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    found: list[tuple[str, int, int]] = [("email", *x) for x in emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    rows = [(k, a, z, _scored(text, k, a, z)) for k, a, z in found]
    more = [("iban", *x) for x in ibans(text)] if IBAN_HEAD.search(text) else []
    more += [("nir", *m.span()) for m in NIR.finditer(text) if int((d := m[0].replace(" ", ""))[:13]) % 97 == 97 - int(d[13:])]
    more += [("dni", *m.span()) for m in DNI.finditer(text) if m[0][-1] == DNI_LETTERS[int(m[0][:8]) % 23]]
    more += [("imei", *m.span()) for m in IMEI.finditer(text) if luhn(m[0])]
    more += [("aba", *m.span()) for m in ABA.finditer(text) if sum(int(c) * w for c, w in zip(m[0], (3, 7, 1) * 3, strict=True)) % 10 == 0]
    more += [("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    added = [(k, a, z, _scored(text, k, a, z)) for k, a, z in more] + [("secret", a, z, _scored(text, "secret", a, z, x)) for a, z, x in secrets(text)]
    return rows + [x for x in added if x[3] >= LEAST]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z, *_ in spans)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs as they are, with out_col: array of (kind, start, end, score, base), by kind as listed and then start.

    Whole texts are read; a null or empty one has no spans. One row per input row, repeated ones too; an empty table gives an empty
    one. A column of docs named out_col is replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]
    schema = with_fields(docs, f"`{out_col}` array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score", "base"), (*x, x[0] in BASE_KINDS), strict=True)) for x in find_spans(t or "")] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.struct(fields)))], [*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; of overlapping spans the first, and of
    those with one start the longest, is replaced. Null stays null, and an empty table empty."""
    bound_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for k, a, z, _ in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
            if a >= done:
                out += [text[done:a], f"<{k}>"]
                done = z
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, text_col, pa.array(map(clean, b.column(at).to_pylist()), b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n_of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text_of(F.filter("pii", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        n_of("secret").alias("n_secret"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
