"""Operator 8: secrets, by an Aho-Corasick keyword prefilter, anchored expressions at its hits, and embedded checksums.

One automaton holds the keywords of all kinds. A hexadecimal or digit run of 16 or more has a run of 4 hexadecimal
digits at its start, so all 65,536 of those are keywords too, and for cards one to three digits, a separator and a digit;
nothing can match where no keyword hits. At a hit the
kind's expression is tried at the keyword's start only, and hits inside an earlier match of the kind are passed over,
which gives exactly the leftmost non-overlapping matches of a plain scan.

Base kinds: assign, access, hex. Kinds that the method adds, each with the checksum its tokens embed:
github and npm (six base-62 digits of the body's CRC-32), card (Luhn), iban (mod 97). Where digits or capitals follow a
card or IBAN after a separator, shorter ends are tried: for cards of 13 digits or more, for IBANs of the country's length.

Keywords are looked up in the text with A-Z in lower case; positions are code points.

Defined results: null counts as empty and has no span; texts are scanned whole at any length; of spans that begin together
the kind named first comes first; repeated rows each give a row; an empty table gives none; columns other than id and
text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban")
BASE = 3
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
GITHUB, NPM = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Z0-9])")
#: The registered length of each country's IBANs.
LENGTHS = {
    n: word.split()
    for n, word in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
}
IBANS = {c: re.compile(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])") for n, countries in LENGTHS.items() for c in countries}
COUNTRIES = sorted(IBANS)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def crc62(token: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those after the prefix and before them."""
    value, digits = zlib.crc32(token[4:-6].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == token[-6:]


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def card(text: str, at: int) -> int:
    """The end of the longest card number at a position that Luhn's sum confirms, or 0; it ends where CARD does or at a separator."""
    if m := CARD.match(text, at):
        for end in [m.end(), *(k for k in range(m.end() - 1, at + 12, -1) if text[k] in " -")]:
            if len(digits := re.sub("[ -]", "", text[at:end])) >= 13 and luhn(digits):
                return end
    return 0


def iban(text: str, at: int) -> int:
    """The end of the IBAN at a position, of its country's length or else the longest that fits, or 0."""
    for form in (IBANS.get(text[at : at + 2]), IBAN):
        if form and (m := form.match(text, at)) and mod97(m[0]):
            return m.end()
    return 0


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        found.add_word(word, ("github", 4))
    found.add_word("npm_", ("npm", 4))
    for country, digit in product(COUNTRIES, "0123456789"):
        found.add_word(country.lower() + digit, ("iban", 3))
    for word in map("".join, product("0123456789abcdef", repeat=4)):
        found.add_word(word, ("digits" if word.isdigit() else "hex", 4))
    for n in (1, 2, 3):
        for parts in product(*["0123456789"] * n, " -", "0123456789"):
            found.add_word("".join(parts), ("card", n + 2))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind in the order of KINDS."""
    lower = text.encode().lower().decode()  # bytes: A-Z only, so positions stay
    free = dict.fromkeys(KINDS, 0)
    found = []
    for end, (what, n) in automaton().iter(lower):
        at = end - n + 1
        if what == "assign":
            if at >= free["assign"] and (m := ASSIGN.match(text, at)):
                free["assign"] = m.end()
                if m.end(2) - m.start(2) >= 12:
                    found.append(("assign", at, m.end()))
        elif what in ("hex", "digits", "card"):
            if what != "card" and at >= free["hex"] and (m := HEX.match(text, at)):
                # Where A-F made the keyword hit, the run may begin later; it has keywords of its own then.
                free["hex"] = m.end()
                if m.end() - at >= 16:
                    found.append(("hex", at, m.end()))
            if what != "hex" and at >= free["card"] and not (at and text[at - 1] in "0123456789"):
                if to := card(text, at):
                    free["card"] = to
                    found.append(("card", at, to))
        elif what == "access":
            if at >= free["access"] and (m := ACCESS.match(text, at)):
                free["access"] = m.end()
                if m.end() - at >= 18:
                    found.append(("access", at, m.end()))
        elif what == "iban":
            if at >= free["iban"] and not (at and text[at - 1].isalnum()) and (to := iban(text, at)):
                free["iban"] = to
                found.append(("iban", at, to))
        else:
            form = GITHUB if what == "github" else NPM
            if at >= free[what] and not (at and text[at - 1].isalnum()) and (m := form.match(text, at)) and crc62(m[0]):
                free[what] = m.end()
                found.append((what, at, m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by [kind] of its first."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> DataFrame:
    """(doc_id, spans array<kind, start, end>), with ``clean`` also the redacted text; one row for each row of df."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            columns = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f] for f in found], kind)]
            if clean:
                columns.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "clean"][: len(columns)])

    schema = "doc_id long, spans array<struct<kind string, start long, end long>>" + ", clean string" * clean
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), digest, F.array_join(F.transform("spans", named), ",").alias("spans"))
