"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Fixed patterns (kinds assign, access, hex) are found leftmost and without
overlaps for each kind; matches that are too short are dropped afterwards, so
that they still hide what lies inside them.

The novelty method adds spans of kind ``novel``. A candidate is an unbroken
string of 16 or more characters with a letter and a digit, after a word that
speaks of credentials. Its novelty is the number of bytes by which it lengthens
the compressed form of the text around it, divided by its own length or, if
that is less, by what random strings of its alphabet and length would add in
the same place: long ones, and those of few different characters, are packed
more tightly although they're random. The compressor is primed with a
dictionary of common identifiers. Strings that repeat identifiers or the code
around them compress well; a candidate of ``NOVELTY`` or more is reported unless
it overlaps a span of a fixed pattern.

Offsets are code points, end exclusive. Null and empty texts hold no secret.
Texts are read whole, whatever their length. Repeated rows and null ids are
scanned like others; extra columns pass through.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import outside, released, table

# fixed values: kinds in their order, patterns, least lengths
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
# fixed values: words that speak of credentials
SENSITIVE = ("auth", "bearer", "cookie", "credential", "key", "passphrase", "passw", "passwd", "private", "pwd", "secret", "session", "signature", "token")
# fixed values: identifiers that prime the compressor
IDENTIFIERS = (
    "access account address admin allow api app args array async auth await base64 bearer begin body bool break buffer build bytes cache call callback char class client code column config connect const "
    "content context continue cookie count create credential data database date debug decode def default delete digest double else email encode encrypt endpoint env error event example exception export "
    "extends false fetch field file filter final float for format from function get global handler hash header host html http https id if implements import index init input insert instance int integer "
    "interface json key label lambda length level lib library limit list load local log login long main map match message method mode model module name namespace new null number object offset open option "
    "output package param parse password path payload pattern port post prefix print private process property protected public query read record redirect refresh register release request reset resource "
    "response result return role root route row save schema scope script secret section select self send server service session set sha256 signature size source sql start state static status stop storage "
    "str stream string struct super switch system table tag target test text throw time timestamp title token true try type unicode update upload uri url user username uuid value var version view void "
    "while width window with write xml yaml your_api_key_here changeme placeholder 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}", re.ASCII)
#: Characters before a candidate in which a sensitive word counts; characters on either side that the compressor sees.
BEFORE, AROUND, PREAMBLE = 48, 512, 200
NOVELTY = 0.9
# fixed values: alphabets of random strings, the narrowest first; how many of them a candidate is compared with
ALPHABETS = tuple(map(frozenset, ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567", *(string.digits + x for x in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters)))))
RANDOM = 4


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_strings(s: str) -> list[str]:
    """``RANDOM`` strings as long as ``s``, of the narrowest alphabet that has its letters and digits, with the signs that ``s`` has; the same ones for the same alphabet and length."""
    own = set(s)
    signs = {c for c in own if not c.isalnum()}
    letters = sorted(next(a for a in ALPHABETS if own - signs <= a) | signs)
    r = random.Random(len(s))
    return ["".join(r.choices(letters, k=len(s))) for _ in range(RANDOM)]


class Novelty:
    """Marginal compressed bytes of a candidate."""

    def __init__(self) -> None:
        import zstandard

        primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda b, c=zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False, write_checksum=False): len(c.compress(b))

    def of(self, text: str, start: int, end: int) -> float:
        # the first identifiers keep zstd from storing a short text as it is
        around = (IDENTIFIERS[:PREAMBLE] + text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND] + "\n").encode("utf-8", "replace")
        plain, own = self.size(around), text[start:end]
        added = self.size(around + own.encode()) - plain
        if added >= NOVELTY * len(own):
            return added / len(own)
        usual = sum(self.size(around + x.encode()) - plain for x in random_strings(own)) / RANDOM
        return added / min(len(own), usual)

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        low = text.lower()
        if not any(w in low for w in SENSITIVE):
            return []
        out = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in ".=-~":
                b -= 1  # what ends a sentence isn't part of it
            s = text[a:b]
            if b - a < 16 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                continue
            if not any(w in text[max(0, a - BEFORE) : a].lower() for w in SENSITIVE):
                continue
            if any(x < b and a < y for x, _, y in taken):
                continue
            if self.of(text, a, b) >= NOVELTY:
                out.append((a, 3, b))
        return out


def scanner():
    """Arrow UDF: text -> array of (kind, start, end), by start, then kind."""

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty()
        made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for k in range(0, len(batch), 500):
                out = []
                for text in batch.slice(k, 500):
                    t = text.as_py() or ""
                    base = fixed_spans(t)
                    spans = sorted(base + novelty.spans(t, base))
                    out.append([{"kind": KINDS[kind], "start": a, "end": b} for a, kind, b in spans])
                yield pa.array(out, made)
        released()

    return scanned.asNondeterministic()  # else a filter on its output would run it twice


def scan(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """``docs`` with the spans found in each whole text; a column of that name is replaced."""
    rest = [c for c in docs.columns if c.lower() != secrets.lower()]
    return docs.select(*rest, scanner()(F.col(text).cast("string")).alias(secrets))


def redacted(text: Column, secrets: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]
        kept = F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("[SECRET]")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(inside, s["parts"]).otherwise(kept).alias("parts"))

    whole = F.aggregate(secrets, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, whole).otherwise(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = joined(F.filter("secrets", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), number("novel").alias("n_novel"))
