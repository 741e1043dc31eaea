"""Scalar functions on text that built-ins don't have, as Arrow functions, and those that they do, as columns."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: kana by code point
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
SMALL = "ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ"
JOINERS = " \t\r\n　・･-‐‑‒–—―"
KANJI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}々〆]"
KANA = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]"


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in b.to_pylist()], pa.string())


def normalized_form(s: Column) -> Column:
    """NFKC without spaces, middle dots and dashes."""
    return F.translate(nfkc(s), JOINERS, "")


def to_katakana(s: Column) -> Column:
    return F.translate(s, HIRAGANA, KATAKANA)


def to_hiragana(s: Column) -> Column:
    return F.translate(s, KATAKANA, HIRAGANA)


def normalized_reading(s: Column) -> Column:
    return to_katakana(normalized_form(s))


def form_identity(s: Column) -> Column:
    """Forms that are all kana count as hiragana; others stay as they are."""
    n = normalized_form(s)
    return F.when(is_kana(n), to_hiragana(n)).otherwise(n)


def is_kana(s: Column) -> Column:
    return s.rlike(f"^(?:{KANA}|ー)+$")


def has_kanji(s: Column) -> Column:
    return s.rlike(KANJI)


def is_han(s: Column) -> Column:
    """All of it ideographs of the three main blocks: the rule for forms of entries."""
    return s.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+$")


def is_kana_form(s: Column) -> Column:
    """All of it kana of both blocks, with the small ones for other languages: the rule for forms of entries."""
    return s.rlike(r"^[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]+$")


def is_kana_query(s: Column) -> Column:
    """At least one kana, and nothing but kana, long marks, dots and hyphens: the rule for what is asked."""
    return s.rlike(r"^[\x{3041}-\x{30FF}ー・-]+$") & s.rlike(r"[\x{3041}-\x{30FA}]")


def morae(reading: Column) -> Column:
    """A small kana belongs to the one before it."""
    return F.regexp_extract_all(reading, F.lit(f"(.[{SMALL}]?)"), 1)


def kanji_readings(word: Column, reading: Column) -> Column:
    """Array of (kanji, reading) where kanji and morae pair up: one kanji takes all, two take 2 each of 4, three 2 each of 6; else empty."""
    k, m = F.split(word, ""), morae(reading)
    n = F.size(k)
    per = F.when(n == 1, F.size(m)).otherwise(F.lit(2))
    fits = word.rlike(f"^{KANJI}{{1,3}}$") & ((n == 1) | (F.size(m) == 2 * n)) & (F.size(m) > 0)
    pairs = F.transform(k, lambda c, i: F.struct(c.alias("kanji"), F.array_join(F.slice(m, (i * per + 1).cast("int"), per.cast("int")), "").alias("reading")))
    return F.when(fits, pairs).otherwise(F.array().cast("array<struct<kanji:string,reading:string>>"))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(s)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def inline_spaces(s: Column) -> Column:
    """Runs of white space become one space between ASCII letters and digits and nothing elsewhere; an ellipsis becomes three dots."""
    kept = F.regexp_replace(s, r"(?<=[A-Za-z0-9])\s+(?=[A-Za-z0-9])", "\u0001")
    return F.replace(F.regexp_replace(F.replace(kept, F.lit("…"), F.lit("...")), r"\s+", ""), F.lit("\u0001"), F.lit(" "))


def bound_template(template: Column, captures: Column) -> Column:
    """``{{name}}`` replaced from a map; null if a name is missing."""
    out = F.aggregate(F.map_entries(captures), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    return F.when(~out.contains("{{"), out)


def tags(raw: Column) -> Column:
    """At most 12 tags without ``#``, of at most 24 characters, the first of each spelling."""
    clean = F.filter(F.transform(raw, lambda t: F.substring(F.regexp_replace(F.trim(t), "^#+", ""), 1, 24)), lambda t: t != "")
    first = F.filter(clean, lambda t, i: ~F.exists(F.slice(clean, 1, i), lambda o: F.lower(o) == F.lower(t)))
    return F.slice(first, 1, 12)


@F.arrow_udf(T.StringType())
def canonical_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sorted keys and no spaces; null for what isn't JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    for b in batches:
        yield pa.array([one(x) for x in b.to_pylist()], pa.string())


def json_changes(before, after, path: str = "") -> list[tuple[str, str | None, str | None]]:
    """(pointer, before, after) of the parts that differ. Lists of objects with unique ids are compared by id, others as a whole."""
    show = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted(before.keys() | after.keys()):
            p = path + "/" + k.replace("~", "~0").replace("/", "~1")
            if k not in before:
                out.append((p, None, show(after[k])))
            elif k not in after:
                out.append((p, show(before[k]), None))
            else:
                out += json_changes(before[k], after[k], p)
        return out
    if isinstance(before, list) and isinstance(after, list):
        keyed = [{str(x["id"]): x for x in xs if isinstance(x, dict) and "id" in x} for xs in (before, after)]
        if len(keyed[0]) == len(before) and len(keyed[1]) == len(after) and (before or after):
            return json_changes(*keyed, path)
    # True equals 1 in Python, not in JSON
    return [] if show(before) == show(after) else [(path or "/", show(before), show(after))]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "before", "after")])))
def json_diff(befores: pa.Array, afters: pa.Array) -> pa.Array:
    rows = [json_changes(*(json.loads(x or "null") for x in pair)) for pair in zip(befores.to_pylist(), afters.to_pylist())]
    return pa.array([[dict(zip(("path", "before", "after"), r)) for r in row] for row in rows], pa.list_(pa.struct([(n, pa.string()) for n in ("path", "before", "after")])))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("a0", "a1", "b0", "b1")])))
def opcodes(before: pa.Array, after: pa.Array) -> pa.Array:
    """Edits between two arrays of strings."""
    kind = pa.list_(pa.struct([("tag", pa.string()), *((n, pa.int32()) for n in ("a0", "a1", "b0", "b1"))]))
    pairs = zip(before.to_pylist(), after.to_pylist())
    return pa.array([[dict(zip(("tag", "a0", "a1", "b0", "b1"), o)) for o in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes()] for a, b in pairs], kind)


#: Characters of prepared texts that Python holds at once, or else one text's.
PREPARED = 500_000
_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f々〆"
#: A run of kanji from its first one on, so that each run is read once.
_RUBY = re.compile(f"(?<![{_HAN}])([{_HAN}]++)《([ぁ-ゟ゠-ヿ]+)》")
_PREPARED = T.StructType([T.StructField("text", T.StringType()), T.StructField("ruby", T.ArrayType(T.StructType([T.StructField("base", T.StringType()), T.StructField("reading", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


@F.arrow_udf(_PREPARED)
def prepared(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text without ruby, and each annotation: the run of kanji before 《kana》 and its place. Anything else in 《》 stays."""
    def made(texts: list[str], words: list[list[str]], places: list[np.ndarray]) -> pa.Array:
        bases, readings = (pa.array([x for w in ws for x in w], pa.string()) for ws in (words[0::2], words[1::2]))
        starts, ends = (pa.array(np.concatenate([np.zeros(0, np.int32), *ps]), pa.int32()) for ps in (places[0::2], places[1::2]))
        offsets = pa.array(np.cumsum([0, *map(len, words[0::2])]), pa.int32())
        ruby = pa.StructArray.from_arrays([bases, readings, starts, ends], ["base", "reading", "start", "end"])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(offsets, ruby)], ["text", "ruby"])

    for b in batches:
        texts, words, places, held = [], [], [], 0
        for t in b:
            x = t.as_py() or ""
            parts = _RUBY.split(x)  # what lies between, base and reading in turn
            words += [parts[1::3], parts[2::3]]
            del parts[2::3]
            texts.append("".join(parts))
            ends = np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)), dtype=np.int32)
            places += [ends[0:-1:2], ends[1::2]]
            held += len(x)
            if held >= PREPARED:
                yield made(texts, words, places)
                texts, words, places, held = [], [], [], 0
        yield made(texts, words, places)


def without_images(s: Column) -> Column:
    """Markdown images go."""
    return F.regexp_replace(s, r"!\[[^\]]*\]\([^)]*\)", "")


# fixed values: marks of senses
CIRCLED = "①②③④⑤⑥⑦⑧⑨"
PLACEHOLDERS = "―～〜"


def definition_note(s: Column) -> Column:
    """What stands in brackets at the end of a definition; null without it."""
    return F.nullif(F.regexp_extract(s, r"（([^（）]*)）\s*$", 1), F.lit(""))


def cleaned_definition(s: Column, headword: Column) -> Column:
    """A definition without the note at its end, with the headword for its placeholders, and with plain numbers for circled ones."""
    body = F.trim(F.regexp_replace(s, r"（[^（）]*）\s*$", ""))
    numbered = F.translate(body, CIRCLED, "123456789")
    return F.replace(F.translate(numbered, PLACEHOLDERS, PLACEHOLDERS[0] * len(PLACEHOLDERS)), F.lit(PLACEHOLDERS[0]), headword)


def plain_inline(s: Column, depth: int = 4) -> Column:
    """Text without inline Markdown and tags: emphasis, code, links and images give their text, up to ``depth`` of them within each other; then entities are decoded."""
    out = without_images(s)
    for _ in range(depth):
        out = F.regexp_replace(out, r"\[([^\[\]]*)\]\([^()]*\)", "$1")
        out = F.regexp_replace(out, r"(\*\*|__|~~)([^*_~]+)\1", "$2")
        out = F.regexp_replace(out, r"(\*|_|`)([^*_`]+)\1", "$2")
    out = F.regexp_replace(out, r"</?[A-Za-z][^<>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def lookup_target(unit: Column, formation: Column, head: Column, surface: Column, functional: Column) -> Column:
    """What to look up for a token: its lexical unit, else the head of its formation, else its head word; a functional word's own surface."""
    return F.when(functional, surface).otherwise(F.coalesce(F.nullif(unit, F.lit("")), F.nullif(formation, F.lit("")), F.nullif(head, F.lit("")), surface))


def headword_parts(s: Column) -> Column:
    """Struct of reading and forms of ``かな【表記・別表記】``; editorial marks go, each form once in its order; without brackets the word is its own form and reading."""
    inner = F.regexp_extract(s, "【([^】]*)】", 1)
    clean = lambda c: F.regexp_replace(c, r"[▽▼△×〈〉《》\s‐-]", "")
    reading = clean(F.regexp_replace(s, "【.*$", ""))
    forms = F.array_distinct(F.filter(F.transform(F.split(inner, "[・，,]"), clean), lambda f: f != ""))
    return F.struct(reading.alias("reading"), F.when(F.size(forms) > 0, forms).otherwise(F.array(reading)).alias("forms"))


def expanded_form(s: Column) -> Column:
    """Spellings of a form: alternatives between dots if each has a kanji, and with and without kana in brackets."""
    trimmed = F.trim(s)
    parts = F.split(trimmed, "・")
    parts = F.when((F.size(parts) > 1) & F.forall(parts, has_kanji), parts).otherwise(F.array(trimmed))
    optional = r"^([^（]*)（([\x{3041}-\x{30FF}]+)）(.*)$"
    each = F.transform(parts, lambda p: F.when(p.rlike(optional), F.array(F.regexp_replace(p, optional, "$1$2$3"), F.regexp_replace(p, optional, "$1$3"))).otherwise(F.array(p)))
    return F.filter(F.array_distinct(F.flatten(each)), lambda p: p != "")


def despaced_title(s: Column) -> Column:
    """A title without the spaces between characters that aren't ASCII."""
    return F.trim(F.regexp_replace(s, r"(?<=[^\x00-\x7F])[\s\x{3000}]+(?=[^\x00-\x7F])", ""))


def heading_key(s: Column) -> Column:
    """A title for comparison: lower case, without spaces and punctuation."""
    return F.regexp_replace(F.lower(s), r"[\s\x{3000}\p{P}]+", "")


def is_chapter_title(s: Column) -> Column:
    """Whether a heading counts chapters, or names a part that has no number."""
    return F.coalesce(heading_key(s).rlike(r"^(第[0-9一二三四五六七八九十百]+[章話部巻]|chapter[0-9ivxlc]+|part[0-9ivxlc]+|prologue|epilogue|序章|終章|あとがき)"), F.lit(False))


def merged_unique(*lists: Column) -> Column:
    """Lists after each other, each value once, in the order in which it first comes."""
    return F.array_distinct(F.concat(*lists))


def cjk_evidence(s: Column) -> Column:
    """Struct of language, han, kana and hangul: Japanese with kana, Korean with hangul, Chinese with han alone; undetermined without any, or where most letters are others."""
    han, kana, hangul = (F.regexp_count(s, F.lit(p)) for p in (r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]", r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]", r"[\x{AC00}-\x{D7AF}]"))
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    own = han + kana + hangul
    language = F.when((own == 0) | (own * 2 < letters), "und").when((kana >= hangul) & (kana > 0), "ja").when(hangul > 0, "ko").otherwise("zh")
    return F.struct(language.alias("language"), han.alias("han"), kana.alias("kana"), hangul.alias("hangul"))
