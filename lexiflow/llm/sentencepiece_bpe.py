"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of
the piece that they'd form (then by place); the best pair is merged, its
neighbours enter the agenda, and so on until no pair forms a piece. No piece
of a vocabulary that splits at white space goes on after a word with the next
word's mark, so a text falls into chunks (marks, then a word) whose merges
cannot touch each other; each distinct chunk is encoded once for a task and
remembered. Whatever enters that memory is checked, in the Arrow batch where
it first occurs, against the sentencepiece library.

Null and empty texts give no ids and an empty decoded text. Repeated rows and
null ids are kept as they are; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import outside, released, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
NEVER, NONE = 1 << 60, np.iinfo(np.int32).max
#: Chunks of up to so many symbols are merged many at a time.
SHORT = 48
#: Bytes of chunks and ids that a Python worker remembers at most, where each chunk counts ENTRY bytes besides its own.
REMEMBERED, ENTRY = 170_000_000, 250
#: Chunks that it keeps from task to task.
CARRIED = 100_000
#: Texts, and characters of them but for one long text, whose chunks are held at a time.
SLICE, CHARACTERS = 400, 2_000_000


class Vocabulary:
    """Pieces, scores and kinds of a model; pickles to the model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = model
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        kinds = [UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) or sp.is_unused(i) else BYTE if sp.is_byte(i) else NORMAL for i in range(len(self.pieces))]
        self.kinds = kinds
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        place = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in self.ids.values()}))}
        self.order = {p: place[-sp.get_score(i)] for p, i in self.ids.items()}  # 0: the best score
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.pairs()
        # without such pieces the merges of two chunks can't touch
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)

    def __reduce__(self):
        return Vocabulary, (self.model,)

    def chunks(self, text: str) -> list[str]:
        """Marks with the word after them; joined they're the marked text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.chunked else [marked]

    def pairs(self) -> None:
        """A hash table of the pairs of symbols that form a piece, for merge_many.

        Symbols are ids; characters that are in pieces without being one get
        further ids.
        """
        self.symbol = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.symbol[c] = len(self.pieces) + len(self.symbol) - len(self.ids)
        self.of_char = np.full(0x110000, -1, np.int32)  # -1: not a piece
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        get = self.symbol.get
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := get(p[:k])) is not None and (b := get(p[k:])) is not None:
                    found[a << 20 | b] = i
        self.width = max(16, 2 * len(found)).bit_length()
        self.keys, self.formed = np.full(1 << self.width, -1, np.int64), np.zeros(1 << self.width, np.int32)
        keys, formed = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        slots, self.probes = self.slot(keys), 0
        while len(keys):  # of the keys that want a slot, the last one that numpy writes gets it if it was free
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = free & (self.keys[slots] == keys)
            self.formed[slots[placed]] = formed[placed]
            keys, formed, slots = keys[~placed], formed[~placed], (slots[~placed] + 1) & (1 << self.width) - 1
            self.probes += 1
        self.place = np.zeros(len(self.pieces), np.int32)
        for p, i in self.ids.items():
            self.place[i] = self.order[p]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.width)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, the place in the order of scores and the piece; NONE where it forms no piece."""
        keys = a.astype(np.int64) << 20 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slots, piece = self.slot(keys), np.zeros(len(keys), np.int32)
        place = np.full(len(keys), NONE, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slots]
            hit = there == keys
            piece[left[hit]] = self.formed[slots[hit]]
            place[left[hit]] = self.place[self.formed[slots[hit]]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            left, keys, slots = left[go], keys[go], (slots[go] + 1) & (1 << self.width) - 1
        return place, piece

    def merge_many(self, chunks: list[str]) -> list[bytes]:
        """int32 ids of each chunk: in each round every chunk merges the best pair of its own agenda, a row of a matrix."""
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        starts = np.cumsum(lengths) - lengths
        plain = np.minimum.reduceat(flat, starts) >= 0 if len(chunks) else np.zeros(0, bool)
        low = 0
        for high in (6, 12, 20, 32, SHORT):
            rows = np.flatnonzero(plain & (lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(rows, len(rows) // 20_000 + 1):
                self.merge_rows(flat, starts[part], lengths[part], high, part, out)
        for i in np.flatnonzero(~plain | (lengths > SHORT)):
            out[i] = np.array(self.encode_chunk(chunks[i]), "<i4").tobytes()
        return out

    def merge_rows(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, names: np.ndarray, out: list[bytes]) -> None:
        if not len(names):
            return
        at = np.arange(width)
        inside = at < lengths[:, None]
        symbols = np.where(inside, flat[np.minimum(starts[:, None] + at, len(flat) - 1)], -1)
        place, piece = (x.reshape(len(names), -1) for x in self.lookup(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        end = np.full((len(names), 1), NONE, np.int32)
        place, piece = np.hstack([place, end]), np.hstack([piece, end * 0])
        while len(names):
            best = place.argmin(1)
            rows = np.arange(len(names))
            over = place[rows, best] == NONE
            if over.any():
                for n, row, k in zip(names[over], symbols[over], (symbols[over] >= 0).sum(1)):
                    out[n] = row[:k].tobytes()
                names, symbols, place, piece, best = (x[~over] for x in (names, symbols, place, piece, best))
                rows = np.arange(len(names))
                if not len(names):
                    return
            symbols[rows, best] = piece[rows, best]
            take = np.minimum(at + (at > best[:, None]), width - 1)
            symbols, place, piece = (np.take_along_axis(x, take, 1) for x in (symbols, place, piece))
            symbols[:, -1], place[:, -1] = -1, NONE
            for k in (best - 1, best):
                ok = (k >= 0) & (k < width - 1)
                r, c = rows[ok], k[ok]
                place[r, c], piece[r, c] = self.lookup(symbols[r, c], symbols[r, c + 1])

    def merge(self, chunk: str) -> list[str]:
        """The pieces of one chunk: the agenda is a heap, so that n symbols take n log n steps."""
        symbols = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        order, agenda = self.order.get, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := order(symbols[a] + symbols[b], NEVER)) != NEVER:
                heapq.heappush(agenda, (found, a, b, len(symbols[a]) + len(symbols[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, width = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != width:
                continue  # one of the two has been merged since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in self.merge(chunk):
            if (found := self.ids.get(piece)) is not None:
                ids.append(found)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8, marks as spaces; the first mark stays here."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kinds[i] != CONTROL:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)


class Memory(dict):
    """chunk -> int32 ids as bytes; bounded. ``odd``: decoded texts that aren't just the chunk with spaces for marks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.odd, self.wrong, self.size = vocabulary, {}, set(), 0

    def keep(self, n: int) -> None:
        """Forget all but the n chunks that came first: frequent ones come early."""
        if len(self) <= n:
            return
        kept = list(islice(self.items(), n))
        self.clear()
        self.update(kept)
        self.size = sum(len(c) + len(x) + ENTRY for c, x in kept)
        self.odd = {c: t for c, t in self.odd.items() if c in self}
        self.wrong = {c for c in self.wrong if c in self}

    def learn(self, chunks: set[str]) -> None:
        """Encode, decode and remember these; those for which the library gives other ids or another text go to ``wrong``."""
        if self.size > REMEMBERED:
            self.keep(len(self) // 2)
        new = [c for c in chunks if c not in self]
        if not new:
            return
        v = self.vocabulary
        coded = v.merge_many(new)
        self.update(zip(new, coded))
        self.size += sum(map(len, new)) + sum(map(len, coded)) + ENTRY * len(new)
        ids = [np.frombuffer(x, "<i4").tolist() for x in coded]
        texts = list(map(v.decode_ids, ids))
        self.odd |= {c: t for c, t in zip(new, texts) if t != c.replace(MARK, " ")}
        wanted, decoded = v.library.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1), v.library.decode(ids, num_threads=1)
        wrong = {c for c, i, t, w, d in zip(new, ids, texts, wanted, decoded) if len(c) > 1 and (w != i or d != t[1:])}
        self.wrong |= wrong


def memory_of(model: bytes) -> Memory:
    """The memory for this model in this Python worker; later tasks of the worker find it filled."""
    held = sys.__dict__.setdefault("_lexiflow_bpe", {})
    key = hashlib.sha256(model).hexdigest()
    if key not in held:
        held.clear()
        held[key] = Memory(Vocabulary(model))
    return held[key]


def read_model(path: str) -> bytes:
    """The vocabulary file, read by the driver alone; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def coded_slice(memory: Memory, given: list[str | None]) -> pa.StructArray:
    cut = [memory.vocabulary.chunks(t or "") for t in given]
    memory.learn(set().union(*cut))
    odd, wrong, get = memory.odd, memory.wrong, memory.__getitem__
    offsets, parts, texts = [0], [], []
    for chunks in cut:
        parts.append(b"".join(map(get, chunks)))
        offsets.append(offsets[-1] + len(parts[-1]) // 4)
        whole = [odd.get(c, c) for c in chunks] if odd else chunks
        texts.append("".join(whole)[1:].replace(MARK, " "))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
    differ = [sum(c in wrong for c in chunks) if wrong else 0 for chunks in cut]
    return pa.StructArray.from_arrays([ids, pa.array(texts, pa.string()), pa.array(differ, pa.int32())], ["ids", "decoded", "mismatches"])


def sliced(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, some at a time."""
    part: list[str | None] = []
    size = 0
    for x in batch:
        t = x.as_py()
        if part and (len(part) == SLICE or size + len(t or "") > CHARACTERS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def coder(model: bytes):
    """Arrow UDF: text -> struct of ids, decoded text and the number of places where the library differs."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string, mismatches: int>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = memory_of(model)
        for batch in batches:
            for part in sliced(batch):
                yield coded_slice(memory, part)
        memory.keep(CARRIED)
        released()

    return coded.asNondeterministic()  # else a filter on its output would run it twice


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", mismatches: str = "mismatches") -> DataFrame:
    """``docs`` and, for each text, its token ids, the text decoded from them, and the number of places where the library differs.

    Columns of ``docs`` that have one of the three new names are replaced.
    """
    coded = outside(docs, "_coded")
    new = [ids, decoded, mismatches]
    rest = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    return docs.select(*rest, coder(model)(F.col(text).cast("string")).alias(coded)).select(*rest, F.col(f"{coded}.ids").alias(ids), F.col(f"{coded}.decoded").alias(decoded), F.col(f"{coded}.mismatches").alias(mismatches))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every document's ids and decoded text; all of it with production parameters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, read_model(default_model_path()))
    digest = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "mismatches")


def default_model_path() -> str:
    """Where the public 32k vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
