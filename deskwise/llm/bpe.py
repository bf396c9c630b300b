"""BPE encoding and decoding in numpy: merge rounds over the symbols of many words at once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from tokenizers import Regex, normalizers, pre_tokenizers

from deskwise.llm.blocks import blocks, ragged
from deskwise.llm.vocab import Vocabulary, load

# The contractions at which the vocabulary's words are cut, and Unicode white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = "[\t-\r \x85\xa0  -     　]+"

MARK = " "  # in front of a special token; no chunk of a text begins with white space
NEVER = np.iinfo(np.int64).max
BASIC = 0xFFFF  # the last code point of 16 bits


def _ranges(members: list[tuple[int, int]], top: int) -> str:
    """Inside of a character set from ranges of code points, both ends included, up to ``top``."""
    return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in members if a <= top)


@dataclass(frozen=True)
class Characters:
    """Patterns for texts within ASCII, within 16 bits, and any: a set of characters beyond 16 bits is searched range by range.

    ``words``: contractions, runs of letters, single numbers, runs of anything else but white space. ``apart``: characters to
    normalise by the library (never in ASCII).
    """

    words: tuple[re.Pattern, re.Pattern, re.Pattern]
    apart: tuple[re.Pattern, re.Pattern]


@lru_cache(maxsize=1)
def characters() -> Characters:
    """Which characters are letters, numbers and white space is asked of the vocabulary's library, once for all code
    points, since versions of Unicode differ. To normalise apart are those that :mod:`unicodedata` doesn't
    know, and the marks that it puts in another order than the library.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]

    def members(kind: str, step: int = 1 << 13) -> list[tuple[int, int]]:
        split, found = pre_tokenizers.Split(Regex(kind), "removed", invert=True), []
        for at in range(0, len(points), step):  # the library keeps much beside a long text
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, points[at : at + step]))):
                found.append((points[at + a], points[at + b - 1]))
        return found

    unknown = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    marks = {unicodedata.combining(chr(c)): chr(c) for c in reversed(points) if unicodedata.combining(chr(c))}
    nfc = normalizers.NFC()
    for mark in (chr(c) for c in points if unicodedata.combining(chr(c))):
        trial = "\n".join(f"{mark}{other}\n{other}{mark}" for other in marks.values())
        unknown[ord(mark)] = nfc.normalize_str(trial) != unicodedata.normalize("NFC", trial)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], unknown, [False])).astype(np.int8))).reshape(-1, 2)
    kinds = [members(k) for k in (r"\p{L}+", r"\p{N}+", r"\s+")]

    def words(top: int) -> re.Pattern:
        letters, numbers, white = (_ranges(k, top) for k in kinds)
        return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")

    strange = [(a, b - 1) for a, b in edges.tolist()]
    apart = [re.compile(f"[{_ranges(strange, top)}]") for top in (BASIC, 0x10FFFF)]
    return Characters((words(0x7F), words(BASIC), words(0x10FFFF)), tuple(apart))


def numbered(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Number of each word in order of appearance, and the distinct words."""
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return codes, list(known)


class Encoder:
    """Merge table of a vocabulary: pair keys in ascending order, with the rank and the result of each."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.size = vocab, len(vocab.tokens)
        self.inner, self.final = vocab.byte_ids(), vocab.byte_ids(last=True)
        left = np.array([vocab.ids[a] for a, _ in vocab.merges], np.int64)
        right = np.array([vocab.ids[b] for _, b in vocab.merges], np.int64)
        made = np.array([vocab.ids[a + b] for a, b in vocab.merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True)  # of a pair listed twice the later rank counts
        order = order[last]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        used = np.full(self.size, NEVER)
        for side in (left, right):
            np.minimum.at(used, side[order], order)
        # A merge may be done at all its places in one round if no merge that uses its result comes before it.
        self.at_once = used[self.made] > self.ranks
        self.white, self.characters = re.compile(WHITE), characters()
        self.normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        names = [t.encode() + b" " for t in vocab.tokens]
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the merge table of every pair, or -1."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one flat array, and how many each word has.

        A round finds each word's lowest-ranked pair and merges it at all its places, from left to right without
        overlap. Words without a mergeable pair leave the rounds.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        counts, done = np.zeros(len(words), np.int64), []

        def pairs_from(at: np.ndarray) -> np.ndarray:
            """Merge-table place of the pairs that start at ``at``; -1 at a word's end."""
            nxt = np.minimum(at + 1, len(sym) - 1)
            place = self._rank(sym[at], sym[nxt])
            place[(at + 1 >= len(sym)) | (word[at] != word[nxt])] = -1
            return place

        place = pairs_from(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(sym)))
            rank = np.where(place >= 0, self.ranks[place], NEVER)
            least = np.minimum.reduceat(rank, starts)
            ready = np.repeat(least == NEVER, lengths)
            if ready.any():
                done.append((word[ready], sym[ready]))
                counts[word[starts[least == NEVER]]] = lengths[least == NEVER]
                keep = ~ready
                sym, word, place, rank = sym[keep], word[keep], place[keep], rank[keep]
                alive = least != NEVER
                least, lengths = least[alive], lengths[alive]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            begins = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            first = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[np.where(self.at_once[place[hit]], take, first)]
            sym[hit] = self.made[place[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            shift = np.cumsum(gone)
            sym, word, place = sym[~gone], word[~gone], place[~gone]
            now = hit - shift[hit]
            touched = np.concatenate((now, now[now > 0] - 1))
            place[touched] = pairs_from(touched)
        order = np.argsort(np.concatenate([w for w, _ in done]), kind="stable")
        return np.concatenate([s for _, s in done])[order], counts

    def chunks(self, text: str) -> list[str]:
        """Normalised text (NFC, lower case letter by letter) without its white space."""
        if text.isascii():
            text = text.lower()
        elif self.characters.apart[max(text) > chr(BASIC)].search(text):
            text = self.normaliser.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if re.search("[\x1c-\x1f]", text):  # white space for str.split, not for the vocabulary
            return [c for c in self.white.split(text) if c]
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one flat array, and how many each text has."""
        special, sign, chunks, sizes = self.vocab.special_pattern, self.vocab.special_sign, [], []
        for text in texts:
            before = len(chunks)
            if special and text and sign in text and special.search(text):
                for k, part in enumerate(special.split(text)):
                    chunks += [MARK + part] if k % 2 else self.chunks(part)
            else:
                chunks += self.chunks(text or "")
            sizes.append(len(chunks) - before)
        codes, distinct = numbered(chunks)
        ids, starts, lengths = self._distinct(distinct)
        per_chunk = lengths[codes]
        flat = ids[ragged(starts[codes], per_chunk)]
        ends = np.cumsum(sizes)
        upto = np.append(0, np.cumsum(per_chunk))
        return flat, upto[ends] - upto[ends - sizes]

    def pieces(self, chunk: str) -> list[str]:
        return self.characters.words[0 if chunk.isascii() else 1 + (max(chunk) > chr(BASIC))].findall(chunk)

    def _distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of distinct chunks with the start and length of each."""
        pieces, counts = [], []
        for c in chunks:
            if c.isalpha():
                pieces.append(c)
                counts.append(1)
                continue
            cut = [c] if c[0] == MARK and c[1:] in self.vocab.special else self.pieces(c)
            pieces += cut
            counts.append(len(cut))
        codes, distinct = numbered(pieces)
        special = {MARK + name: i for name, i in self.vocab.special.items()}
        ids, sizes = self.merge([b" " if p in special else p.encode("utf-8", "surrogatepass") for p in distinct])
        begins = np.cumsum(sizes) - sizes
        for k, p in enumerate(distinct):
            if p[0] == MARK and p in special:
                ids[begins[k]] = special[p]
        sizes_all = sizes[codes]
        flat = ids[ragged(begins[codes], sizes_all)]
        counts = np.array(counts, np.int64)
        upto = np.append(0, np.cumsum(sizes_all))
        ends = np.cumsum(counts)
        return flat, upto[ends - counts], upto[ends] - upto[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive stretches of ids: their tokens, joined by single spaces."""
        sizes = self.name_sizes[ids]
        raw = self.name_bytes[ragged(self.name_starts[ids], sizes)].tobytes()
        upto = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        spans = zip(upto[ends - counts].tolist(), upto[ends].tolist(), strict=True)
        return [raw[a : max(a, b - 1)].decode() for a, b in spans]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit integers), n_tokens.

    With ``decoded`` a column of that name holds what the ids decode to. Null and empty texts have no ids and
    decode to the empty text; repeated rows are repeated; other columns are ignored. Memory is bounded by a
    megabyte of text, or one longer text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [rows.schema["doc_id"], StructField("ids", BinaryType(), False), StructField("n_tokens", LongType(), False)]
    fields += [StructField("decoded", StringType(), False)] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in blocks(batch, "text", 1 << 20):
                flat, counts = bpe.encode(part.column("text").to_pylist())
                packed = flat.astype("<u4").tobytes()
                ends = 4 * np.cumsum(counts)
                spans = zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)
                out = [part.column("doc_id"), pa.array([packed[a:b] for a, b in spans], pa.binary()), pa.array(counts)]
                if decoded:
                    out.append(pa.array(bpe.decode(flat, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``; null ids decode to the empty text."""
    schema = StructType([f for f in encoded.schema if f.name != "decoded"] + [StructField("decoded", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in blocks(batch, ids_col):
                found = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in part.column(ids_col).to_pylist()]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                texts = bpe.decode(np.concatenate(found) if found else np.zeros(0, np.int64), counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, schema)
