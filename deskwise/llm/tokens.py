"""Token counts by compiled finite-state transducers.

Two transducers run over a block of texts. The first cuts characters into words; its chunks are run from every
state at once, and their state maps are composed by a parallel prefix scan. The second reads the bytes of
the words, all words in step, and each of its transitions says by how much the token count changes. It is
compiled from the merge table on demand.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deskwise.llm.blocks import blocks
from deskwise.llm.vocab import Vocabulary, byte_letters, load

# -- words ----------------------------------------------------------------------------------------

# Character classes. The letters of the contractions 's 't 'm 'd, 're, 've and 'll have their own.
LETTER, SHORT, R, E, V, L, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
# States: at a word's start; inside letters, numbers, others; after a quote that starts a word, and after that and
# r, v or l; in white space of one or more characters that ends with a space or another.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(12)
HERE, BEFORE = 1, 2  # a word starts at this character; at the one before it

WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _word_step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks of the cutting rule: contractions, letters, numbers and others with one space in
    front, and white space, whose last character is cut off if something follows."""
    letters = (LETTER, SHORT, R, E, V, L)
    fresh = {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: QUOTED, OTHER: IN_OTHERS}
    own = IN_LETTERS if kind in letters else fresh.get(kind, START)
    if kind == END:
        return START, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        if kind in (SPACE, WHITE):
            return (MORE_SPACE if kind == SPACE else MORE_WHITE), 0
        cut = BEFORE if state in (MORE_SPACE, MORE_WHITE) else 0
        if state in (ONE_SPACE, MORE_SPACE):
            return (IN_OTHERS if kind == QUOTE else own), cut
        return own, cut | HERE
    if state == QUOTED:
        after = {SHORT: START, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L, QUOTE: IN_OTHERS, OTHER: IN_OTHERS}
        return (after[kind], 0) if kind in after else (own, HERE)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return START, 0
        return own, BEFORE | (0 if kind in letters else HERE)
    if state == IN_OTHERS and kind in (QUOTE, OTHER) or state == own and state in (IN_LETTERS, IN_NUMBERS):
        return state, 0
    return own, HERE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every code point; next state and marks by 16 * state + class."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    classes = np.array([LETTER if k == "L" else NUMBER if k == "N" else OTHER for k in first], np.uint8)
    classes[WHITE_SPACE] = WHITE
    for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("e", E), ("v", V), ("l", L)):
        classes[[ord(c) for c in text]] = kind
    steps = [[_word_step(s, k) if k <= END else (START, 0) for k in range(16)] for s in range(12)]
    table = np.array(steps, np.uint8).reshape(-1, 2)
    return classes, np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])


def word_starts(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Places where words start, in a stream of character classes."""
    _, step, marks = _tables()
    n = len(kinds)
    count = -(-n // chunk)
    padded = np.full(count * chunk, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(count, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], count, axis=1)  # by entry state and chunk
    for column in columns:
        maps = step[(maps << 4) | column]
    gap = 1
    while gap < count:  # prefix scan: afterwards a map covers all chunks up to its own
        maps[:, gap:] = np.take_along_axis(maps[:, gap:], maps[:, :-gap].copy(), axis=0)
        gap *= 2
    state = np.append(np.uint8(START), maps[START, :-1])
    found = np.empty_like(columns)
    for j, column in enumerate(columns):
        at = (state << 4) | column
        found[j] = marks[at]
        state = step[at]
    found = found.T.reshape(-1)[:n]
    is_start = (found & HERE) > 0
    is_start[:-1] |= (found[1:] & BEFORE) > 0
    return np.flatnonzero(is_start)


# -- tokens ---------------------------------------------------------------------------------------


NEVER = 1 << 30


class Transducer:
    """Deterministic transducer over the bytes of a word; the outputs of its transitions add up to the token count.

    The encoding of a prefix is the encoding of a shorter prefix plus one token, and which token may follow
    which is settled by the pair alone. So a state holds the prefixes that a longer token may still start
    after: for each the trie node reached since, the last token before, and its count relative to the
    present one. States are numbered as they turn up. At ``max_states`` the table starts anew, which
    bounds memory and changes no count.
    """

    UNKNOWN = -1

    def __init__(self, vocab: Vocabulary, max_states: int = 120_000):
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.spell = {i: bytes(letter[c] for c in t) for t, i in vocab.ids.items()}
        self.rank = {(vocab.ids[a], vocab.ids[b]): (r, vocab.ids[a + b]) for r, (a, b) in enumerate(vocab.merges)}
        self.byte_id = vocab.byte_ids().tolist()
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for i, word in self.spell.items():
            node = 0
            for byte in word:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][byte]
            self.token[node] = i
        used = {}
        for rank, pair in enumerate(vocab.merges):
            for part in pair:
                used.setdefault(vocab.ids[part], rank)
        if any(used.get(made, NEVER) <= rank for rank, made in self.rank.values()):
            raise ValueError("a merge uses a token before it is made")
        self.below = self._below(limit=64)
        self.sides: dict[int, tuple | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.like: dict[tuple[int, int], int | None] = {}
        self.alike: dict[tuple, int] = {}
        self.max_states = max_states
        self.clear()

    def _below(self, limit: int) -> list[list[int] | None]:
        """The tokens strictly below each trie node; None if there are more than ``limit``."""
        out: list[list[int] | None] = [None] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children have higher numbers
            found: list[int] | None = []
            for child in self.children[node].values():
                if out[child] is None or len(found) + len(out[child]) + 1 > limit:
                    found = None
                    break
                found = found + out[child] + ([self.token[child]] if self.token[child] is not None else [])
            out[node] = found
        return out

    def clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.column = np.full(256, -1, np.int64)
        self.width = 0
        self.table = np.full((1024, 0), self.UNKNOWN, np.int32)

    def _sides(self, token: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]] | None:
        """What stands at the left and at the right end of a token while its spelling is merged.

        Each entry is (token, rank of the merge that makes it, rank of the merge that uses it up). None if the
        spelling is not merged into this token at all.
        """
        if token not in self.sides:
            ids = [(self.byte_id[b], -1) for b in self.spell[token]]
            left, right = [(*ids[0], NEVER)], [(*ids[-1], NEVER)]
            while len(ids) > 1:
                ranks = [self.rank.get((x[0], y[0]), (NEVER, 0)) for x, y in zip(ids, ids[1:], strict=False)]
                rank, made = min(ranks)
                if rank == NEVER:
                    break
                k = ranks.index((rank, made))
                for ends, here in ((left, k == 0), (right, k == len(ids) - 2)):
                    if here:
                        ends[-1] = (*ends[-1][:2], rank)
                        ends.append((made, rank, NEVER))
                ids[k : k + 2] = [(made, rank)]
            self.sides[token] = (left, right) if len(ids) == 1 and ids[0][0] == token else None
        return self.sides[token]

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether the two spellings together are encoded as these two tokens (the second alone if before is -1).

        They are unless a merge across the border comes first: one of a right end of the left token and a left end
        of the right token, before the merge that uses up either (at equal rank the merge further left comes
        first). This needs merges in an order in which no token is used before it is made.
        """
        if before < 0:
            return self._sides(token) is not None
        key = (before, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows = {}
            one, two = self._sides(before), self._sides(token)
            known = self.follows[key] = bool(one and two) and not any(
                self.rank.get((x, y), (NEVER, 0))[0] < min(x_gone, y_gone + 1)
                for x, x_made, x_gone in one[1]
                for y, y_made, y_gone in two[0]
                if x_made < y_gone and y_made < x_gone
            )
        return known

    def _useful(self, node: int, before: int) -> int | None:
        """The first token seen that behaves like ``before`` in front of every token below a node; None if none may follow."""
        key = (node, before)
        if key not in self.like:
            if len(self.like) > 1_000_000:
                self.like, self.alike = {}, {}
            below = self.below[node]
            if below is None:
                self.like[key] = before
            else:
                viable = (node, *(t for t in below if self._may_follow(before, t)))
                self.like[key] = self.alike.setdefault(viable, before) if len(viable) > 1 else None
        return self.like[key]

    def _compile(self, state: int, byte: int) -> None:
        alive, last = [], None
        for node, before, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and last is None and self._may_follow(before, token):
                last = (token, count + 1)
            if self.children[child]:
                useful = self._useful(child, before)
                if useful is not None:
                    alive.append((child, useful, count))
        token, total = last  # every single byte is a token, so that every prefix has an encoding
        target = (*((n, b, c - total) for n, b, c in alive), (0, token, 0))
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
            if number >= len(self.table):
                more = np.full(self.table.shape, self.UNKNOWN, np.int32)
                self.table = np.concatenate((self.table, more))
        self.table[state, self.column[byte]] = (number << 8) | (total + 128)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token count of each word ``data[start : start + length]``; a word has a byte at least."""
        new = np.setdiff1d(np.unique(data), np.flatnonzero(self.column >= 0))
        if len(self.states) > self.max_states:
            self.clear()
            new = np.unique(data)
        if len(new):
            self.column[new] = self.width + np.arange(len(new))
            self.width += len(new)
            wider = np.full((len(self.table), len(new)), self.UNKNOWN, np.int32)
            self.table = np.concatenate((self.table, wider), axis=1)
        columns = self.column[data]
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step, n in enumerate(active.tolist()):
            kinds, now = columns[at[:n] + step], state[:n]
            cell = self.table[now, kinds]
            missing = np.flatnonzero(cell < 0)
            if len(missing):
                keys = np.unique(now[missing] * 256 + data[at[missing] + step])
                for key in keys.tolist():
                    self._compile(key >> 8, key & 255)
                cell[missing] = self.table[now[missing], kinds[missing]]
            state[:n] = cell >> 8
            total[:n] += (cell & 255) - 128
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    """Token counts of texts under one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        if vocab.suffix:
            raise ValueError("a vocabulary without word ends is needed")
        self.vocab, self.transducer = vocab, Transducer(vocab)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of every text. Special strings are one token each and end the words around them."""
        classes, special, sign = _tables()[0], self.vocab.special_pattern, self.vocab.special_sign
        parts, owner = [], []
        extra = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            cut = special.split(text) if special and sign in text else [text]
            parts += cut[::2]
            owner += [k] * len(cut[::2])
            extra[k] = len(cut) // 2
        sizes = np.fromiter((len((t or "").encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        if not parts:
            return sizes, extra
        joined = "\n".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kinds = classes[points]
        kinds[ends] = END
        begins = word_starts(kinds)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(points):
            places = np.append(begins, len(points))
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            offset = np.append(0, np.cumsum(width))
            places = offset[np.append(begins, len(points))]
        real = kinds[begins] != END
        found = self.transducer.counts(data, places[:-1][real], np.diff(places)[real])
        text_of = np.array(owner)[np.searchsorted(ends, begins[real])]
        return sizes, extra + np.bincount(text_of, found, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(load(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8) and n_tokens under the vocabulary file at ``path``.

    Null and empty texts have none of either. Repeated rows are repeated, other columns ignored. Memory is
    bounded by two megabytes of text, or one longer text, and the transducer's state limit.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("n_bytes", LongType(), False), StructField("n_tokens", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                sizes, tokens = counts.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(tokens)], schema.names)

    return rows.mapInArrow(run, schema)
