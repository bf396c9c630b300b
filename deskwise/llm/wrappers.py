"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.llm.blocks import blocks
from deskwise.session import materialize

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSES = {  # an opening tag ends these open ones, as far as the nearest of the barriers
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
BARRIERS = frozenset("ul ol dl table body html div article section main nav".split())
NOT_MAIN = frozenset("nav header footer aside form button select menu dialog head fieldset object audio video canvas".split()) | RAW
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu header masthead "
    "footer sidebar side aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "comment comments reply replies discussion disqus respond share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager toolbar search complementary contentinfo hidden skip form".split()
)
MAIN_WORDS = frozenset("article articlebody main maincontent".split())
LANDMARKS = frozenset("html body main article".split())  # what a class says of these is about the layout
GROUPING = frozenset("div section center".split())  # elements that say nothing of what they hold
TALK_WORDS = frozenset("comment comments reply replies discussion disqus respond".split())


@dataclass
class Block:
    """A block element of a page, or with sig ``#text`` a run of text and inline markup between block tags."""

    sig: str
    kids: list[Block] = field(default_factory=list)
    text: str = ""
    links: int = 0


def _sig(tag: str, attributes: str) -> str:
    """Tag, class words without digits, and role: what tells blocks of a template apart.

    What an attribute says outright (hidden, a role that is not main text) is a word that begins with ``!``.
    """
    words = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            words.add("!hidden")
        elif name in ("class", "id", "role", "itemprop"):
            found = re.findall(r"[a-z]+", value)
            words.update(found if name != "id" else (w for w in found if w in NOT_MAIN_WORDS or w in MAIN_WORDS))
            if name == "role":
                words.update("!" + w for w in found if w in NOT_MAIN_WORDS)
    return ".".join([tag, *sorted(words - {"true", "false"})])


def _outright(sig: str) -> bool:
    """Is a block no main text by its tag or by an attribute, whatever its class words and its text are?"""
    return sig.split(".", 1)[0] in NOT_MAIN or ".!" in sig


def _spare(root: Block) -> None:
    """Mark with the word ``~`` the blocks that their class words must not discard: those that hold most of the
    page's running text. Blocks with words for discussions must also hold all headings, article and main
    elements of the page, or all of its running text; a long discussion below a short text stays one.

    Articles are never discarded for their words, but comments that are articles below or inside another one are.
    """
    order: list[tuple[Block, int, list[str]]] = []
    todo = [(root, -1)]
    while todo:
        block, up = todo.pop()
        if not _outright(block.sig):
            todo += [(kid, len(order)) for kid in reversed(block.kids)]
            order.append((block, up, block.sig.split(".")))
    if not any(not NOT_MAIN_WORDS.isdisjoint(sig) for _, _, sig in order):
        return
    text, marks, article = [0] * len(order), [0] * len(order), False
    for at in range(len(order) - 1, -1, -1):
        block, up, sig = order[at]
        if block.text:
            text[at] = max(0, len(block.text) - 2 * block.links)
        marks[at] += sig[0] in ("h1", "main") or sig[0] == "article" and "comment" not in sig and "reply" not in sig
        if at:
            text[up] += text[at]
            marks[up] += marks[at]
    for at, (block, _, sig) in enumerate(order):
        if sig[0] == "article":
            if "comment" not in sig and "reply" not in sig:
                article = True
            elif article:
                block.sig += ".!comment"
        elif sig[0] not in LANDMARKS and not NOT_MAIN_WORDS.isdisjoint(sig[1:]) and 2 * text[at] > text[0]:
            if TALK_WORDS.isdisjoint(sig) or text[at] == text[0] or marks[at] == marks[0] > 0:
                block.sig += ".~"


def parse(page: str | None) -> Block:
    """The blocks of a page as a tree; markup that is cut off, unclosed or crossed is closed where it must be."""
    page = page or ""
    root = Block("#page")
    stack: list[tuple[str, Block]] = [("#page", root)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    run: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal run, links
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            stack[-1][1].kids.append(Block("#text", text=text, links=links))
        run, links = [], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    while True:
        m = TOKEN.search(page, at)
        tail = page[at : m.start() if m else len(page)]
        if tail:
            run.append(tail)
            links += len(tail) * bool(in_link)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else len(page))
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        ends = CLOSES.get(tag)
        if ends:
            depth = max((places[t][-1] for t in ends | BARRIERS if places.get(t)), default=0)
            if depth and stack[depth][0] in ends:
                close(depth)
        block = Block(_sig(tag, m[3]))
        stack[-1][1].kids.append(block)
        if tag not in VOID and not m[3].endswith("/"):
            places[tag].append(len(stack))
            stack.append((tag, block))
    flush()
    _spare(root)
    _shape(root)
    return root


# -- wrappers -------------------------------------------------------------------------------------


def _shape(root: Block) -> None:
    """Tell blocks that only group others apart by what they hold, so that neighbours of different content are no repetition.

    A word that begins with ``^`` is added to their signature: links (most of the text), text alone, blocks with
    text, or nothing. Which blocks occur inside doesn't matter; a text may have lists on one page and none on another.
    """
    order: list[tuple[Block, int]] = []
    todo = [(root, -1)]
    while todo:
        block, up = todo.pop()
        todo += [(kid, len(order)) for kid in block.kids]
        order.append((block, up))
    chars, links = [len(b.text) for b, _ in order], [min(b.links, len(b.text)) for b, _ in order]
    for at in range(len(order) - 1, -1, -1):
        block, up = order[at]
        if up >= 0:
            chars[up] += chars[at]
            links[up] += links[at]
        if block.sig.split(".", 1)[0] in GROUPING:
            nested = any(kid.sig != "#text" for kid in block.kids)
            block.sig += ".^links" if 2 * links[at] > chars[at] else ".^none" if not chars[at] else ".^blocks" if nested else ".^text"


@dataclass
class Part:
    """One element of a wrapper: a block or text slot that may be missing (optional) or come again (repeated)."""

    sig: str
    optional: bool = False
    repeated: bool = False
    kids: list[Part] = field(default_factory=list)
    chars: int = 0
    links: int = 0
    pages: int = 1
    same: int | None = None  # crc32 of the text if every page has the same

    def dump(self) -> list:
        """This part and all below it from the top down, each with the number of its kids: flat, so of any depth."""
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            out.append([p.sig, int(p.optional), int(p.repeated), len(p.kids), p.chars, p.links, p.pages, p.same])
            todo += reversed(p.kids)
        return out

    @staticmethod
    def load(rows: list) -> Part:
        done: list[Part] = []
        for sig, optional, repeated, n, *rest in reversed(rows):
            kids = done[len(done) - n :][::-1]
            del done[len(done) - n :]
            done.append(Part(sig, bool(optional), bool(repeated), kids, *rest))
        return done[0]


def wrap(block: Block) -> Part:
    """The wrapper of one page: its tree with equal neighbours folded into repeated parts."""
    order, todo = [], [block]
    while todo:
        order.append(todo.pop())
        todo += reversed(order[-1].kids)
    done: list[Part] = []
    for block in reversed(order):
        if block.sig == "#text":
            same = zlib.crc32(block.text.encode("utf-8", "replace"))
            done.append(Part("#text", chars=len(block.text), links=min(block.links, len(block.text)), same=same))
        else:
            kids = done[len(done) - len(block.kids) :][::-1]
            del done[len(done) - len(block.kids) :]
            done.append(Part(block.sig, kids=fold_repeats(kids)))
    return done[0]


# Folding and aligning call each other as deep as pages are nested: they yield the calls, which _result makes.
Steps = Generator["Steps", Any, Any]


def _result(steps: Steps) -> Any:
    stack, value = [steps], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(call)
            value = None
    return value


def fold_repeats(parts: list[Part], longest: int = 3) -> list[Part]:
    """Fold stretches of up to ``longest`` parts that follow themselves into one repeated stretch."""
    return _result(_fold_steps(parts, longest)) if len(parts) > 1 else parts


def align(left: list[Part], right: list[Part]) -> list[Part]:
    """The shortest common supersequence of two sequences of parts; what only one side has becomes optional."""
    return _result(_align_steps(left, right))


def _same_part(a: Part, b: Part, repeated: bool = False) -> Part:
    """Two parts of the same signature as one."""
    return _result(_same_steps(a, b, repeated))


def _fold_steps(parts: list[Part], longest: int = 3) -> Steps:
    for size in range(1, longest + 1):
        out: list[Part] = []
        for part in parts:
            out.append(part)
            if len(out) >= 2 * size and [p.sig for p in out[-size:]] == [p.sig for p in out[-2 * size : -size]]:
                again, first = out[-size:], out[-2 * size : -size]
                if size > 1 and len({p.sig for p in first}) == 1:
                    continue
                del out[-2 * size :]
                for a, b in zip(first, again, strict=True):
                    out.append((yield _same_steps(a, b, repeated=True)))
        parts = out
    return parts


def _same_steps(a: Part, b: Part, repeated: bool = False) -> Steps:
    kids = (yield _align_steps(a.kids, b.kids)) if a.kids or b.kids else []
    pages = max(a.pages, b.pages) if repeated else a.pages + b.pages
    same = a.same if a.same == b.same and not repeated else None
    return Part(a.sig, a.optional or b.optional, repeated or a.repeated or b.repeated, kids, a.chars + b.chars, a.links + b.links, pages, same)


def _align_steps(left: list[Part], right: list[Part]) -> Steps:
    rows, columns, out = [p.sig for p in left], [p.sig for p in right], []
    if rows == columns:
        for a, b in zip(left, right, strict=True):
            out.append((yield _same_steps(a, b)))
        return out
    pairs = _common(rows, columns)
    i = j = 0
    for a, b in [*pairs, (len(left), len(right))]:
        for part in (*left[i:a], *right[j:b]):
            part.optional = True
            out.append(part)
        if a < len(left):
            out.append((yield _same_steps(left[a], right[b])))
        i, j = a + 1, b + 1
    return (yield _fold_steps(out))


def _common(a: list[str], b: list[str], room: int = 1 << 26) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, found in the same way at every size.

    Row i of the table of lengths is one integer: bit k is clear where the length for a[i:] and b[j:] is above that
    for b[j + 1:], j = len(b) - 1 - k. Rows are made from the last one up. If all take more than ``room`` bits, only
    some are kept, and those between two kept ones are made again on the way down.
    """
    n, m, i = len(a), len(b), 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    j, first, out = i, i, [(k, k) for k in range(i)]
    if i == n or i == m:
        return out
    spots: dict[str, list[int]] = defaultdict(list)
    for k in range(j, m):
        spots[b[k]].append(m - 1 - k)
    masks: dict[str, int] = {}

    def mask(sig: str) -> int:
        found = masks.get(sig)
        if found is None:
            bits = bytearray(m // 8 + 1)
            for k in spots.get(sig, ()):
                bits[k >> 3] |= 1 << (k & 7)
            found = int.from_bytes(bits, "little")
            if m < 4096 or len(spots.get(sig, ())) > 16:  # rare ones are made again, so that masks stay few
                masks[sig] = found
        return found

    full = (1 << (m - j)) - 1

    def rows(start: int, stop: int, row: int) -> Iterator[int]:
        for k in range(start - 1, stop - 1, -1):
            hit = row & mask(a[k]) if a[k] in spots else 0
            if hit:
                row = (row + hit | row - hit) & full
            yield row

    step = 1 if (n - first) * (m - first) <= room else math.isqrt(n - first)
    kept = {n: full}
    for k, row in zip(range(n - 1, first - 1, -1), rows(n, first, full), strict=True):
        if (k - first) % step == 0:
            kept[k] = row
    held: list[int] = []  # the rows from the next kept one up to row i

    def length(row: int) -> int:
        """For this row and b[j:]."""
        return m - j - (row & ((1 << (m - j)) - 1)).bit_count()

    low = length(kept[first])
    while i < n and j < m:
        if len(held) < 2:
            stop = min(n, i + step)
            held = [kept[stop], *rows(stop, i, kept[stop])]
        below = held[-2]
        below_low = length(below)
        while j < m and a[i] != b[j] and below_low < low:  # then the length comes from the rest of b
            below_low -= not below >> (m - 1 - j) & 1
            j += 1
        if j < m and a[i] == b[j]:
            out.append((i, j))
            j += 1
            below_low -= not below >> (m - j) & 1
        held.pop()
        i, low = i + 1, below_low
    return out


# -- main text ------------------------------------------------------------------------------------


def is_boilerplate(part: Part) -> bool:
    tag, *words = part.sig.split(".")
    return _outright(part.sig) or tag not in LANDMARKS and "~" not in words and any(w in NOT_MAIN_WORDS for w in words)


def is_main(part: Part) -> bool:
    tag, *words = part.sig.split(".")
    return tag in ("article", "main") or any(w in MAIN_WORDS for w in words)


def main_path(wrapper: Part) -> list[int]:
    """Where the main text of a wrapper is, as places of parts from the top down.

    The innermost article or main element that holds nearly all of the text of such elements; without one, the
    deepest part that still holds most of the running text.
    """
    order: list[tuple[Part, int, int, int]] = []  # part, its parent's place in this list, its place there, depth
    kids: list[dict[int, int]] = []  # places in this list by place in the part
    todo = [(wrapper, -1, 0, 0)]
    while todo:
        part, up, place, depth = row = todo.pop()
        if up >= 0:
            kids[up][place] = len(order)
        todo += [(part.kids[k], len(order), k, depth + 1) for k in range(len(part.kids) - 1, -1, -1) if not is_boilerplate(part.kids[k])]
        order.append(row)
        kids.append({})
    # Characters of running text in the slots of a part: neither links nor the same on all of several pages.
    mass = [0] * len(order)
    for at in range(len(order) - 1, -1, -1):
        part, up, _, _ = order[at]
        if part.sig == "#text" and not (part.pages >= 4 and part.same is not None):
            mass[at] = max(0, part.chars - 2 * part.links)
        if at:
            mass[up] += mass[at]
    marked = [at for at in range(1, len(order)) if is_main(order[at][0])]
    at = 0
    if marked:
        most = max(mass[k] for k in marked)
        at = max((k for k in marked if mass[k] >= 0.9 * most), key=lambda k: order[k][3])
    else:
        while True:
            best = max(kids[at].values(), key=lambda k: mass[k], default=None)
            if best is None or not mass[at] or order[best][0].sig == "#text" or order[best][0].repeated or mass[best] < 0.7 * mass[at]:
                break
            at = best
    path = []
    while at:
        path.append(order[at][2])
        at = order[at][1]
    return path[::-1]


def match(block: Block, part: Part) -> Iterator[tuple[Block, int | None]]:
    """Each kid of a block with the place of the wrapper part that it is an instance of."""
    at = 0
    sigs = [p.sig for p in part.kids]
    for kid in block.kids:
        ahead = next((k for k in range(at, len(sigs)) if sigs[k] == kid.sig), None)
        place = ahead if ahead is not None else next((k for k in range(at) if sigs[k] == kid.sig), None)
        if place is not None:
            at = place
        yield kid, place


def extract(page: str | None, wrapper: Part | None) -> str:
    """Main text of a page by its host's wrapper; by a wrapper of its own if the host's finds nothing in it."""
    tree = parse(page)
    for candidate in (wrapper, None):
        candidate = candidate or wrap(tree)
        path = main_path(candidate)
        roots = [(tree, candidate)]
        for step in path:
            roots = [(kid, part.kids[step]) for block, part in roots for kid, place in match(block, part) if place == step]
        texts: list[str] = []
        for block, part in roots:
            _gather(block, part, bool(path) and is_main(part), texts)
        if texts:
            return "\n\n".join(texts)
        if wrapper is None:
            return ""
    return ""


def _gather(block: Block, part: Part | None, marked: bool, out: list[str]) -> None:
    """Texts below a block in page order, without boilerplate; outside article elements also without slots
    that all pages share and lists of links."""

    def below(block: Block, part: Part | None) -> Iterator[tuple[Block, Part | None]]:
        if part is None:
            return ((kid, None) for kid in block.kids)
        return ((kid, None if place is None else part.kids[place]) for kid, place in match(block, part))

    todo = [below(block, part)]
    while todo:
        kid, slot = next(todo[-1], (None, None))
        if kid is None:
            todo.pop()
        elif kid.sig == "#text":
            shared = slot is not None and slot.pages >= 4 and slot.same is not None
            if marked or not (shared or 2 * kid.links > len(kid.text)):
                out.append(kid.text)
        elif not is_boilerplate(Part(kid.sig)):
            todo.append(below(kid, slot))


# -- Spark ----------------------------------------------------------------------------------------


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://|[/?#].*$", "", (url or "").strip().lower(), flags=re.S)


def _dump(part: Part) -> str:
    return json.dumps(part.dump(), separators=(",", ":"))


@lru_cache(maxsize=4096)
def _load(text: str) -> Part:
    return Part.load(json.loads(text))


def skeleton(part: Part) -> str:
    """Digest of a wrapper's structure, whatever its texts."""
    shape = [row[:4] for row in part.dump()]
    return hashlib.md5(json.dumps(shape, separators=(",", ":")).encode()).hexdigest()


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = 256, held_wrappers: int = 4096) -> DataFrame:
    """(host, wrapper): the wrapper of every host, aligned from all its pages; the same in whatever order pages come.

    Aligning depends on the order, adding up the texts of pages of one skeleton doesn't. So pages are first
    reduced to the distinct skeletons of their host, each with the sums of its slots. Skeletons are then aligned in a fixed
    tree: those whose digests begin alike in the order of the digests, their results in the order of the beginnings,
    one digit fewer each time. The first beginnings are as long as it takes for a group to have about ``group`` skeletons, and
    every later group has 16 wrappers at most, so no task gathers a host. A scanning task holds at most
    ``held_wrappers`` wrappers between two blocks of pages and hands on the oldest beyond that.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Part] = {}

        def out(keys: list[tuple[str, str]]) -> pa.RecordBatch:
            texts = [_dump(held.pop(k)) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(texts)], ["host", "place", "wrapper"])

        for batch in batches:
            for block in blocks(batch, "html"):
                for url, page in zip(block.column("url").to_pylist(), block.column("html").to_pylist(), strict=True):
                    new = wrap(parse(page))
                    key = _host(url), skeleton(new)
                    held[key] = _same_part(held.pop(key), new) if key in held else new
                if len(held) > held_wrappers:
                    yield out(list(held)[: len(held) - held_wrappers])
        if held:
            yield out(list(held))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        merged, same, last = None, None, None
        for place, text in rows.sort_values("place", kind="stable")[["place", "wrapper"]].itertuples(index=False):
            part = Part.load(json.loads(text))
            if place == last:
                same = _same_part(same, part)
                continue
            if same is not None:
                merged = same if merged is None else _same_part(merged, same)
            same, last = part, place
        merged = same if merged is None else _same_part(merged, same)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "place": rows["begin"].iloc[:1], "wrapper": [_dump(merged)]})

    found = materialize(rows.mapInArrow(scan, "host string, place string, wrapper string"), "skeletons")
    most = found.select("host", "place").distinct().groupBy("host").count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while group * 16**digits < most:
        digits += 1
    for length in range(digits, -1, -1):
        begun = found.withColumn("begin", F.substring("place", 1, length))
        found = begun.groupBy("host", "begin").applyInPandas(merge, "host string, place string, wrapper string")
    return found.select("host", "wrapper")


def main_texts(
    pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (code points).

    Wrappers reach the pages by broadcast if they are at most ``broadcast_bytes`` together, else by a join on the
    host, whose hot hosts adaptive execution splits. Null and empty pages have the empty text; a null url is a
    host of its own; repeated rows are repeated; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.regexp_replace(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"^[a-z][a-z0-9+.-]*://|(?s)[/?#].*$", "")
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= broadcast_bytes else wrappers
    joined = rows.withColumn("host", host).join(side, "host", "left").drop("host")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html"):
                both = zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True)
                texts = [extract(page, _load(w) if w else None) for page, w in both]
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], schema.names)

    return joined.mapInArrow(run, schema)
