"""Evaluation passages in scanned pages, by multi-pattern search and alignment.

Texts become streams of letter classes: case, blanks, punctuation, line breaks
and hyphens go, and letters that a scanner confuses share a class.  A Wu-Manber
search finds pieces of passages: a table over blocks says how far a window may
jump, blocks that end a piece lead to its hash bucket, and pieces are compared
letter by letter.  From a hit, page and passage are followed both ways, and
then compared word by word in their own letters: a word counts if it differs
by no more than a scanner's misreadings, one with figures only if these are
the same.  Pages count that hold enough consecutive words.
"""

from __future__ import annotations

import bisect
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.llm.pages import reading_order

#: Letters of a searched piece; letters of a block; bits of the shift table.
PIECE, BLOCK, BITS = 9, 5, 20
#: A word in more passages than this is a common one, and a piece needs so many letters of a word that isn't.
COMMON, RARE = 3, 7
#: Letters up to which an advert or a running head between two parts of a passage is passed on ``NEAR_KEY`` letters that agree behind it; longer ones need ``FAR_KEY``.
BREAK, NEAR_KEY, FAR_KEY = 700, 7, 24
#: Letters of evaluation texts that are searched in one scan of the pages.
BLOCK_LETTERS = 8_000_000
#: Pieces apart that each stretch should have.
SOUGHT = 2
#: Letters at each end of a lane that lanes share, so that no piece is cut.
LANE = 2048

# Pairs of letters that a scanner reads as one, and letters it takes for each other.
JOINED = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ci", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("iv", "w"))
ALIKE = ("ceo0", "il1jtr", "nu", "hb", "fſ", "s85", "g9q", "vy", "zᴢ2")
# What a scanner reads for what, either way.
MISREAD = """e o, e c, o c, o 0, a e, a o, a n, c e, n u, h b, b 6, b 8, b r, r v, r i, r n, t l, t f, t r, l i, l 1, l j, i 1, i j, s 8, s 5, s f, g 9, g q, q o, q 9, v y, z 2,
n ri, m rn, m in, u ii, h li, d ci, d cl, w iv, w vv"""
_CLASS = {ord(ch): group[0] for group in ALIKE for ch in group}
_OTHER = re.compile(r"[\W_]+")
_PAIR, _FIGURE = re.compile("|".join(pair for pair, _ in JOINED)), re.compile(r"\d")


_MISREAD = {frozenset(p.split()) for p in MISREAD.replace("\n", " ").split(",")}


def folded(text: str) -> str:
    """A text without case and accents."""
    s = text.casefold()
    return s if s.isascii() else s.replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").translate(_PLAIN)


def stream(text: str) -> str:
    """The letters of a text, as classes."""
    s = folded(text)
    for pair, one in JOINED:
        s = s.replace(pair, one)
    return _OTHER.sub("", s).translate(_CLASS)


_PLAIN = {ord(a): b for a, b in zip("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy", strict=True)}


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)


def _placed(token: str) -> list[int]:
    """For each letter of the stream of a folded word, its place in the word."""
    at = list(range(len(token)))
    for pair, one in JOINED:
        k = token.find(pair)
        while k >= 0:
            token = token[:k] + one + token[k + 2 :]
            del at[k + 1]
            k = token.find(pair, k + 1)
    return at


class Letters:
    """A text's stream beside its own letters: ``own``, the place there of each letter of the stream, where words begin, and figures that go on a number."""

    def __init__(self, parts: list[str]):
        own, self.at, self.inner, self.begins, size = [], [], set(), set(), 0
        for part in parts:
            for token in _OTHER.split(folded(part)):
                if _PAIR.search(token):
                    self.at += [size + k for k in _placed(token)]
                else:
                    self.at += range(size, size + len(token))
                if len(token) > 1 and _FIGURE.search(token):
                    self.inner.update(size + k for k in range(1, len(token)) if token[k].isdigit() and token[k - 1].isdigit())
                own.append(token)
                self.begins.add(size)
                size += len(token)
        self.own = "".join(own)
        self.at.append(size)


class Passage:
    """A passage as a stream, with the word each letter belongs to."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        words = text.split()
        parts, spans, at = [stream(w) for w in words], [], 0
        for p in parts:
            spans.append((at, at + len(p)))
            at += len(p)
        whole = "".join(parts)
        self.text, self.spans = whole, spans
        self.backwards = whole[::-1]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.letters = Letters(words)
        self.own = [_OTHER.sub("", folded(w)) for w in words]


class WuManber:
    """Search for many pieces of equal length at once."""

    def __init__(self, pieces: dict[str, list[tuple[int, int]]]):
        self.pieces = pieces
        reach = PIECE - BLOCK + 1
        self.shift = np.full(1 << BITS, reach, dtype=np.int64)
        for piece in pieces:
            c = codes(piece).astype(np.int64)
            hashes = self._hash(c, np.arange(BLOCK - 1, PIECE))
            np.minimum.at(self.shift, hashes, np.arange(PIECE - BLOCK, -1, -1))

    @staticmethod
    def _hash(c: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(end), dtype=np.int64)
        for k in range(BLOCK - 1, -1, -1):
            h = h * 37 + c[end - k]
        return (h * 2654435761 >> 7) & ((1 << BITS) - 1)

    def hits(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, piece) of the pieces in a text.  The text is cut into lanes that overlap by a piece; all lanes jump at once."""
        c = codes(text).astype(np.int64)
        if len(c) < PIECE:
            return
        starts = np.arange(0, len(c) - PIECE + 1, LANE)
        end = starts + PIECE - 1
        stop = np.minimum(starts + LANE + PIECE - 1, len(c))
        while len(end):
            jump = self.shift[self._hash(c, end)]
            for e in end[jump == 0].tolist():
                piece = text[e - PIECE + 1 : e + 1]
                if piece in self.pieces:  # the bucket of the block, then letter by letter
                    yield e - PIECE + 1, piece
            end = end + np.maximum(jump, 1)
            live = end < stop
            end, stop = end[live], stop[live]


def pieces_of(passages: list[Passage], words: int = 14) -> dict[str, list[tuple[int, int]]]:
    """piece → (passage, place): pieces that hold most of a word which few passages have.

    A stretch of ``words`` words in which fewer than ``SOUGHT`` of them lie
    apart, so that a misread letter leaves some, has further pieces, those of
    the fewest passages first; the second and later ones only if few passages
    have them.
    """
    having: dict[str, set[int]] = {}
    for k, p in enumerate(passages):
        for a, b in p.spans:
            having.setdefault(p.text[a:b], set()).add(k)
    holders: dict[str, set[int]] = {}
    for k, p in enumerate(passages):
        for i in range(len(p.text) - PIECE + 1):
            holders.setdefault(p.text[i : i + PIECE], set()).add(k)
    found: dict[str, list[tuple[int, int]]] = {}
    for k, p in enumerate(passages):
        places: set[int] = set()
        for a, b in p.spans:
            if b - a >= RARE and len(having[p.text[a:b]]) <= COMMON:
                places.update(range(max(0, a + RARE - PIECE), min(len(p.text) - PIECE, b - RARE) + 1))
        common = [len(holders[p.text[i : i + PIECE]]) for i in range(len(p.text) - PIECE + 1)]
        for w in range(len(p.spans) - words + 1):
            low, high = p.spans[w][0], p.spans[w + words - 1][1] - PIECE
            n, free = 0, low  # pieces apart, and where the next may begin
            for i in sorted(i for i in places if low <= i <= high):
                if i >= free:
                    n, free = n + 1, i + PIECE
            while n < SOUGHT:
                apart = [i for i in range(low, min(high, len(common) - 1) + 1) if not any(abs(i - o) < PIECE for o in places)]
                best = min(apart, key=lambda i: (common[i], i), default=None)
                if best is None or n and common[best] > COMMON:
                    break
                places.add(best)
                n += 1
        for i in sorted(places):
            found.setdefault(p.text[i : i + PIECE], []).append((k, i))
    return found


def _edits(a: str, b: str, most: int) -> int:
    """Edits between two short texts, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _common(a: str, i: int, b: str, j: int) -> int:
    """Letters that agree from places ``i`` and ``j`` on."""
    n, step = 0, 32
    while step:
        while a[i + n : i + n + step] == b[j + n : j + n + step] and i + n + step <= len(a) and j + n + step <= len(b):
            n += step
        step //= 2
    return n


#: Gaps at which a misread letter or two are passed, the smallest first; and longer ones.
_NEAR = sorted(((x, y) for x in range(5) for y in range(5) if x or y), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))
_FAR = sorted(((x, y) for x in range(4, 11) for y in range(max(3, x - 3), x + 4)), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))


def _resume(a: str, i: int, b: str, j: int, lines: list[int]) -> tuple[int, int] | None:
    """Where agreement goes on after places that differ: past misread letters, a badly misread word, or whole lines of something else."""
    for x, y in _NEAR:
        n = 3 if x + y <= 2 else 4
        if a[i + x : i + x + n] == b[j + y : j + y + n] and i + x + n <= len(a) and (x + y <= 4 or _edits(a[i : i + x], b[j : j + y], 2) <= 2):
            return i + x, j + y
    for x, y in _FAR:
        if a[i + x : i + x + 5] == b[j + y : j + y + 5] and i + x + 5 <= len(a):
            most = max(x, y) // 2
            if _edits(a[i : i + x], b[j : j + y], most) <= most:
                return i + x, j + y
    k = bisect.bisect_left(lines, j - 3)
    if k < len(lines) and lines[k] <= j + 3:  # at a line's start: other lines may stand in between
        back = lines[k] - j
        met = []
        for x in (0, 1, 2, 3):
            # near lines by a short key, all others by a long one
            for size, low, high in ((NEAR_KEY, j + 1, j + BREAK + 16), (FAR_KEY, j + BREAK - 16, len(b))):
                key = a[i + x : i + x + size]
                to = b.find(key, low, high + size) if len(key) == size else -1
                while to >= 0:
                    near = bisect.bisect_left(lines, to + back - x - 5, k + 1)
                    if near < len(lines) and lines[near] <= to + back - x + 5 and (size == FAR_KEY or lines[near] <= j + BREAK):
                        met.append((near, x, to))
                        break
                    to = b.find(key, to + 1, high + size)
                if to >= 0:
                    break
        if met:
            _, x, to = min(met)
            return i + x, to
    return None


def _extend(a: str, i: int, b: str, j: int, lines: list[int]) -> list[tuple[int, int, int]]:
    """(place in ``a``, place in ``b``, length) of the stretches that agree on the way from places that agree."""
    out = []
    while True:
        n = _common(a, i, b, j)
        out.append((i, j, n))
        i, j = i + n, j + n
        there = _resume(a, i, b, j, lines) if i < len(a) else None
        if there is None:
            return out
        i, j = there


class Page:
    """A page as a stream, both ways, with the places where lines start."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.parts = [stream(line) for line in lines]
        self.text = "".join(self.parts)

    def turn(self) -> None:
        at, self.starts = 0, []
        for p in self.parts:
            self.starts.append(at)
            at += len(p)
        self.backwards = self.text[::-1]
        self.ends = sorted(at - s for s in self.starts[1:]) + [at]

    @functools.cached_property
    def letters(self) -> Letters:
        return Letters(self.lines)


#: Costs of a letter read as another that looks like it, and of any other difference.
LIKE, UNLIKE = 1, 2


def misread(word: str, text: str, most: int) -> int:
    """The least cost at which a scanner makes some part of ``text`` of ``word``, or more than ``most``."""
    if word in text:
        return 0
    n = len(text)
    before, last = None, [0] * (n + 1)
    for i, x in enumerate(word):
        row = [last[0] + UNLIKE]
        for j in range(1, n + 1):
            y = text[j - 1]
            cost = min(last[j - 1] + (0 if x == y else LIKE if frozenset((x, y)) in _MISREAD else UNLIKE), last[j] + UNLIKE, row[j - 1] + UNLIKE)
            if j > 1 and frozenset((x, text[j - 2 : j])) in _MISREAD:
                cost = min(cost, last[j - 2] + LIKE)
            if before is not None and frozenset((word[i - 1 : i + 1], y)) in _MISREAD:
                cost = min(cost, before[j - 1] + LIKE)
            row.append(cost)
        before, last = last, row
        if min(row) > most and min(before) > most:
            return most + 1
    return min(last)


def allowed(letters: int) -> int:
    """Cost up to which a word of so many letters is taken to be misread, not another."""
    return max(1 + letters // 6, min(letters, 2))


def _same_figures(word: str, page: Letters, low: int, high: int) -> bool:
    """Whether the page has a word with figures between two places, all figures the same and none before or after; one of them may be a letter that looks like it."""
    own, n = page.own, len(word)
    for p in range(max(0, low), min(high, len(own)) - n + 1):
        unlike = [k for k in range(n) if word[k] != own[p + k]]
        if len(unlike) > 1 or p in page.inner or p + n in page.inner:
            continue
        for k in unlike:
            x, y = word[k], own[p + k]
            if (x.isdigit() and y.isdigit()) or frozenset((x, y)) not in _MISREAD or (k and p + k in page.begins) or (k < n - 1 and p + k + 1 in page.begins):
                break  # another figure, or a letter of the neighbouring word
        else:
            return True
    return False


def _words_read(passage: Passage, page: Page, way: list[tuple[int, int, int]]) -> list[int]:
    """The words of the passage that the page has along ``way``, in order."""
    own, at = page.letters.own, page.letters.at
    mine, read, first = passage.letters.at, [], 0
    for k, (a, b) in enumerate(passage.spans):
        word = passage.own[k]
        if a == b:
            read.append(k)  # signs only: there is nothing to misread
            continue
        while first < len(way) and way[first][0] + way[first][2] <= a:
            first += 1
        met = []  # stretches of this word: places in it, in the page's own letters
        for x, y, n in way[first:]:
            if x >= b:
                break
            u, v = max(a, x), min(b, x + n)
            if u < v:
                met.append((mine[u] - mine[a], at[y + u - x], mine[v] - mine[a], at[y + v - x]))
        if not met:
            if 0 < first < len(way) and len(word) < 4 and not word.isdigit():  # a short word of which no letter is left
                x, y, n = way[first - 1]
                text = own[at[y + n] : at[way[first][1]]]
                if len(text) <= len(word) + 2 and misread(word, text, allowed(len(word))) <= allowed(len(word)):
                    read.append(k)
            continue
        low, high = met[0][1] - met[0][0], met[-1][3] + len(word) - met[-1][2]
        if any(c.isdigit() for c in word):
            if _same_figures(word, page.letters, low - 1, high + 1):
                read.append(k)
            continue
        text, begin = "", max(0, low - 1)
        for (_, _, u, p), (v, q, _, _) in zip(met, met[1:], strict=False):
            if q - p > 11:  # other lines inside a broken word
                text += own[begin : p + v - u]
                begin = q
        text += own[begin : high + 1]
        if misread(word, text, allowed(len(word))) <= allowed(len(word)):
            read.append(k)
    return read


def carried(passage: Passage, page: Page, seeds: list[tuple[int, int]], least: int = 1) -> int:
    """The most consecutive words of a passage that a page carries around one of the seeds (place in passage, in page), 0 for fewer than ``least``.

    From a seed the two texts are followed both ways as long as they agree but
    for what a scanner does; the words on the way are compared one by one.
    """
    most, done = 0, []
    text, size, length = passage.text, len(passage.text), len(page.text)
    for i, j in sorted(seeds, key=lambda seed: seed[1]):
        if done and done[0][2] < j - size - BREAK:  # too far back for this seed and all behind it
            done = [d for d in done if d[2] >= j - size - BREAK]
        if any(low <= i < high and abs(j - i - shift) < BREAK for low, high, shift in done):
            continue
        around = page.text[max(0, j - 30) : j + PIECE + 30]
        if sum(x >= 0 and text[x : x + 6] in around for x in (i - 18, i - 12, i - 6, i + 9, i + 15, i + 21)) < 2:
            continue  # a shared name and no more
        ahead = _extend(text, i, page.text, j, page.starts)
        back = [(size - x - n, length - y - n, n) for x, y, n in _extend(passage.backwards, size - i, page.backwards, length - j, page.ends)]
        way = [step for step in (*back[::-1], *ahead) if step[2]]
        low, high = way[0][0], way[-1][0] + way[-1][2]
        done.append((low, high, j - i))
        if bisect.bisect_left(passage.starts, high) - bisect.bisect_right(passage.ends, low) < least:
            continue  # so many words aren't even touched
        run, last = 0, -2
        for k in _words_read(passage, page, way):
            run, last = (run + 1 if k == last + 1 else 1), k
            most = max(most, run)
    return most if most >= least else 0


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 14) -> DataFrame:
    """(doc_id, item_id, n_words): pages that carry at least ``words`` consecutive words of a passage.

    Pages are read column by column where boxes are given.  Null, empty and
    short texts carry nothing; an item without text, or of fewer words, is
    found nowhere.  Repeated pages are each given out.  Items are read by the
    driver in blocks of ``BLOCK_LETTERS``, one at a time, and pages are
    searched once per block.
    """
    rows = items.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    boxes = "page_lines" in documents.columns
    empty = F.lit(None).cast("array<int>")
    pages = documents.where(F.length("text") >= 2 * words - 1).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.col("page_lines.x0") if boxes else empty).alias("x0"), (F.col("page_lines.y0") if boxes else empty).alias("y0")
    )
    out, block, size = None, [], 0
    for r in rows.toLocalIterator():  # held-out items: a set of stated size, not the corpus; one block at a time
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > BLOCK_LETTERS:
            part = _search(pages, block, words)
            out, block, size = part if out is None else out.unionByName(part), [], 0
    last = _search(pages, block, words)
    return last if out is None else out.unionByName(last) if block else out


_machines: dict[str, tuple[list[Passage], WuManber]] = {}


def _machine(key: str, block: list[tuple[int, str]], words: int) -> tuple[list[Passage], WuManber]:
    """Passages and search of a block, built once in each worker."""
    if key not in _machines:
        _machines.clear()
        passages = [Passage(i, t) for i, t in block if len(t.split()) >= words]
        _machines[key] = passages, WuManber(pieces_of(passages, words))
    return _machines[key]


def _search(pages: DataFrame, block: list[tuple[int, str]], words: int) -> DataFrame:
    shared, key = pages.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, machine = _machine(key, shared.value, words)
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts, xs, ys = (part.column(k).to_pylist() for k in range(4))
                read = [Page(reading_order(t, x, y)) for t, x, y in zip(texts, xs, ys, strict=True)]
                starts = np.cumsum([0, *(len(p.text) + 1 for p in read)])
                joined = "|".join(p.text for p in read)  # no piece holds the sign between pages
                where: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for place, piece in machine.hits(joined):
                    page = int(np.searchsorted(starts, place, side="right")) - 1
                    for k, i in machine.pieces[piece]:
                        where.setdefault((page, k), []).append((i, place - int(starts[page])))
                turned = set()
                for (page, k), seeds in where.items():
                    if page not in turned:
                        read[page].turn()
                        turned.add(page)
                    n = carried(passages[k], read[page], seeds, words)
                    if n >= words:
                        out.append((ids[page], passages[k].item_id, n))
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])
                yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64())]), preserve_index=False)

    return pages.mapInArrow(run, "doc_id bigint, item_id bigint, n_words bigint")
