"""Languages of pages and of their stretches, by prediction by partial matching.

A tree of byte contexts is counted for each language.  A byte costs the bits
of its share in the longest known context, plus those of the escapes from
longer ones (method C: a context escapes as often as it has seen different
bytes).  Counts are frozen after fitting, so code lengths are exact and the
same for a text wherever it stands.  Lines are put into stretches of one
language each by the cheapest path, a change of language costing bits too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.llm.pages import reading_order

#: Bytes of context.
ORDER = 4
#: Pages of each language that the models are fitted on; the bound of the sample.
SAMPLE = 150
#: Letters of the longest page that may be in the sample, which the driver holds.
LONGEST = 20_000
#: Bits of a byte that nothing is known of.
UNKNOWN = 12.0
#: Bits that a change of language between two lines costs.
SWITCH = 24.0
#: A stretch is in a language if its bits a letter are at most so many times those of the fitted pages.
SLACK = 1.45

# Languages by code, and what else they are called in labels.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
CODES = tuple(NAMES)
_OF = {name: code for code, names in NAMES.items() for name in names}

_WORDS = re.compile(r"[^\W\d_]+").findall
_TOKENS = re.compile(r"\S*?[^\W\d_]\S*").findall
_HYPHEN = "-=¬‐­"


def code_of(label: Column) -> Column:
    """The language code a label means, in whatever notation; null where it means none of the eight."""
    stem = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    known = F.create_map(*[F.lit(x) for pair in _OF.items() for x in pair])
    return known[stem]


class Models:
    """Frozen context trees of several languages, as one table of bits: gram → a row of code lengths."""

    def __init__(self, texts: dict[str, list[str]], final: bool = True):
        self.codes = tuple(c for c in CODES if texts.get(c))
        trees = [self._count(texts[c]) for c in self.codes]
        grams = sorted(set().union(*(t[0] for t in trees)) if trees else set(), key=lambda g: (len(g), g))
        self.rows = rows = {g: k for k, g in enumerate(grams)}
        self.bits = np.zeros((len(grams) + 1, len(self.codes)), dtype=np.float32)
        self.bits[-1] = UNKNOWN  # a byte that no language has
        # contexts are numbered once for all languages; a gram's shorter one may be known to none
        contexts: dict[bytes, int] = {}
        context = np.fromiter((contexts.setdefault(g[:-1], len(contexts)) for g in grams), dtype=np.int64, count=len(grams))
        shorter = np.fromiter((rows.get(g[1:], -1) for g in grams), dtype=np.int64, count=len(grams))
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        levels = [np.flatnonzero(sizes == n) for n in range(1, ORDER + 2)]
        for at, (counts, seen, total) in enumerate(trees):
            n = np.fromiter((counts.get(g, 0) for g in grams), dtype=np.float64, count=len(grams))
            met = np.fromiter((seen.get(c, 0) for c in contexts), dtype=np.float64, count=len(contexts))[context]
            both = np.fromiter((total.get(c, 0) for c in contexts), dtype=np.float64, count=len(contexts))[context] + met
            cost = np.zeros(len(grams) + 1)
            cost[-1] = UNKNOWN
            for level in levels:  # shorter ones come first
                own, whole, kinds = n[level], both[level], met[level]
                known = np.log2(np.maximum(whole, 1) / np.maximum(own, 1))
                if level.size and sizes[level[0]] == 1:
                    other = np.log2(np.maximum(whole, 2) / np.maximum(kinds, 1)) + 8.0
                else:
                    other = np.where(whole > 0, np.log2(np.maximum(whole, 1) / np.maximum(kinds, 1)), 0.0) + cost[shorter[level]]
                cost[level] = np.where(own > 0, known, other)
            self.bits[:-1, at] = cost[:-1]
        self.typical = np.ones(len(self.codes))
        for at, c in enumerate(self.codes) if final else ():
            bits = letters = 0.0
            for w, n in Counter(w for t in texts[c] for w in _WORDS(t.lower())).most_common(5000):
                bits += n * float(self.word(w)[at])
                letters += n * (len(w) + 1)
            self.typical[at] = bits / max(1.0, letters)

    @staticmethod
    def _count(texts: list[str]) -> tuple[Counter, Counter, Counter]:
        words = Counter(w for t in texts for w in _WORDS(t.lower()))
        counts: Counter = Counter()
        for word, n in words.items():
            b = b" " + word.encode() + b" "
            for k in range(1, len(b)):
                for start in range(max(0, k - ORDER), k + 1):
                    counts[b[start : k + 1]] += n
        counts = Counter({g: n for g, n in counts.items() if n > 1 or len(g) < 4})  # what was seen once in a long context is chance
        seen, total = Counter(), Counter()
        for g, n in counts.items():
            seen[g[:-1]] += 1
            total[g[:-1]] += n
        return counts, seen, total

    def word(self, word: str) -> np.ndarray:
        """Bits of a word, and the blank after it, in each language."""
        b = b" " + word.encode("utf-8", "replace") + b" "
        rows, at = self.rows, []
        for k in range(1, len(b)):
            for start in range(max(0, k - ORDER), k + 1):
                row = rows.get(b[start : k + 1])
                if row is not None:
                    break
            at.append(-1 if row is None else row)
        return self.bits[at].sum(axis=0)


class Reader:
    """Splits pages into stretches; remembers the bits of words it has met."""

    def __init__(self, models: Models, most: int = 150_000):
        self.models, self.most = models, most
        self._begin()

    def _begin(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.zeros((self.most + 5000, len(self.models.codes)), dtype=np.float32)

    def costs(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each line in each language, and letters of each line."""
        if len(self.at) > self.most:
            self._begin()
        rows, ends, letters = [], [], []
        at = self.at
        for line in lines:
            words = _WORDS(line.lower())
            for w in words:
                k = at.get(w)
                if k is None:
                    k = len(at)
                    if k >= len(self.known):
                        self.known = np.concatenate([self.known, np.zeros_like(self.known)])
                    at[w] = k
                    self.known[k] = self.models.word(w)
                rows.append(k)
            ends.append(len(rows))
            letters.append(sum(map(len, words)) + len(words))
        if not rows:
            return np.zeros((len(lines), len(self.models.codes))), np.array(letters, dtype=float)
        sums = np.vstack([np.zeros(len(self.models.codes)), np.cumsum(self.known[rows], axis=0, dtype=np.float64)])
        return np.diff(sums[[0, *ends]], axis=0), np.array(letters, dtype=float)

    def stretches(self, lines: list[str]) -> list[tuple[str, int, int, int, float]]:
        """(language, first line, last line, words, confidence) of each stretch; lines count from 0.  Stretches in no known language are left out."""
        codes = self.models.codes
        if not codes or not lines:
            return []
        cost, letters = self.costs(lines)
        path = _cheapest(cost)
        words = _count_words(lines)
        out, start = [], 0
        for k in range(1, len(lines) + 1):
            if k < len(lines) and path[k] == path[start]:
                continue
            lang, total = path[start], cost[start:k].sum(axis=0)
            size = letters[start:k].sum()
            if size and total[lang] <= SLACK * self.models.typical[lang] * size:
                # how far the next best language is behind, in bits for each word
                n = max(1, sum(words[start:k]))
                behind = (total - total[lang]) / n
                out.append((codes[lang], start, k - 1, sum(words[start:k]), float(1.0 / np.exp2(-behind).sum())))
            start = k
        return out


def _cheapest(cost: np.ndarray) -> list[int]:
    """The language of each line on the cheapest path."""
    whole = int(cost.sum(axis=0).argmin())
    if (cost[:, whole] - cost.min(axis=1)).sum() < SWITCH:  # no change can pay
        return [whole] * len(cost)
    best, back = cost[0].copy(), []
    for row in cost[1:]:
        low = int(best.argmin())
        change = best[low] + SWITCH < best
        back.append(np.where(change, low, np.arange(len(best))))
        best = np.where(change, best[low] + SWITCH, best) + row
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _count_words(lines: list[str]) -> list[int]:
    """Words of each line, parted by blanks; the rest of a word broken at the line before isn't another."""
    out, broken = [], False
    for line in lines:
        n = len(_TOKENS(line))
        out.append(n - 1 if broken and n else n)
        end = line.rstrip()
        if end:
            broken = end[-1] in _HYPHEN and len(end) > 1 and end[-2].isalpha()
    return out


def fit(documents: DataFrame, sample: int = SAMPLE) -> Models:
    """Models of the languages that labels name, fitted on at most ``sample`` labelled pages of each.

    The pages, of 200 to ``LONGEST`` letters, are those of the smallest hash of their id.  After a first fit
    the lines that another language explains better are taken out (labels are
    partly wrong, and pages mixed), and the models are fitted again.
    """
    labelled = documents.where(F.length("text").between(200, LONGEST)).select("doc_id", code_of(F.col("lang")).alias("code")).where("code IS NOT NULL")
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).groupBy("doc_id").agg(F.min("code").alias("code"))
    texts = documents.where(F.length("text").between(200, LONGEST)).select("doc_id", "text", F.col("page_lines.x0").alias("x0"), F.col("page_lines.y0").alias("y0"))
    # at most 8 * sample rows, broadcast and then brought here
    picked = texts.join(F.broadcast(chosen), "doc_id")
    pages: dict[str, list[list[str]]] = {}
    seen: set[int] = set()
    for r in sorted(picked.collect(), key=lambda r: (r["doc_id"], r["text"])):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            pages.setdefault(r["code"], []).append(reading_order(r["text"], r["x0"], r["y0"]))
    first = Models({c: ["\n".join(p) for p in ps] for c, ps in pages.items()}, final=False)
    reader, clean = Reader(first, 50_000), {}
    for c, ps in pages.items():
        for p in ps:
            kept = [line for line, at in zip(p, _cheapest(reader.costs(p)[0]), strict=True) if first.codes[at] == c]
            if len(kept) * 2 > len(p):
                clean.setdefault(c, []).append("\n".join(kept))
    return Models(clean)


def language_stretches(documents: DataFrame, models: Models) -> DataFrame:
    """(doc_id, label, lang, first_line, last_line, n_words, confidence): stretches of one language, lines in reading order from 0.

    Null, empty and blank texts have none, nor have stretches of figures or
    bare names.  Texts of any length are read whole.  Repeated pages are each read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    rows = documents.where(F.length(F.trim("text")) > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("label"), "text", F.col("page_lines.x0").alias("x0"), F.col("page_lines.y0").alias("y0"))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("n_words", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for doc, label, text, x, y in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    out += [(doc, label, *s) for s in reader.stretches(reading_order(text, x, y))]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), schema=schema, preserve_index=False)

    return rows.mapInArrow(run, "doc_id bigint, label string, lang string, first_line int, last_line int, n_words int, confidence double")


def page_languages(stretches: DataFrame, least: int = 25) -> DataFrame:
    """(doc_id, label, langs): languages of at least ``least`` words on a page, with words and confidence; pages without any are left out."""
    by = stretches.groupBy("doc_id", "label", "lang").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.greatest(F.sum("n_words"), F.lit(1))).alias("confidence"))
    return by.where(F.col("n_words") >= least).groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(F.struct("lang", "n_words", "confidence"))).alias("langs"))


def wrong_labels(pages: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, confidence): the languages of pages whose label is missing, names another language or can't name all."""
    right = (F.size("langs") == 1) & (F.col("langs")[0]["lang"] == code_of(F.col("label")))
    return pages.where(~F.coalesce(right, F.lit(False))).select("doc_id", F.inline("langs"))
