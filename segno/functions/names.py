"""One plain form for names, and the identity of artists and recordings.

``plain`` undoes everything that changes a name's characters but not its looks:
compatibility widths and ligatures, decomposed accents, invisible characters,
unusual blanks, and letters borrowed from a look-alike script.  ``artist_key``
and ``recording_key`` build comparison keys on top of it.

All functions are pure; the column wrappers at the end run them on Arrow
batches, once per distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of two scripts that are drawn alike in common fonts.
LATIN_OF_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсуѕхԁһԛԝӏ", "ABESIJKMHOPCTYXaeijopcysxdhqwl", strict=True))
LATIN_OF_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
TO_LATIN = LATIN_OF_CYRILLIC | LATIN_OF_GREEK
TO_CYRILLIC = {latin: c for c, latin in reversed(LATIN_OF_CYRILLIC.items())}
TO_GREEK = {latin: g for g, latin in reversed(LATIN_OF_GREEK.items())}
for _g, _latin in LATIN_OF_GREEK.items():
    if _latin in TO_CYRILLIC:
        TO_CYRILLIC.setdefault(_g, TO_CYRILLIC[_latin])
for _c, _latin in LATIN_OF_CYRILLIC.items():
    if _latin in TO_GREEK:
        TO_GREEK.setdefault(_c, TO_GREEK[_latin])
INTO = {"latin": TO_LATIN, "cyrillic": TO_CYRILLIC, "greek": TO_GREEK}

_ZWJ = "‍"
_EMOJI_AROUND = re.compile("(?<=[←-⯿️\U0001f000-\U0001faff])‍(?=[←-⯿\U0001f000-\U0001faff])")
_SELECTOR = re.compile("(?<=[©®‼-⯿〰〽㊗㊙\U0001f000-\U0001faff])️")
_BLANKS = re.compile(r"\s+")


@lru_cache(4096)
def script_of(ch: str) -> str | None:
    """latin, cyrillic, greek, another script's name, or None where the character has none."""
    if not ch.isalpha():
        return None
    word = unicodedata.name(ch, "").split(" ", 1)[0].lower()
    return None if word in {"modifier", "feminine", "masculine"} else word


@lru_cache(4096)
def scripts_for(ch: str) -> frozenset[str] | None:
    """Scripts in which a letter of this look exists; None for characters of no script."""
    own = script_of(unicodedata.normalize("NFD", ch)[0])
    if own is None:
        return None
    base = unicodedata.normalize("NFD", ch)[0]
    return frozenset({own, *(s for s, table in INTO.items() if base in table)})


def _is_wide(ch: str) -> bool:
    return unicodedata.decomposition(ch).split(" ", 1)[0] in {"<wide>", "<narrow>"}


def _is_ligature(ch: str) -> bool:
    return "ﬀ" <= ch <= "ﬆ" or ch in "ĲĳŉſǆǅǄǉǈǇǌǋǊ"


def _is_invisible(ch: str) -> bool:
    return unicodedata.category(ch) in {"Cf", "Cc"} and not ch.isspace() or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️"


def tidy(text: str) -> str:
    """Composed accents, ordinary widths and blanks, no ligatures, nothing invisible.  Signs that look different (½ ² ™ … №) and emoji stay."""
    if text.isascii() and text.isprintable():
        return text if not text.startswith(" ") and not text.endswith(" ") and "  " not in text else _BLANKS.sub(" ", text).strip()
    joined = {m.start() for m in _EMOJI_AROUND.finditer(text)} | {m.start() for m in _SELECTOR.finditer(text)}
    out = []
    for i, ch in enumerate(text):
        if ch.isascii() and ch.isprintable():
            out.append(ch)
        elif ch.isspace():
            out.append(" ")
        elif i in joined:
            out.append(ch)
        elif _is_invisible(ch):
            continue
        elif _is_wide(ch) or _is_ligature(ch):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return _BLANKS.sub(" ", unicodedata.normalize("NFC", "".join(out))).strip()


def _respell(token: str, script: str) -> str:
    table = INTO[script]
    marks = unicodedata.normalize("NFD", token)
    return unicodedata.normalize("NFC", "".join(table.get(c, c) if script_of(c) not in (None, script) else c for c in marks))


_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def one_script(text: str) -> str:
    """Spell each word of tidy text in the one script its letters allow.

    The script sets of a word's letters are intersected.  A word of several
    scripts takes the script left over, the name's main one when several are.
    A word wholly of look-alikes stays, unless all other letters of the name
    are of one script that can also spell it.
    """
    if text.isascii():
        return text
    words = [m for m in _WORD.finditer(text)]
    own = [{script_of(unicodedata.normalize("NFD", c)[0]) for c in m.group()} - {None} for m in words]
    allowed = [frozenset.intersection(*(s for c in m.group() if (s := scripts_for(c)) is not None)) if o else frozenset() for m, o in zip(words, own, strict=True)]
    votes: dict[str, int] = {}
    for m, a in zip(words, allowed, strict=True):
        if len(a) == 1:
            votes[next(iter(a))] = votes.get(next(iter(a)), 0) + len(m.group())
    main = max(votes, key=lambda s: (votes[s], s == "latin")) if votes else "latin"
    parts, at = [], 0
    for m, o, a in zip(words, own, allowed, strict=True):
        word = m.group()
        if len(o) > 1 and a:
            word = _respell(word, main if main in a else "latin" if "latin" in a else sorted(a)[0])
        elif len(o) == 1 and len(votes) == 1 and main not in o and main in a and main in INTO:
            word = _respell(word, main)
        parts += [text[at : m.start()], word]
        at = m.end()
    return "".join([*parts, text[at:]])


def plain(text: str) -> str:
    """The plain spelling of a name; equal-looking names become equal."""
    return one_script(tidy(text))


def artist_key(name: str | None) -> str | None:
    """Key of an artist's name: plain, caseless, without a leading "the"; accents count.  None for null, empty or blank."""
    if name is None:
        return None
    key = unicodedata.normalize("NFC", plain(name).casefold())
    if key.startswith("the ") and len(key) > 4:
        key = key[4:]
    return key or None


# Words that mark a note as being of no weight, or a version of its own.
GUEST = {"feat", "ft", "featuring", "with"}
MASTER = {"remastered", "remaster", "explicit", "version", "edition", "mono", "stereo", "mix"}
VERSIONS = ("live", "remix", "demo", "reprise", "acoustic", "instrumental", "unplugged", "edit", "rework", "dub", "karaoke", "session", "alternate", "outtake")
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")

_NOTE = re.compile(r"[(\[]([^()\[\]]*)[)\]]")
_DASH = re.compile(r"\s[-–—]\s+([^-–—]+)$")
_GUEST_TAIL = re.compile(r"\s(?:feat|ft|featuring)\b\.?\s.*$")
_NUMBER = re.compile(r"^\s*[\"'(]?\d{1,3}[.)\s-]+\s*(?=\S)")
_PART = re.compile(r"\b(?:pt|part|vol|volume|no|nr|chapter)\b\.?\s*(\d+|[ivx]+)\b|\s([ivx]+|\d+)\s*$")
_ALNUM = re.compile(r"[\W_]+")
DASHES = str.maketrans("‐‑‒–—―−", "-------")


def one_slip(a: str, b: str) -> bool:
    """Equal, or one letter wrong, missing, added or exchanged with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(a) < 4:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


def _like(word: str, options) -> bool:
    return any(word == o or len(o) > 4 and one_slip(word, o) for o in options)


def _kind(note: str) -> str:
    words = [w for w in _ALNUM.sub(" ", note).split() if w]
    if not words:
        return "none"
    if any(_like(w, VERSIONS) for w in words):
        return "version"
    if words[0] in GUEST:
        return "none"
    if any(_like(w, MASTER) for w in words) and all(_like(w, MASTER) or w.isdigit() for w in words):
        return "none"
    return "text"


def _numeral(word: str) -> str:
    return str(ROMAN.index(word) + 1) if word in ROMAN else word


def recording_key(track: str | None) -> tuple[str, str] | None:
    """(base, mark) of a track title; None for null, empty or blank.

    ``base`` holds the title's letters and digits without case, blanks and
    punctuation, less a leading track number and notes on guests, explicit
    content or remastering.  ``mark`` holds what makes a recording of its own:
    the version note and the part number.  Two titles are the same recording
    when the marks are equal and the bases differ by one slip at most.
    """
    if track is None:
        return None
    text = plain(track).casefold().translate(DASHES).replace("&", " and ").replace("’", "'").replace("…", "...")
    whole = _ALNUM.sub("", text)
    if not whole:
        return (text.strip(), "") if text.strip() else None
    text = text.strip(" \"“”'.!")
    cut = _NUMBER.sub("", text)
    if cut and _ALNUM.sub("", cut) and not cut[0].isdigit():
        text = cut
    marks: list[str] = []

    def note(m: re.Match) -> str:
        kind = _kind(m.group(1))
        if kind == "version":
            # guest or remastering notes may follow inside one note after a dash
            marks.append(_ALNUM.sub("", m.group(1)))
        return " " if kind != "text" else m.group(0)

    text = _NOTE.sub(note, text)
    text = _GUEST_TAIL.sub("", text.rstrip())
    for _ in range(3):
        m = _DASH.search(text.rstrip(" \"'.!"))
        if not m or (kind := _kind(m.group(1))) == "text":
            break
        if kind == "version":
            marks.append(_ALNUM.sub("", _GUEST_TAIL.sub("", m.group(1))))
        text = text[: m.start()]
    text = text.strip(" \"“”'.!")
    m = _PART.search(text)
    if m and m.start():
        marks.append("#" + _numeral(m.group(1) or m.group(2)))
        text = text[: m.start()] + text[m.end() :]
    base = _ALNUM.sub("", text) or whole
    return base, "|".join(sorted(marks))


def same_recording(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether two (base, mark) keys of one artist denote one recording."""
    if a == b:
        return True
    if a[1] != b[1] and not (one_slip(a[1], b[1]) and [c for c in a[1] if c.isdigit()] == [c for c in b[1] if c.isdigit()] and "#" not in a[1] + b[1]):
        return False
    return one_slip(a[0], b[0]) and [c for c in a[0] if c.isdigit()] == [c for c in b[0] if c.isdigit()]


class Memo:
    """A bounded memo of a function of one string, kept by each Python worker."""

    def __init__(self, fn, most: int = 200_000):
        self.fn, self.most, self.known = fn, most, {}

    def __call__(self, value):
        try:
            return self.known[value]
        except KeyError:
            if len(self.known) >= self.most:
                self.known.clear()
            out = self.known[value] = self.fn(value)
            return out

    def over(self, values) -> list:
        return [None if v is None else self(v) for v in values]


_artist_memo, _recording_memo, _plain_memo = Memo(artist_key), Memo(recording_key), Memo(plain)


def artist_key_col(name: Column) -> Column:
    @F.pandas_udf("string")
    def keyed(s: pd.Series) -> pd.Series:
        return pd.Series(_artist_memo.over(s), dtype=object)

    return keyed(name)


def play_keys_col(artist: Column, track: Column) -> Column:
    """struct<artist_key, base, mark> of a play; fields are null where the play has no such key."""

    @F.pandas_udf("artist_key string, base string, mark string")
    def keyed(a: pd.Series, t: pd.Series) -> pd.DataFrame:
        keys = [k or (None, None) for k in _recording_memo.over(t)]
        return pd.DataFrame({"artist_key": _artist_memo.over(a), "base": [k[0] for k in keys], "mark": [k[1] for k in keys]}, dtype=object)

    return keyed(artist, track)


def plain_col(name: Column) -> Column:
    @F.pandas_udf("string")
    def spelled(s: pd.Series) -> pd.Series:
        return pd.Series(_plain_memo.over(s), dtype=object)

    return spelled(name)
