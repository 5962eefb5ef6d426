"""Evaluation passages that documents carry, wholly or in part.

Items and documents are brought to templates: case, punctuation, markup,
invisible characters and line breaks go; numbers, units, code names and proper
names become typed placeholders.  Windows of template words of the items are
hashed and joined with the documents' windows: by a hash table sent to every
task where it is proven small, by a shuffle otherwise.  Where windows of an item
meet a document in the item's order, the passage around them is checked word by
word.  A word agrees if it is the same; a slot also agrees if its value stands
for the item's value throughout the passage, so a question with other numbers or
names is recognised, and told from one that merely shares its wording.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import map_columns

#: Template words in a window.
WINDOW = 3
#: Windows may lie so many words apart within one passage; a passage starts and ends so many words around its windows.
GAP, MARGIN = 10, 4
#: Share of an item's words that a document must hold.
HELD = 0.4
#: The windows that follow each other in the item's order must cover so many of its words, and this share of them.
COVERED, COVERED_SHARE = 5, 0.15
#: Slots replace values consistently if this share of them agrees with the most usual replacement.
CONSISTENT = 0.8
#: Leading words that at least so many items share are an instruction.
SHARED_BY = 3
#: Items are sent to every task if their texts have at most so many bytes; beyond, windows are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_INVISIBLE = re.compile(r"[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￼]")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\r?\n[ \t]*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_INNER = re.compile(r"(?<=[a-z0-9,;] )([A-Z][a-z]+)\b")
_LETTERS = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "ı": "i", "ł": "l", "ø": "o", "ß": "ss"})

# Units of quantities.
UNITS = frozenset(
    "ms us ns s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "b kb mb gb tb kib mib gib byte bytes bit bits px pt em percent pct hz khz mhz ghz m cm mm km kg g tick ticks step steps times".split()
)


def clean(text: str) -> str:
    """A text without markup, invisible characters, accents and compatibility forms; case is as it was."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(_LETTERS)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    return text


def words_of(text: str) -> list[str]:
    """The words of a text, folded: compatibility forms, accents, case, markup and invisible characters are gone."""
    return _WORD.findall(clean(text).lower())


def named_words(text: str) -> tuple[list[str], set[str]]:
    """The folded words, and those of them that are proper names: written with a capital wherever they stand, and not as the first of a sentence only."""
    text = clean(text)
    words = _WORD.findall(text)
    low = _WORD.findall(text.lower())
    if len(words) != len(low):  # folding changed a word boundary
        return low, set()
    inside = {m.group(1).lower() for m in _INNER.finditer(text)}
    small = {w for w in words if not w[0].isupper()}
    return low, {x for w, x in zip(words, low) if w[0].isupper() and w[1:].islower() and x in inside and x not in small}


def template_of(word: str, names: set[str] | frozenset[str] = frozenset()) -> str:
    """A word, or the placeholder of its type."""
    if word[0].isdigit():
        return "<n>" if word.isdigit() else "<q>"
    if word in UNITS:
        return "<u>"
    if word in names or any(map(str.isdigit, word)):
        return "<name>"
    return word


def instruction_lengths(items: list[list[str]], shared_by: int = SHARED_BY) -> list[int]:
    """How many leading words of each item belong to an instruction that several items share.

    Items share at least five leading words for that; the instruction ends where
    fewer than half of those that share five still agree.
    """
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, w in enumerate(items):
        groups[tuple(w[:5])].append(i)
    out = [0] * len(items)
    for members in groups.values():
        least = max(shared_by, len(members) / 2)
        going = [i for i in members if len(items[i]) >= 5]
        n = 5
        while len(going) >= least:
            nexts = defaultdict(list)
            for i in going:
                out[i] = n
                if len(items[i]) > n:
                    nexts[items[i][n]].append(i)
            going = max(nexts.values(), key=len, default=[])
            n += 1
    return [k if k < len(w) else 0 for k, w in zip(out, items)]


class Items:
    """The items' words, and an index of their template windows."""

    def __init__(self, rows: list[tuple[int, str]], skip: list[int] | None = None):
        named = [named_words(t) for _, t in rows]
        skip = instruction_lengths([w for w, _ in named]) if skip is None else skip
        self.ids = [i for i, _ in rows]
        self.words = [w[n:] for (w, _), n in zip(named, skip)]
        self.names = [names for _, names in named]
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for window, at in item_windows(w, self.names[k]):
                self.index[window].append((k, at))
        self.vocabulary = {x for window in self.index for x in window.split(" ")}


def item_windows(words: list[str], names: set[str]) -> list[tuple[str, int]]:
    """The template windows of an item and where they start, with its names as they are and as placeholders."""
    out = []
    for known in (frozenset(), names):
        t = [template_of(x, known) for x in words]
        out += [(" ".join(t[i : i + WINDOW]), i) for i in range(len(t) - WINDOW + 1)]
    return sorted(set(out), key=lambda x: x[1])


def text_windows(words: list[str], names: set[str], vocabulary=None):
    """``(window, at)`` of a text, windows with a word outside ``vocabulary`` aside; both readings where a window holds a name."""
    plain = [template_of(x) for x in words]
    typed = [("<name>" if x in names else t) for x, t in zip(words, plain)] if names else plain
    known = (lambda t: t in vocabulary) if vocabulary is not None else (lambda t: True)
    for t in (plain, typed) if names else (plain,):
        a, b = (known(t[0]), known(t[1])) if len(t) > 2 else (False, False)
        for i in range(len(t) - 2):
            c = known(t[i + 2])
            if a and b and c and (t is plain or t[i : i + 3] != plain[i : i + 3]):
                yield f"{t[i]} {t[i + 1]} {t[i + 2]}", i
            a, b = b, c


def chain(met: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``(text position, item position)`` in which both grow."""
    tails: list[int] = []
    keys: list[int] = []
    before: list[int] = [-1] * len(met)
    met = sorted(set(met), key=lambda x: (x[0], -x[1]))
    for n, (_, item) in enumerate(met):
        at = bisect_left(keys, item)
        before[n] = tails[at - 1] if at else -1
        if at == len(keys):
            keys.append(item)
            tails.append(n)
        else:
            keys[at], tails[at] = item, n
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(met[n])
        n = before[n]
    return out[::-1]


def common(place: dict[str, int], length: int, words: list[str]) -> int:
    """How many of the item's words a longest common subsequence with ``words`` holds."""
    full = (1 << length) - 1
    v = full
    for x in words:
        m = place.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def replacements(item: list[str], names: set[str], words: list[str], links: list[tuple[int, int]]) -> tuple[dict[str, str], int, int]:
    """What stands for the values of the item's slots in a passage, how many slots agree with that, and how many there are.

    ``links`` says which words of the text stand where those of the item do.
    A value that two values of the item would share is no replacement.
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    for at, i in links:
        for d in range(WINDOW):
            if i + d < len(item) and at + d < len(words) and template_of(item[i + d], names).startswith("<"):
                votes[item[i + d]][words[at + d]] += 1
    best = {x: c.most_common(1)[0] for x, c in votes.items()}
    taken = Counter(v for v, _ in best.values())
    agree = sum(n for x, (v, n) in best.items() if taken[v] == 1 or v == x)
    total = sum(sum(c.values()) for c in votes.values())
    return {v: x for x, (v, _) in best.items() if taken[v] == 1}, agree, total


def verify(item: list[str], names: set[str], words: list[str], met: list[tuple[int, int]]) -> tuple[float, int, int] | None:
    """``share, agreeing slots, slots`` if a text carries an item whose windows it met; else None."""
    n = len(item)
    found: tuple[float, int, int] | None = None
    met.sort()
    passage: list[str] = []
    links: list[tuple[int, int]] = []
    covered: set[int] = set()
    start = 0
    while start < len(met):  # passages are runs of windows with small gaps between them
        end = start + 1
        while end < len(met) and met[end][0] - met[end - 1][0] <= GAP:
            end += 1
        run = chain(met[start:end])
        own = {i + d for _, i in run for d in range(WINDOW)}
        if len(own) >= min(n, COVERED):
            passage += words[max(0, run[0][0] - MARGIN) : run[-1][0] + WINDOW + MARGIN]
            links += run
            covered |= own
        start = end
    if len(covered) < max(min(n, COVERED), COVERED_SHARE * n):
        return None
    place: dict[str, int] = {}
    for at, x in enumerate(item):
        place[x] = place.get(x, 0) | 1 << at
    share = common(place, n, passage) / n
    replaced, agree, total = replacements(item, names, words, links)
    if share < HELD and total and agree >= CONSISTENT * total:  # the same text with other values
        share = common(place, n, [replaced.get(x, x) for x in passage]) / n
    if share >= HELD:
        found = (share, agree, total)
    return found


class _Templates(dict):
    """The templates of the words seen so far, names aside."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = t = template_of(word)
        return t


_TEMPLATES = _Templates()


def match(items: Items, text: str) -> list[tuple[int, float, int, int]]:
    """``(item, share, agreeing slots, slots)`` of the items a text carries."""
    words = words_of(text)
    get, vocabulary = items.index.get, items.vocabulary
    t = list(map(_TEMPLATES.__getitem__, words))
    hits: dict[int, list[tuple[int, int]]] = {}
    a = b = ""  # the two words before, if they are known
    for at, c in enumerate(t, 1 - WINDOW):
        if c not in vocabulary:
            c = ""
        elif a and b:
            for k, i in get(f"{a} {b} {c}", ()):
                hits.setdefault(k, []).append((at, i))
        a, b = b, c
    if any(items.names[k] for k in hits):  # only then can a name stand for another
        low, names = named_words(text)
        if names and len(low) == len(words):
            for window, at in text_windows(words, names, vocabulary):
                for k, i in get(window, ()):
                    if k in hits:
                        hits[k].append((at, i))
    found = []
    for k, met in hits.items():
        met = list(set(met))
        if len(met) * WINDOW < 0.3 * len(items.words[k]):  # too few to cover the share with the words next to them
            continue
        got = verify(items.words[k], items.names[k], words, met)
        if got:
            found.append((k, *got))
    return found


def _columns(key: str) -> dict[str, list]:
    return {key: [], "item_id": [], "held": [], "slots_kept": [], "slots": []}


def _match_all(rows: list[tuple[int, str]], key: str):
    state: list[Items] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not state:
            state.append(Items(rows))
        items = state[0]
        out = _columns(key)
        for doc, text in zip(cols[key], cols["text"]):
            for k, *got in match(items, text) if text else ():
                for name, value in zip(out, (doc, items.ids[k], *got)):
                    out[name].append(value)
        return out

    return run


def _hash(window: str) -> int:
    return xxhash.xxh3_64_intdigest(window) - (1 << 63)


def _item_rows(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"item_id": [], "text": [], "skip": [], "h": []}
    for i, text, skip in zip(cols["item_id"], cols["text"], cols["skip"]):
        words, names = named_words(text)
        for h in {_hash(x) for x, _ in item_windows(words[skip:], names)}:
            for name, value in zip(out, (i, text, skip, h)):
                out[name].append(value)
    return out


def _text_rows(key: str):
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: [], "h": []}
        for doc, text in zip(cols[key], cols["text"]):
            words, names = named_words(text)
            hashes = {_hash(x) for x, _ in text_windows(words, names)}
            out[key] += [doc] * len(hashes)
            out["h"] += hashes
        return out

    return run


def _verify_all(key: str):
    def run(cols: dict[str, list]) -> dict[str, list]:
        out = _columns(key)
        for doc, text, i, item, skip in zip(*(cols[c] for c in (key, "text", "item_id", "item", "skip"))):
            one = Items([(i, item)], [skip])
            for _, *got in match(one, text):
                for name, value in zip(out, (doc, i, *got)):
                    out[name].append(value)
        return out

    return run


def _skips(cols: dict[str, list]) -> dict[str, list]:
    words = [words_of(t) for t in cols["text"]]
    return {"item_id": cols["item_id"], "text": cols["text"], "head": [" ".join(w[:5]) for w in words], "words": words}


def shuffled_leaks(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The matches by joins alone, for items of any number: windows are joined by their hashes, texts only for what met often enough."""
    kind = dict(documents.dtypes)[key]
    headed = map_columns(items, _skips, "item_id bigint, text string, head string, words array<string>")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"item_id": group["item_id"], "text": group["text"], "skip": instruction_lengths([list(w) for w in group["words"]])})

    # Items that share their first five words share an instruction; texts of one instruction are gathered, not all items.
    skipped = headed.groupBy("head").applyInPandas(ends, "item_id bigint, text string, skip int")
    windows = map_columns(skipped, _item_rows, "item_id bigint, text string, skip int, h bigint")
    texts = documents.where(F.length("text") > 0).select(key, "text")
    held = map_columns(texts, _text_rows(key), f"{key} {kind}, h bigint")
    small = windows.select("item_id", "h")
    met = held.join(small, "h").groupBy(key, "item_id").agg(F.countDistinct("h").alias("n")).where(F.col("n") >= 2)
    pairs = met.select(key, "item_id").join(skipped.select("item_id", F.col("text").alias("item"), "skip"), "item_id").join(texts, key)
    return map_columns(pairs.select(key, "text", "item_id", "item", "skip"), _verify_all(key), f"{key} {kind}, item_id bigint, held double, slots_kept int, slots int")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``{key}, item_id, held, slots_kept, slots``: the items that each document carries.

    ``held`` is the share of the item's words (its shared instruction aside)
    that lie in the document in the item's order, a consistently replaced value
    counted as its word.  Null or empty texts and items give no row; repeated
    rows give one; an item that comes with several texts is found by any of
    them; other columns are ignored.
    """
    kind = dict(documents.dtypes)[key]
    asked = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = documents.where(F.col(key).isNotNull()).select(key, "text")
    if size <= broadcast_bytes:
        rows = sorted((r["item_id"], r["text"]) for r in asked.collect())
        found = map_columns(texts, _match_all(rows, key), f"{key} {kind}, item_id bigint, held double, slots_kept int, slots int")
    else:
        found = shuffled_leaks(texts, asked, key)
    return found.groupBy(key, "item_id").agg(F.max("held").alias("held"), F.max("slots_kept").alias("slots_kept"), F.max("slots").alias("slots"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, documents, most_held``: which items leaked, into how many documents."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("held").alias("most_held"))
