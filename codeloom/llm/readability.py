"""The schooling that the running prose of a document demands of a reader.

Code, logs, tables, headings and lists of names are taken out; the English
sentences that remain are described by distributions of their length,
vocabulary, syntax and cohesion.  Gradient-boosted regression trees, trained
here on the rated documents, turn these features into a grade; the cuts between
the bands are calibrated on predictions for documents of sources the trees did
not see.  Features and predictions are computed per document, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import map_columns

#: A document needs so many words of running prose.
MIN_WORDS = 100
#: At most so many rated documents are used for training.
MOST_RATED = 20_000
#: Boosting: trees, their depth, the learning rate, and the least documents of a leaf.
TREES, DEPTH, RATE, LEAF = 150, 3, 0.08, 5
#: Folds of the cross-validation by source.
FOLDS = 5

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_HTML_BLOCK = re.compile(r"<(script|style|pre|code|table)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_MATH = re.compile(r"\$\$.*?\$\$", re.S)
_LOG = re.compile(
    r"^\W{0,2}(?:\d{4}[-/.]\d\d[-/.]\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\w{3} +\d{1,2} \d\d:\d\d:\d\d|(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|\[\w+\] |"
    r"Traceback \(most|  File \"|\s+at \w[\w.$]*\(|[0-9a-f]{7,40} )"
)
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^\s*[|+:=-]{3,}[|+:= -]*$|^\s*\S+(?:\t+\S+){2,}\s*$|^\s*\S+(?: {3,}\S+){2,}\s*$")
_HEADING = re.compile(r"^\s{0,3}(?:#{1,6}\s|=+\s+\S|h[1-6]\.\s)")
_UNDERLINE = re.compile(r"^\s*(?:=+|-{3,}|~{3,}|\*{3,}|_{3,}|\^{3,})\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•–·]|\d{1,3}[.)]|[a-z][.)]|\[[ x]\])\s+(?:\[[ xX]\]\s+)?")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]+[;,]?\s*$|^\s*(?:def|class|fn|pub fn|func|fun|function|public|private|static|const|let|var|val|import|from \w+ import|#include|package|using|"
    r"return|if \(|for \(|while \(|else\b|end|echo|print|puts|local|use |require|export )\b.*[(){}\[\]=:;\"]|^\s*[$>%#]\s?\S+ -|\w\(\w*(?:, ?\w+)*\)\s*(?:->|=>|:|\{)|^\s*[\w.$\[\]\"']+\s*(?::=|[+*/-]?=)\s*\S|^\s*</?\w+[^>]*>\s*$|^\s*@\w+|^\s*//|^\s*#\w"
)
_MARKUP = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)|<[^<>]{1,200}>|https?://\S+|`([^`\n]*)`|[*_]{1,3}(?=\S)|(?<=\S)[*_]{1,3}")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[A-ZÀ-Þ0-9¿¡])")
_ABBREVIATION = re.compile(r"\b(?:e\.g|i\.e|etc|vs|cf|approx|resp|incl|fig|no|vol|dr|mr|mrs|ms|prof|st|z\. ?b|d\. ?h|bzw|p\. ?ej|p\. ?ex)\.$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['\-][a-z]+)*")
_MARKED = re.compile(r"[\[<`*_]|http")
_VOWELS = re.compile(r"[aeiouy]+")

# Frequent words of the languages.
STOP = {
    "en": frozenset("the of and a to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house don't world going want".split()),
    "de": frozenset("der die das und ist nicht ein eine einer einen dem den des zu mit auf für von im in sich wird werden wenn dass bei nach aus auch als am es er sie wir ihr an um noch nur vor seit über hat haben kann muss sind war durch oder aber man zur zum diese dieser jede jeder keine".split()),
    "fr": frozenset("le la les un une des et est ne pas que qui dans pour sur avec par au aux du de ce cette il elle on nous vous ils se sa son ses plus avant après depuis quand doit faut être sont a à l'on d'un d'une comment chaque reste".split()),
    "es": frozenset("el la los las un una y es no que en de del por para con se su al lo como más antes después desde cuando hay ser son está esta este cada quien debe sin sobre ya muy pero quedan".split()),
}
_CONNECTIVES = frozenset("because so therefore thus hence however but although though while whereas since unless if then when before after until moreover furthermore consequently nevertheless notwithstanding insofar inasmuch whether".split())
_SUBORDINATE = frozenset("that which who whom whose whether although though because since unless until while whereas if when wherever insofar inasmuch notwithstanding considering so".split())
_PREPOSITIONS = frozenset("of in to for with on at from by about as into through during including against among throughout despite towards upon concerning between under without within beyond across behind".split())

FEATURES = (
    "sentence_mean sentence_25 sentence_50 sentence_75 sentence_90 letters_mean letters_90 syllables_mean syllables_90 three_share four_share five_share "
    "long_share very_long_share short_share stop_share types_root hapax long_sentences subordinate connectives prepositions participles nominal "
    "overlap overlap_sd flesch_kincaid ari coleman_liau smog sentence_fk_50 sentence_fk_25 sentence_fk_75"
).split()

_CODES = {w: 0 for v in STOP.values() for w in v}
for _bit, _name in enumerate(STOP):
    for _w in STOP[_name]:
        _CODES[_w] |= 1 << _bit
_BITS = {code: [i for i in range(len(STOP)) if code >> i & 1] for code in set(_CODES.values())}
_NAMES = list(STOP)


def syllables(word: str) -> int:
    """Vowel groups, less a silent final e."""
    n = len(_VOWELS.findall(word))
    if word.endswith("e") and not word.endswith(("le", "ee")) and n > 1:
        n -= 1
    elif word.endswith("ed") and n > 1 and not word.endswith(("ted", "ded")):
        n -= 1
    return max(1, n)


class _Words(dict):
    """What is known of a word, in one number: letters, syllables and flags; remembered per worker."""

    STOP, PARTICIPLE, NOMINAL, SUBORDINATE, CONNECTIVE, PREPOSITION = (1 << k for k in range(16, 22))

    def __missing__(self, w: str) -> int:
        code = min(len(w), 255) | min(syllables(w), 255) << 8
        code |= self.STOP * (w in STOP["en"]) | self.PARTICIPLE * (w.endswith(("ed", "ing")) and len(w) > 4)
        code |= self.NOMINAL * (w.endswith(("tion", "tions", "ity", "ities", "ment", "ments", "ance", "ence", "ness")) and len(w) > 6)
        code |= self.SUBORDINATE * (w in _SUBORDINATE) | self.CONNECTIVE * (w in _CONNECTIVES) | self.PREPOSITION * (w in _PREPOSITIONS)
        if len(self) >= 200_000:
            self.clear()
        self[w] = code
        return code


_KNOWN = _Words()
_SIGNS = re.compile(r"[(){}\[\]=;<>\"$@#/:%]")


def _is_sentence(text: str) -> bool:
    """Whether a list item or single line reads as a sentence."""
    return text.rstrip("\"'”’)*_ ").endswith((".", "!", "?", "…")) and len(_WORD.findall(text[:400]) if text.count(" ") < 3 else "abc") >= 3


def paragraphs(text: str) -> list[str]:
    """The running prose of a text: joined lines without code, logs, tables, headings and names."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FENCE.sub("\n\n", text) if "```" in text or "~~~" in text else text
    text = _HTML_BLOCK.sub("\n", text) if "<" in text else text
    text = _MATH.sub(" ", text) if "$$" in text else text
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if not block:
            return
        joined = " ".join(block)
        if len(block) > 1 or _is_sentence(joined) or len(_WORD.findall(joined)) >= 12:
            out.append(joined)
        block.clear()

    lines = text.split("\n")
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            close()
            continue
        letter = bare[0].isalpha()
        if not block and i + 1 < len(lines) and lines[i + 1][:1] in "=-~*_^ " and len(lines[i + 1].strip()) >= 3 and _UNDERLINE.match(lines[i + 1]) and not _is_sentence(line):
            continue  # an underlined heading
        if letter:
            odd = (("\t" in bare or "   " in bare) and _TABLE.match(line)) or (not bare[1:2].islower() or bare.startswith(("Trace", "at "))) and _LOG.match(bare)
        else:
            odd = _HEADING.match(line) or _UNDERLINE.match(line) or _TABLE.match(line) or _LOG.match(line)
        if odd:
            close()
            continue
        bullet = _BULLET.match(line) if not letter or bare[1:2] in ".)" else None
        if bullet:
            close()
            block.append(line[bullet.end() :].strip())
            continue  # a wrapped item goes on in the next lines; names and fragments are dropped when it closes
        if _SIGNS.search(bare) and _CODE.search(line) and not _is_sentence(line):
            close()
            continue
        if line.startswith(("    ", "\t")) and not block:
            continue  # indented code
        block.append(bare.lstrip("> "))
    close()
    return [p for p in out if _is_sentence(p) or len(_WORD.findall(p)) >= 12]


def sentences(paragraph: str) -> list[list[str]]:
    """The words of each sentence, in lower case."""
    plain = _MARKUP.sub(lambda m: m.group(1) or m.group(2) or " ", paragraph) if _MARKED.search(paragraph) else paragraph
    parts: list[str] = []
    for piece in _SENTENCE.split(plain):
        if parts and parts[-1].endswith(".") and _ABBREVIATION.search(parts[-1][-12:]):
            parts[-1] += " " + piece
        else:
            parts.append(piece)
    word = _ASCII_WORD if plain.isascii() else _WORD
    return [w for p in parts if (w := word.findall(p.lower()))]


def language(words: list[str]) -> str | None:
    """The language whose frequent words are the most in a list of words; the first of :data:`STOP` in a tie."""
    score = [0] * len(_NAMES)
    for code, n in Counter(map(_CODES.get, words)).items():
        if code is not None:
            for i in _BITS[code]:
                score[i] += n
    most = max(score)
    return _NAMES[score.index(most)] if most and most >= 0.08 * len(words) else None


def english_prose(text: str) -> tuple[list[list[str]], int, int]:
    """The English sentences of a text's prose, their words, and the words of all its prose."""
    own: list[list[str]] = []
    split = [sentences(p) for p in paragraphs(text)]
    words = [[w for s in parts for w in s] for parts in split]
    mains = [language(ws) for ws in words]
    whole = language([w for ws in words for w in ws]) if None in mains else None
    for parts, main in zip(split, mains):
        if (main or whole) == "en":  # a short paragraph may hold no frequent word
            own += parts if len(parts) == 1 else [s for s in parts if len(s) < 8 or language(s) in ("en", None)]
    return own, sum(map(len, own)), sum(map(len, words))


def _at(ordered: np.ndarray, share: float) -> float:
    """A quantile of sorted values, between the two nearest."""
    x = share * (len(ordered) - 1)
    i = int(x)
    j = min(i + 1, len(ordered) - 1)
    return float(ordered[i] + (ordered[j] - ordered[i]) * (x - i))


def features(parts: list[list[str]]) -> list[float]:
    """The features of some sentences, in the order of :data:`FEATURES`."""
    words = [w for s in parts for w in s]
    n, m = len(words), len(parts)
    codes = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.int64, count=n)
    letters, syl, flags = codes & 255, codes >> 8 & 255, codes >> 16
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=m)
    starts = np.zeros(m, dtype=np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    per = np.add.reduceat(syl, starts)
    by_syl, by_letters = np.bincount(syl, minlength=8), np.bincount(letters, minlength=16)
    share_of = [int((flags >> k & 1).sum()) for k in range(6)]
    stop, participles, nominal, subordinate, connectives, prepositions = share_of
    counts = Counter(words)
    common = STOP["en"]
    content = [{w for w in s if len(w) > 3 and w not in common} for s in parts]
    over = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:])]
    mean_over = sum(over) / len(over) if over else 0.0
    ordered = np.sort(lengths)
    sfk = np.sort(0.39 * lengths + 11.8 * per / lengths - 15.59)
    mean_syl, mean_letters = float(syl.sum()) / n, float(letters.sum()) / n
    poly = float(by_syl[3:].sum())
    return [
        n / m, _at(ordered, 0.25), _at(ordered, 0.5), _at(ordered, 0.75), _at(ordered, 0.9),
        mean_letters, float(np.searchsorted(np.cumsum(by_letters), 0.9 * n)), mean_syl, float(np.searchsorted(np.cumsum(by_syl), 0.9 * n)), poly / n,
        float(by_syl[4:].sum()) / n, float(by_syl[5:].sum()) / n, float(by_letters[7:].sum()) / n, float(by_letters[12:].sum()) / n, float(by_letters[:4].sum()) / n,
        stop / n, len(counts) / math.sqrt(2 * n), sum(c == 1 for c in counts.values()) / n,
        float(m - np.searchsorted(ordered, 20)) / m, subordinate / m, connectives / m, prepositions / n, participles / n, nominal / n,
        mean_over, math.sqrt(sum((x - mean_over) ** 2 for x in over) / len(over)) if over else 0.0,
        0.39 * n / m + 11.8 * mean_syl - 15.59, 4.71 * mean_letters + 0.5 * n / m - 21.43,
        5.88 * mean_letters - 29.6 * m / n - 15.8, 1.043 * math.sqrt(poly * 30 / m) + 3.1291,
        _at(sfk, 0.5), _at(sfk, 0.25), _at(sfk, 0.75),
    ]


@dataclass
class Tree:
    """A regression tree in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        f, c, left, right, v = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        for _ in range(DEPTH + 1):
            inner = f[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return v[at]


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> Tree:
    """A regression tree by weighted squared error over binned features."""
    tree = Tree()

    def split(rows: np.ndarray, depth: int) -> int:
        sw, sy = w[rows].sum(), (w[rows] * y[rows]).sum()
        node = tree.add(sy / sw if sw else 0.0)
        if depth == 0 or len(rows) < 2 * LEAF:
            return node
        best = (1e-9, -1, 0)
        for f in range(x.shape[1]):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            b = bins[rows, f]
            cw = np.cumsum(np.bincount(b, w[rows], size))[:-1]
            cy = np.cumsum(np.bincount(b, w[rows] * y[rows], size))[:-1]
            cn = np.cumsum(np.bincount(b, minlength=size))[:-1]
            ok = (cn >= LEAF) & (len(rows) - cn >= LEAF)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, cy**2 / cw + (sy - cy) ** 2 / (sw - cw) - sy**2 / sw, -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            return node
        tree.feature[node], tree.cut[node] = f, float(edges[f][k])
        go = bins[rows, f] <= k
        tree.left[node] = split(rows[go], depth - 1)
        tree.right[node] = split(rows[~go], depth - 1)
        return node

    split(np.arange(len(y)), DEPTH)
    return tree


@dataclass
class Grader:
    """Boosted trees and the cuts between the bands."""

    start: float
    trees: list[Tree]
    cuts: tuple[float, float, float] = (1.5, 2.5, 3.5)
    agreement: float = float("nan")
    rated: int = 0
    by_source: bool = True

    def grade(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += RATE * tree.predict(x)
        return out

    def band(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.cuts), self.grade(x), side="right") + 1


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES) -> Grader:
    """Gradient boosting with squared loss."""
    edges = [np.unique(np.percentile(x[:, f], np.linspace(2, 98, 49))) for f in range(x.shape[1])]
    edges = [e if len(e) > 1 or len(np.unique(x[:, f])) > 1 else np.array([]) for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    model = Grader(float(np.average(y, weights=w)), [])
    now = np.full(len(y), model.start)
    for _ in range(trees):
        tree = grow(x, bins, edges, y - now, w)
        model.trees.append(tree)
        now += RATE * tree.predict(x)
    return model


def calibrated_cuts(grade: np.ndarray, band: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """The cut between each pair of bands that agrees best with the ratings; the middle of the best stretch."""
    cuts = []
    for k in (1, 2, 3):
        low = 0.5 + k - 0.6
        tries = np.linspace(low, low + 1.2, 121)
        hits = np.array([(w * ((grade > t) == (band > k))).sum() for t in tries])
        best = tries[hits >= hits.max() - 1e-9]
        near = best[np.argmin(np.abs(best - np.median(best)))]
        cuts.append(float(near))
    return (cuts[0], max(cuts[0], cuts[1]), max(cuts[0], cuts[1], cuts[2]))


def train(x: np.ndarray, bands: np.ndarray, source: list[str], w: np.ndarray) -> Grader:
    """Trees on all rated documents, with cuts calibrated on folds of unseen sources."""
    names = {s: i % FOLDS for i, s in enumerate(sorted({s or "" for s in source}))}
    fold = np.array([names[s or ""] for s in source])
    by_source = len(names) >= 2
    if not by_source:  # one source has no unseen one; the result says so
        fold = np.arange(len(bands)) % FOLDS
    unseen = np.zeros(len(bands))
    for k in set(fold.tolist()):
        rest = fold != k
        if rest.sum() and (~rest).sum():
            unseen[~rest] = boost(x[rest], bands[rest], w[rest], TREES // 2).grade(x[~rest])
    model = boost(x, bands, w)
    model.by_source, model.rated = by_source, len(bands)
    model.cuts = calibrated_cuts(unseen, bands, w)
    model.agreement = float(np.average((np.searchsorted(np.array(model.cuts), unseen, side="right") + 1) == np.round(bands), weights=w))
    return model


def _describe(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "source": [], "words": [], "x": [], "band": [], "ratings": []}
    for doc, source, text, band, ratings in zip(*(cols[c] for c in ("doc_id", "source", "text", "band", "ratings"))):
        if not text:
            continue
        parts, own, total = english_prose(text)
        if parts and own >= 20:
            for k, v in zip(out, (doc, source, own, features(parts), band, ratings)):
                out[k].append(v)
    return out


def _band_with(model: Grader):
    def run(cols: dict[str, list]) -> dict[str, list]:
        ids, words, rows = [], [], []
        for doc, text in zip(cols["doc_id"], cols["text"]):
            if not text:
                continue
            parts, own, total = english_prose(text)
            if own >= MIN_WORDS and 2 * own > total:
                ids.append(doc)
                words.append(own)
                rows.append(features(parts))
        x = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))
        return {"doc_id": ids, "words": words, "grade": model.grade(x).tolist(), "band": model.band(x).astype(int).tolist()}

    return run


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> Grader | None:
    """Train on the rated English documents, at most ``most`` of them, chosen by a hash of their id; None if there are none.

    A document's target is the mean of its ratings (blanks and bands outside
    1 to 4 left out); those with several ratings weigh more.
    """
    rated = (
        labels.where(F.col("band").between(1, 4) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg("band").alias("band"), F.count("*").alias("ratings"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # The ratings are bounded by ``most``; texts stay where they are.
    texts = documents.select("doc_id", "source", "text").join(F.broadcast(rated), "doc_id")
    described = map_columns(texts, _describe, "doc_id bigint, source string, words int, x array<double>, band double, ratings bigint")
    rows = sorted(described.dropDuplicates(["doc_id"]).select("doc_id", "source", "x", "band", "ratings").collect())  # the same trees each time
    if not rows:
        return None
    x = np.array([r["x"] for r in rows], dtype=float)
    return train(x, np.array([r["band"] for r in rows], dtype=float), [r["source"] for r in rows], np.sqrt([float(r["ratings"]) for r in rows]))


def bands(documents: DataFrame, labels: DataFrame, model: Grader | None = None) -> DataFrame:
    """``doc_id, words, grade, band`` of the documents mainly in English with at least 100 words of prose.

    Null and empty texts give no row; ``lang`` is not read.  Repeated rows with
    one id give one; an id with several texts keeps the longest prose.  Ratings
    of documents that are not there are ignored; extra columns too.  Without any
    usable rating nothing can be graded, and there are no rows.
    """
    model = model or fit(documents, labels)
    if model is None:
        return documents.where(F.lit(False)).select("doc_id", F.lit(0).alias("words"), F.lit(0.0).alias("grade"), F.lit(0).cast("bigint").alias("band"))
    rows = map_columns(
        documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), _band_with(model), "doc_id bigint, words int, grade double, band bigint"
    )
    return rows.groupBy("doc_id").agg(F.max(F.struct("words", "grade", "band")).alias("b")).select("doc_id", "b.words", "b.grade", "b.band")


def agreement(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``rated, agreement, by_source``: how many documents taught the grader, and how often it agrees with the ratings of sources it has not seen.

    ``by_source`` is false where all rated documents come from one source, so
    that the folds had to be drawn from it.  Without ratings there is no row.
    """
    model = fit(documents, labels)
    rows = [] if model is None else [(model.rated, round(float(model.agreement), 6), bool(model.by_source))]
    return documents.sparkSession.createDataFrame(rows, "rated bigint, agreement double, by_source boolean")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, band, documents`` of the corpus."""
    return bands(documents, labels).join(documents.select("doc_id", "source").distinct(), "doc_id").groupBy("source", "band").agg(
        F.countDistinct("doc_id").alias("documents")
    )
