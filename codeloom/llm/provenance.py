"""Files that nobody in the repository writes by hand.

Four kinds are told apart from hand-written source: files a tool generated,
minified files, data dumps in the form of code, and copies of third-party code.

The first three are judged file by file from the composition of the text, in
one pass without a shuffle.  Copies are found among the remaining files with an
inverted index of rare lines: every line of some length is hashed together with
the line before it; it is rare when few different lines follow it, or few for the
files that hold it, however many
copies of that place exist, so a library that makes up a third of the corpus
stays rare while ``return out;`` does not.  For every file the index gives the
exact share of its rare lines that other repositories hold too, and how many of
them one file owns; lines that coincide by chance have many owners, those of a
copy, edited or not, have one.  All steps are hash aggregations with partial
sums, so no group of copies is ever gathered or paired up.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.llm.common import files, map_columns
from codeloom.session import cut

#: Lines shorter than this, stripped, are not indexed.
LINE_LENGTH = 12
#: A line that more different lines follow than this is not rare, unless they are at most this share of the files that hold it:
#: each independently edited copy adds a context, so an absolute bound alone would drop the most copied code.
RARE_CONTEXTS, CONTEXT_SHARE = 6, 0.5
#: A file is a copy if one file owns this share of its rare lines, and other repositories hold them ...
OWNED = 0.4
#: ... or if other repositories hold this share of them, most of which differ in their owner ...
CONTAINMENT, OWNED_AT_LEAST = 0.75, 0.25
#: ... and at least so many lines are shared with that owner.
SHARED_LINES = 4

# Directories that package managers and people keep foreign code in, and names that may also mean the repository's own.
VENDOR_DIRS = frozenset(
    "vendor vendors vendored _vendor node_modules bower_components third_party third-party thirdparty 3rdparty "
    "site-packages dist-packages Pods Carthage jspm_packages".split()
)
LOOSE_DIRS = frozenset("deps external externals extern".split())

# How tools say that they wrote a file, in English, German, French and Spanish.
DECLARED = re.compile(
    r"^\W*@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)|"
    r"\b(?:code|file|source|module|bindings?|stubs?)\b[^.\n]{0,30}\bgenerated (?:by|from|with|using)\b|"
    r"^\W*(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using)\b|"
    r"\b(?:was|is|been) (?:automatically|machine)[- ](?:created|generated|produced|written)\b|"
    r"\bmachine[- ](?:made|generated|written|produced)\b[^.\n]{0,60}\b(?:from|by|edits?|overwritten)\b|"
    r"\b(?:edits|changes)\b[^.\n]{0,40}\b(?:are|will be) (?:overwritten|lost|discarded)\b|"
    r"^\W*do not (?:edit|modify|change)\b[^.\n]{0,20}(?:by hand|manually|directly|this file|[;.!]|$)|"
    r"\bgenerated\b[^\n]{0,60}\bdo not (?:edit|modify)\b|"
    r"\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:von hand|manuell) (?:ändern|bearbeiten|editieren)\b|"
    r"\b(?:généré|créé) automatiquement\b|\bne pas (?:modifier|éditer)\b|"
    r"\b(?:generado|creado) automáticamente\b|\bno (?:editar|modificar)\b",
    re.I | re.M,
)

# Notes of copied code.
UPSTREAM = re.compile(
    r"\bimported from upstream\b|\bupstream: *https?://|\bis a copy of \S+[^.\n]*\bupstream\b|\breport problems upstream\b|"
    r"\bbundled copy\b|\bvendored (?:from|copy)\b|\bcopied (?:verbatim )?from (?:the )?upstream\b",
    re.I,
)

# Lines of licences.
LEGAL = re.compile(r"\bcopyright\b|\blicen[cs]ed? (?:under|under the)\b|\bSPDX-|\bwithout warranty\b|\ball rights reserved\b|\bpermission is hereby granted\b", re.I)

_BLOCK = re.compile(r"\s*(?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->)")
_LINE = re.compile(r"\s*(?://|#(?!include|define|if|pragma|\[)|--|;|%)[^\n]*(?:\n|\Z)")
_SKIP = re.compile(r"\s*(?:#![^\n]*\n|set -[a-z]+\s*\n|<\?php|(['\"])use strict\1;?|@charset[^\n]*\n)")
_MARGIN = re.compile(r"(?://|#(?!include|define|if|endif|pragma|\[)|/\*| \*|--|<!--)")
_STRINGS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|(?<![:\\\w])//[^\n]*|(?m:^\s*#(?!include|define|if|\[)[^\n]*)")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b")
_MASK = (1 << 64) - 1
_DIGITS = re.compile(r"\d+")


def leading_end(source: str) -> int:
    """Where the comment ends that a file starts with, after a shebang or the like."""
    at = 0
    while m := _SKIP.match(source, at) or _BLOCK.match(source, at) or _LINE.match(source, at):
        at = m.end()
    return at


def leading_comment(source: str) -> str:
    return source[: leading_end(source)]


def closing_comment(source: str) -> str:
    """The comment lines at the left margin that a file ends with."""
    lines = source.rstrip().split("\n")
    at = len(lines)
    while at and _MARGIN.match(lines[at - 1]):
        at -= 1
    return "\n".join(lines[at:])


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def mechanical_share(lines: list[str]) -> tuple[float, int]:
    """Share and number of lines that only continue a numbered series.

    Lines that are equal but for their numbers form a series if those numbers
    advance by one constant step; lines without numbers are counted with a
    series if they are repeated as often as it is long.
    """
    shapes: dict[str, list[str]] = {}
    for line in lines:
        shapes.setdefault(_DIGITS.sub("0", _STRINGS.sub('""', line)), []).append(line)
    series, longest = 0, 0
    for shape, own in shapes.items():
        if len(own) < 6 or "0" not in shape:
            continue
        first = [_DIGITS.findall(x) for x in own]
        width = min(map(len, first))
        for k in range(width):
            if max(len(x[k]) for x in first) > 1000:
                continue  # no counter
            values = [int(x[k]) for x in first]
            steps = Counter(b - a for a, b in zip(values, values[1:]))
            step, often = steps.most_common(1)[0]
            if step and often >= 0.8 * (len(own) - 1):
                series += len(own)
                longest = max(longest, len(own))
                break
    if longest:
        for shape, own in shapes.items():
            if "0" not in shape and len(own) >= 0.9 * longest:
                series += len(own)
    return series / max(1, len(lines)), longest


def is_data(code: str) -> bool:
    """Whether most of the code, comments aside, is numbers and opaque strings."""
    total = sum(map(len, code.split()))
    if total < 400:
        return False
    opaque = 0
    for s in _STRINGS.findall(code):
        body = s[1:-1]
        if len(body) >= 40 and " " not in body and not body.startswith("-----") and entropy(body) > 3.2:
            opaque += len(body)
    bare = _STRINGS.sub('""', code)
    numbers = [len(x) for x in _NUMBER.findall(bare)]
    data = opaque + (sum(numbers) + len(numbers) if len(numbers) >= 60 else 0)
    return data >= 400 and data >= 0.45 * total


def is_minified(code: str) -> bool:
    """Whether the code, comments and strings aside, was stripped of its layout."""
    bare = _STRINGS.sub('""', code)
    lines = [x for x in bare.split("\n") if x.strip()]
    total = sum(map(len, lines))
    dense = sum(len(x) for x in lines if len(x) > 100 and sum(map(x.count, " \t")) < 0.16 * len(x) and sum(map(x.count, "(){};,=")) > 0.08 * len(x))
    return dense >= 300 and dense >= 0.5 * total


def judge(path: str, source: str) -> str | None:
    """What the text of one file shows by itself; None if nothing does."""
    head = leading_comment(source)
    if DECLARED.search(head) or DECLARED.search(closing_comment(source)):
        return "generated"
    lines = [x for x in map(str.strip, source.split("\n")) if x]
    if len(lines) >= 12:
        share, longest = mechanical_share(lines)
        if longest >= 8 and share >= 0.5:
            return "generated"
    if not path.endswith(".json"):
        code = _COMMENTS.sub("", source)
        if max(map(len, lines), default=0) > 100 and is_minified(code):
            return "minified"
        if is_data(code):
            return "data"
    elif is_data(source):
        return "data"
    folders = path.split("/")[:-1]
    # The name of a loose folder is no evidence without a notice of rights at the head.
    if UPSTREAM.search(head) or not VENDOR_DIRS.isdisjoint(folders) or (LEGAL.search(head) and not LOOSE_DIRS.isdisjoint(folders)):
        return "vendored"
    return None


def _inspect(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"node_id": [], "repo": [], "verdict": [], "h": [], "ctx": []}
    h64 = xxhash.xxh3_64_intdigest
    for node, path, repo, source in zip(cols["id"], cols["path"], cols["repository_path"], cols["source"]):
        if not source or not source.strip():
            continue
        text = source.replace("\r", "")
        verdict = judge(path or "", text)
        hashes: dict[int, int] = {}
        if verdict in (None, "vendored"):
            # Headers are shared by files that have nothing else in common.
            own = [x for x in map(str.strip, text[leading_end(text) :].split("\n")) if x and not LEGAL.search(x)]
            each = [h64(x) for x in own] + [7]
            for i, x in enumerate(own):
                if len(x) >= LINE_LENGTH:
                    hashes.setdefault(((each[i - 1] * 1_000_003 ^ each[i]) & _MASK) - (1 << 63), each[i + 1] - (1 << 63))
        out["node_id"].append(node)
        out["repo"].append(repo or "")
        out["verdict"].append(verdict)
        out["h"].append(list(hashes))
        out["ctx"].append(list(hashes.values()))
    return out


def inspect_files(nodes: DataFrame) -> DataFrame:
    """``node_id, repo, verdict, h, ctx``: the verdict on each FILE, and the hashes of its lines."""
    return map_columns(
        files(nodes).select("id", "path", "repository_path", "source"),
        _inspect,
        "node_id string, repo string, verdict string, h array<bigint>, ctx array<bigint>",
    )


def containment(inspected: DataFrame) -> DataFrame:
    """``file, rare, shared, owner_shared, share, owned`` of each file with rare lines.

    ``rare`` counts its rare lines, ``shared`` those of them that another
    repository holds too, ``owner_shared`` the most of these that it holds in
    common with one other file.  Candidates for that file are the owners of its
    lines (the file with the least key among the holders of a line); where no
    owner has enough of them, since other files hold some of the lines too, the
    line sets of the file and of each candidate are intersected exactly.
    """
    lines = inspected.where(F.size("h") > 0).dropDuplicates(["node_id", "h", "ctx"]).select(
        F.xxhash64("node_id").alias("file"),
        F.xxhash64("repo").alias("repo"),
        F.explode(F.arrays_zip("h", "ctx")).alias("x"),
    ).select("file", "repo", F.col("x.h").alias("h"), F.col("x.ctx").alias("ctx"))
    index = (
        lines.groupBy("h", "ctx")
        .agg(F.min("file").alias("owner"), F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.count("*").alias("held"))
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.sum("held").alias("held"), F.min("owner").alias("owner"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where((F.col("n") <= RARE_CONTEXTS) | (F.col("n") <= CONTEXT_SHARE * F.col("held")))
        .select("h", F.when(F.col("lo") != F.col("hi"), F.col("owner")).alias("owner"))
    )
    held = lines.select("file", "h").join(index, "h")
    owned = cut(held.groupBy("file", "owner").agg(F.count("*").alias("n")))  # few rows a file; its lines are not kept
    counted = owned.groupBy("file").agg(
        F.sum("n").alias("rare"),
        F.sum(F.when(F.col("owner").isNotNull(), F.col("n")).otherwise(0)).alias("shared"),
        F.max(F.when(F.col("owner").isNotNull(), F.col("n")).otherwise(0)).alias("most"),
    )
    open_ = counted.where((F.col("most") < OWNED * F.col("rare")) & (F.col("shared") >= OWNED * F.col("rare")) & (F.col("shared") >= SHARED_LINES)).select("file")
    candidates = owned.where(F.col("owner").isNotNull() & (F.col("owner") != F.col("file"))).join(open_, "file", "left_semi").select("file", "owner")
    exact = owned.where(F.lit(False)).select("file", F.col("n").alias("exact"))
    if not candidates.isEmpty():  # the lines of these files are read again
        both = held.join(candidates.select(F.explode(F.array("file", "owner")).alias("file")).distinct(), "file", "left_semi").select("file", "h")
        theirs = both.select(F.col("file").alias("owner"), "h")
        exact = (
            both.join(candidates, "file").join(theirs, ["owner", "h"])
            .groupBy("file", "owner").agg(F.count("*").alias("n")).groupBy("file").agg(F.max("n").alias("exact"))
        )
    return (
        counted.join(exact, "file", "left")
        .select("file", "rare", "shared", F.greatest("most", F.coalesce("exact", F.lit(0))).alias("owner_shared"))
        .withColumn("share", F.col("shared") / F.col("rare"))
        .withColumn("owned", F.col("owner_shared") / F.col("rare"))
    )


def flag_files(nodes: DataFrame) -> DataFrame:
    """``node_id, reason`` of every FILE that is not written by hand, one row each.

    Repeated rows count once; a null or blank source, or a null id, is no case;
    a null ``path`` or ``repository_path`` reads as an empty string (files
    without a repository count as one repository).  Columns beyond ``id, kind,
    path, repository_path, source`` are ignored.  An empty table gives no rows.
    """
    inspected = cut(inspect_files(nodes.where(F.col("id").isNotNull())))
    copies = containment(inspected).where(
        (F.col("owner_shared") >= SHARED_LINES)
        & ((F.col("owned") >= OWNED) | ((F.col("share") >= CONTAINMENT) & (F.col("owned") >= OWNED_AT_LEAST)))
    ).select("file")
    keyed = inspected.select("node_id", "verdict", F.xxhash64("node_id").alias("file"))
    copied = keyed.where(F.col("verdict").isNull()).join(copies, "file", "left_semi")
    return (
        keyed.where(F.col("verdict").isNotNull())
        .select("node_id", F.col("verdict").alias("reason"))
        .unionByName(copied.select("node_id", F.lit("vendored").alias("reason")))
        .groupBy("node_id")
        .agg(F.min("reason").alias("reason"))
    )


def profile(nodes: DataFrame) -> DataFrame:
    """``repository_path, reason, files, share`` of the files that are flagged, by repository."""
    all_files = files(nodes).select(F.col("id").alias("node_id"), "repository_path").dropDuplicates(["node_id"])
    counted = (
        all_files.join(flag_files(nodes), "node_id", "left")
        .groupBy("repository_path", F.coalesce("reason", F.lit("hand-written")).alias("reason"))
        .agg(F.count("*").alias("files"))
    )
    total = F.sum("files").over(Window.partitionBy("repository_path"))
    return counted.withColumn("share", F.round(F.col("files") / total, 6))
