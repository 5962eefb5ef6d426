"""Column functions on source text: tokens, complexity, hashes, signatures, secrets.

All are built-in expressions and stay in the JVM.  A null text gives null unless
a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A prime below 2^31, so that a product of two residues fits a BIGINT.
PRIME = 2147483647
SLOTS, BANDS = 64, 16

# What adds a path through a function.
BRANCHES = ("if ", "else if", "for ", "while ", "match ", "case ", "&&", "||", "?")
# Cues of secrets, and of lines to redact.
SENSITIVE = (
    "password=", "secret=", "api_key", "apikey", "token=", "bearer ", "begin private key", "begin rsa private key", "aws_access_key_id",
    "aws_secret_access_key", "x-api-key",
)
REDACTED = ("api_key", "apikey", "secret", "password", "token", "authorization:", "private_key")
KEYWORDS = (
    "if else for while do switch case break continue return match loop let const var val fn func function def class struct enum interface trait impl "
    "pub public private protected static final import use package from as in new try catch except finally throw raise with async await yield true "
    "false null none nil self this super"
).split()


def count_of(text, token: str) -> Column:
    """How often a token occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def cyclomatic(text) -> Column:
    """1 and the number of branching tokens."""
    out = F.lit(1)
    for t in BRANCHES:
        out = out + count_of(text, t)
    return out


_COGNITIVE = (
    r"else(?= if)|if[ (]|for[ (]|while[ (]|switch[ (]|match[ (]|case |catch[ (]|try[ {]|&&|\|\||\?|\}"
)


def cognitive(text) -> Column:
    """Branches weighted by how deep they are nested: a fold over the tokens that matter, in order.

    Loops, branches, switches and handlers count 1 and their depth and deepen
    what follows; ``else if``, ``case`` and logical operators count 1; a closing
    brace ends a level, one that closes a ``try`` too.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"({_COGNITIVE})"), F.lit(1))

    def step(acc, t):
        c, n = acc["c"], acc["n"]
        opens = t.rlike(r"^(?:if|for|while|switch|match|catch)")
        gain = F.when(opens | (t == "?"), 1 + n).when(t.startswith("try") | (t == "}"), 0).otherwise(1)
        depth = F.when(opens | t.startswith("try"), n + 1).when(t == "}", F.greatest(n - 1, F.lit(0))).otherwise(n)
        # the brace of ``try{`` is read as part of it
        return F.struct((c + gain).alias("c"), depth.alias("n"))

    return F.aggregate(tokens, F.struct(F.lit(0).alias("c"), F.lit(0).alias("n")), step, lambda acc: acc["c"])


def rating(complexity) -> Column:
    """simple to 5, moderate to 10, complex to 20, then very_complex."""
    return F.when(complexity <= 5, "simple").when(complexity <= 10, "moderate").when(complexity <= 20, "complex").otherwise("very_complex")


def tokens(text) -> Column:
    """Search tokens: lower case, letters, digits and underscores, longer than a byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.octet_length(x) > 1)


def body_tokens(text) -> Column:
    """Tokens of a function body: longer than two bytes, in lower case."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: F.octet_length(x) > 2), F.lower)


def line_tokens(text) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s])"), F.lit(1))


def normal_tokens(text) -> Column:
    """Line tokens with identifiers as ``_ID_`` and numbers as ``_NUM_``; keywords and punctuation stay."""

    def one(x):
        return F.when(F.lower(x).isin(*KEYWORDS), x).when(x.rlike(r"^[0-9]"), "_NUM_").when(x.rlike(r"^\w"), "_ID_").otherwise(x)

    return F.transform(line_tokens(text), one)


def token_hash(token) -> Column:
    """A number below the prime for a token, the same in every engine: from the first 15 digits of its md5."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint") % PRIME


def coefficients(slot: int) -> tuple[int, int]:
    """The linear permutation of a minhash slot."""
    return (48271 * (slot + 1) * (slot + 7) + 69621) % PRIME, (16807 * (slot + 3) * 31337 + 12345) % PRIME


def minhash(hashes, slots: int = SLOTS) -> Column:
    """The least permuted value of a set of token hashes for each slot; null for an empty set."""
    pairs = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in map(coefficients, range(slots))])
    distinct = F.array_distinct(hashes)
    sketch = F.transform(pairs, lambda p: F.array_min(F.transform(distinct, lambda h: (p["a"] * h + p["b"]) % PRIME)))
    return F.when(F.size(distinct) > 0, sketch)


def bands(signature, count: int = BANDS, slots: int = SLOTS) -> Column:
    """A key for each band of a signature."""
    width = slots // count
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat_ws(":", i.cast("string"), F.array_join(F.slice(signature, i * width + 1, width), ",")))


def equal_slots(a, b, slots: int = SLOTS) -> Column:
    """The share of equal slots of two signatures, an estimate of their sets' similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / slots


def jaccard(a, b) -> Column:
    """True similarity of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def static_embedding(words, dim: int = 128) -> Column:
    """A signed hashed bag of words of unit length; all zero without words."""
    h = F.transform(words, token_hash)
    zero = F.array_repeat(F.lit(0.0), dim)

    def add(acc, x):
        at, sign = (x % dim).cast("int"), F.when(F.floor(x / dim) % 2 == 0, 1.0).otherwise(-1.0)
        return F.transform(acc, lambda v, i: F.when(i == at, v + sign).otherwise(v))

    raw = F.aggregate(h, zero, add)
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def token_estimate(text) -> Column:
    """A quarter of the characters, rounded up, at least 1; 0 for an empty text."""
    size = F.length(text)
    return F.when(size == 0, 0).when(size > 0, F.greatest(F.ceil(size / 4), F.lit(1))).cast("int")


def entropy(text) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    chars = F.split(text, "")
    size = F.length(text)

    def part(c):
        p = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return -p * F.log2(p)

    return F.when(size == 0, 0.0).otherwise(F.aggregate(F.transform(F.array_distinct(F.filter(chars, lambda c: c != "")), part), F.lit(0.0), lambda s, x: s + x))


def high_entropy(word) -> Column:
    distinct = F.size(F.array_distinct(F.filter(F.split(word, ""), lambda c: c != "")))
    return (F.octet_length(word) >= 32) & (distinct >= 8) & (entropy(word) > 4)


def looks_sensitive(text) -> Column:
    """A cue of a secret, or a long word of high entropy."""
    low, found = F.lower(text), F.lit(False)
    for cue in SENSITIVE:
        found = found | low.contains(cue)
    return found | F.exists(F.filter(F.split(text, r"\s+"), lambda w: F.octet_length(w) >= 32), high_entropy)


def redact(text) -> Column:
    """A text with every line that holds a cue replaced as a whole; line ends stay."""
    cue = "|".join(REDACTED)
    return F.regexp_replace(text, rf"(?im)^[^\n]*(?:{cue})[^\n]*$", "[REDACTED_SECRET_LINE]")


def signature_preview(source) -> Column:
    """The text up to the first brace or line-ending colon, on one line."""
    head = F.regexp_extract(source, r"(?s)^(.*?)(?:\{|:[ \t]*(?:\n|$)|\z)", 1)
    return F.trim(F.regexp_replace(head, r"\s+", " "))


_SIGNATURE = (
    r"^(?:export |default |pub(?:\([^)]*\))? |public |private |protected |static |final |abstract |async |unsafe |override |open |internal |suspend |inline )*"
    r"(?:fn|func|fun|function|def|class|struct|enum|interface|trait|impl|type|object|module|protocol|extension|const|sub)\b"
)


def skeleton(source, minimal: bool = True) -> Column:
    """The lines that declare something, with imports and comments before them unless ``minimal``; cut to the width of a page."""
    width = 100 if minimal else 120
    rule = _SIGNATURE if minimal else _SIGNATURE + r"|^(?:import|from|use|require|require_relative|package|#include|using)\b|^(?:///|/\*\*|\*|#:|\"\"\")"
    lines = F.filter(F.split(F.replace(source, F.lit("\r"), F.lit("")), "\n"), lambda x: F.ltrim(x).rlike(rule))
    return F.array_join(F.transform(lines, lambda x: F.substring(F.rtrim(x), 1, width)), "\n")


def compression_ratio(before, after) -> Column:
    """How much shorter a text became; 0 for an empty one."""
    return F.round(F.when(F.length(before) > 0, 1 - F.length(after) / F.length(before)).otherwise(0.0), 6)


def nesting_depth(source) -> Column:
    """The greatest number of open braces; a stray closing brace opens nothing."""
    braces = F.regexp_extract_all(source, F.lit(r"([{}])"), F.lit(1))

    def step(acc, b):
        now = F.when(b == "{", acc["d"] + 1).otherwise(F.greatest(acc["d"] - 1, F.lit(0)))
        return F.struct(now.alias("d"), F.greatest(acc["m"], now).alias("m"))

    return F.aggregate(braces, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"])


def importance(complexity, depth, lines) -> Column:
    return F.round(0.4 * F.least(complexity / 20, F.lit(1.0)) + 0.3 * F.least(depth / 10, F.lit(1.0)) + 0.3 * F.least(lines / 100, F.lit(1.0)), 6)


def line_count(text) -> Column:
    """Lines of a text; an ending line end begins no further line, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(F.substring(text, -1, 1) == "\n", 0).otherwise(1))


def etag(text) -> Column:
    return F.substring(F.md5(text), 1, 16)


def edge_id(*parts) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def import_name(text) -> Column:
    """The module of an import line, without quotes, keywords and aliases."""
    x = F.regexp_replace(F.trim(text), r"^(?:import|from|use|require_relative|require|#include|package)\s+|[;\"'<>()]", "")
    return F.trim(F.regexp_replace(x, r"\s+(?:as|import)\s.*$", ""))
