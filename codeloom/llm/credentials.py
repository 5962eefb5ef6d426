"""Credentials in source code and configuration: where they are, and masked copies.

Quoted strings and long tokens of every line are candidates.  One is reported

* for its form (issued keys and tokens, signed tokens, private key blocks),
* for its randomness alone, if it is no hash, id, digest, path, block of data or
  value of a harmless name,
* for the name it is assigned to or the word before it, if it is no placeholder,
  no reference and, unless it is a password, more random than its alphabet and
  length allow by chance, or
* as the password or signature in an address or a header.

Randomness is the Shannon entropy against the mean that random strings of the
length reach in the alphabet; hashes, ids and identifiers are recognised by
their form and by the names around them.  Lines repeat a lot in source code, so
the verdict "nothing here" is remembered per line and worker.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import canonical_language, files, language_of, map_columns

#: A string counts as random at this share of the entropy that chance gives.
RANDOM_SHARE = 0.82
#: Lines remembered as clean, per worker.
REMEMBERED = 300_000

# Forms of issued credentials.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA|AGPA|AROA|AIPA|ANPA|ANVA)[0-9A-Z]{16}(?![0-9A-Za-z])|"
    r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|gl(?:pat|ptt|dt|rt|soat)-[A-Za-z0-9_-]{18,}|"
    r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{20,}|xapp-[A-Za-z0-9-]{20,}|"
    r"npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|dop_v1_[a-f0-9]{40,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|"
    r"AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{30,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

# Words of names and texts that announce a credential.
PASSWORDS = frozenset("password passwd pwd pass passphrase passcode pw psw passwort kennwort contraseña motdepasse".split())
SECRETS = frozenset(
    "secret token apikey credential credentials cred creds auth authorization bearer jwt session grant pat bot hmac salt signature signing "
    "cookie webhook oauth sas dsn accesskey secretkey privatekey client key encryption master license".split()
)
#: Names with one of these words hold no credential unless its form says so.
HARMLESS = frozenset(
    "env variable var field label public pub commit revision checksum sha sha1 sha256 sha512 md5 digest hash etag integrity uuid guid id ids "
    "namespace version page cursor prefix suffix regex pattern format fingerprint thumbprint alphabet charset sample placeholder hint title "
    "message text help doc column".split()
)
#: "key" and its like need one of these beside them.
WEAK = frozenset("key client license session bot pat master cookie auth grant".split())

_PLACEHOLDER = re.compile(
    r"^(?:|(.)\1*|change[-_ ]?(?:me|it|this)\W*\d*|dummy\b.*|(?-i:[Ee]xample|EXAMPLE)\b.*|sample\b.*|placeholder\b.*|(?:your|my|the|some|an?)[-_ ].*|insert\b.*|"
    r"replace\b.*|todo\b.*|fixme\b.*|none|null|nil|undefined|unset|empty|unknown|test(?:ing|er|user|pass(?:word)?)?\d{0,4}!?|secret\d{0,3}|"
    r"passw(?:or|0r)?d\d{0,3}|pass\d{0,3}|token|key|foo\w*|bar|baz|redacted|removed|hidden|masked|not[-_ ]?set|default|admin\d{0,3}|root|guest|user\d{0,3}|"
    r"postgres|mysql|redis|fake\b.*|mock\b.*|demo\d*|n/?a|tbd|123\d*|qwerty\w*|abc\d*|hunter2|letmein|here)$|"
    r"<[^<>]*>|\$\{|\{\{|\$\(|%\(|#\{|\[[A-Z_ ]+\]|(?-i:\bYOUR[_-]|_HERE\b|EXAMPLE)|(?i:placeholder|change-?me|dummy|redacted|not-set|paste-)|"
    r"[xX]{6,}|\*{4,}|\.{3,}|…|^\W*(?:0{8,}\W*)+$|(?i:0123456789|abcdefghijklm)",
    re.I,
)
_REFERENCE = re.compile(
    r"^(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|\$[\w{(].*|%\w+%|[a-z]+(?:[._/][a-z]+)+|(?:process\.env|os\.environ|env|System\.getenv|vault|ssm|secretsmanager|keyring|file|arn)[.:[(/].*|"
    r"[\w.-]*/[\w./-]*\.\w{1,5}|[/.~][\w./-]*)$"
)
_CAMEL_NAME = re.compile(r"^[a-z]{2,}(?:[A-Z][a-z]+)+$")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")
_LITERAL = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`")
_ASSIGN = re.compile(
    r"([A-Za-z_$][\w$.-]*)[\"'\]]?\s*(?::\s*(?:&?(?:'\w+\s+)?[A-Za-z][\w<>\[\]?]*)\s*=|:=|=>|==?|:|,)\s*(?:[A-Za-z_:.]*\()?\s*(?:[rbuLfs]|b?r)?(?=[\"'`])"
)
_JOIN = re.compile(r"[\"'`]\s*(?:\+|\.|&|\|\||\.\.|<>)?\s*\\?\s*[\"'`]")
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/@:\"'`<>]*):([^\s@/\"'`]+)@([^\s/:\"'`?#]+)")
_QUERY = re.compile(r"[?&;](?:sig|signature|auth|auth_token|key|api[_-]?key|token|access[_-]?token|secret|client_secret|password|passwd|pwd|code|x-amz-signature)=([^&\s\"'`#<>]{8,})", re.I)
_HEADER = re.compile(r"\b(Bearer|Basic|Digest|Token|ApiKey)\s+([A-Za-z0-9+/_.~-]{8,}={0,2})")
_XHEADER = re.compile(r"\b(?:X-[A-Za-z-]*(?:Key|Token|Auth|Secret)|Authorization|Private-Token|Api-Key|Cookie)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_.~-]{16,}={0,2})", re.I)
_SPOKEN = re.compile(
    r"(?<![\w.$-])(pass(?:word|wd|phrase|code)?|pwd|pw|psw|kennwort|passwort|secret|token|api[ _-]?key|credential)\b[\"']?\s*(=>|:=|=|:|\bis\b|\bwas\b)?\s*[\"'`]?([^\s\"'`,;)\]}]{8,})",
    re.I,
)
_TRIGGER = re.compile(
    r"pass|pwd|\bpw\b|psw|secret|token|key|cred|auth|bearer|basic |jwt|session|grant|\bpat|_pat|bot|hmac|salt|sign|cookie|hook|dsn|://|-----begin|"
    r"[a-z0-9+/_-]{16,}|[\"'`][^\s\"'`]{16,}[\"'`]|kennwort|client|licen",
    re.I,
)
_LOCAL = re.compile(r"^(?:localhost|127(?:\.\d+){3}|0\.0\.0\.0|\[?::1\]?|host\.docker\.internal|[\w-]+\.local(?:host|domain)?)$", re.I)
_BASE32 = re.compile(r"^[A-Z2-7]+=*$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}?$")
_DIGEST = re.compile(r"^(?:sha(?:1|224|256|384|512)|md5|blake[23]\w*)[-:=$]", re.I)
#: A long token; a run of letters in it that reads like a word; a line of so long a token alone is a block of data.
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=.$@%\\-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=(-])")
_WORD_RUN = re.compile(r"[A-Z]?[a-z]{3,}")
_BLOCK = 40
#: A quoted string that is no token by its signs, and no address, markup or format.
_QUOTED = re.compile(r"(?<=[\"'`])(?=[^\"'`]*[!#&*^~?|@$.=;-])[A-Za-z0-9!#&*^~?|@$._=;+-]{16,}(?=[\"'`])")
#: Keys have up to 512 bits (88 signs in base 64); what is longer and has no name is data.
_LONGEST = 100
_PUBLIC = re.compile(r"BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)|\bssh-(?:rsa|ed25519|dss)\b|\becdsa-sha2|;base64,", re.I)
_URL_PATH = re.compile(r"://[^\s\"'`?#]*$")
#: The name or word that a token belongs to.
_NAMED = re.compile(r"([A-Za-z_$][\w$.-]*)[\"'\]]?(?:\s*:\s*&?(?:'\w+\s+)?[A-Za-z][\w<>\[\]?]*)?\s*(?::=|=>|==?|:|,|\s)\s*[(\[]?\s*[\"'`]?$")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def chance_entropy(n: int, alphabet: int) -> float:
    """About the mean entropy of ``n`` random symbols out of ``alphabet`` (Miller-Madow correction, bounded by log2 n)."""
    full = math.log2(alphabet)
    return min(math.log2(max(n, 2)) * 0.97, full - min(full * 0.5, (alphabet - 1) / (2 * n * math.log(2))) if n >= alphabet else math.log2(max(n, 2)) - n / (2.2 * alphabet))


def is_random(value: str, shortest: int = 16) -> bool:
    """Whether a token looks drawn at random from its alphabet."""
    n = len(value)
    if n < shortest or any(c.isspace() for c in value):
        return False
    if _HEX.match(value):
        return n >= 20 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= RANDOM_SHARE * chance_entropy(n, 16)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "p" for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if turns < 0.25 * n or len({*kinds} - {"p"}) < 2:
        return False
    return entropy(value) >= RANDOM_SHARE * chance_entropy(n, alphabet_of(value))


def alphabet_of(value: str) -> int:
    """The size of the least usual alphabet that holds a token: base 32, 36 (digits and one case) or 64."""
    if _BASE32.match(value):
        return 32
    return 36 if not (any(map(str.isupper, value)) and any(map(str.islower, value))) else 64


def is_key_like(value: str) -> bool:
    """Whether a token with no credential's name beside it is random enough to be one: no hash, id, digest, path or words put together."""
    kinds = {"d" if c.isdigit() else "l" if c.islower() else "u" for c in value if c.isalnum()}
    if len(kinds) < 3 or _HEX.match(value) or _UUID.match(value) or _DIGEST.match(value) or is_placeholder(value, names=True):
        return False
    return is_random(value) and sum(map(len, _WORD_RUN.findall(value))) <= 0.55 * len(value)


def is_harmless(name: str) -> bool:
    """Whether a name says that its value is no credential."""
    words = words_of(name)
    return not {*words, "".join(words[-2:])}.isdisjoint(HARMLESS)


def unnamed(line: str) -> list[tuple[int, int, str]]:
    """Spans of random tokens and quoted strings for which no name and no form speaks."""
    out = []
    for m in (*_LONG.finditer(line), *_QUOTED.finditer(line)):
        value = m.group()
        if len(value) > _LONGEST or not is_key_like(value) or len(value) >= _BLOCK and not line.replace(value, "").strip(" \t\r\"'`,;+\\()"):
            continue  # a line of nothing else belongs to a block of data or to a public key
        if _PUBLIC.search(line) or _URL_PATH.search(line[: m.start()]):
            continue
        before = _NAMED.search(line[: m.start()])
        if before and is_harmless(before.group(1)):
            continue
        out.append((m.start(), m.end(), "random"))
    return out


def is_placeholder(value: str, names: bool = False) -> bool:
    """Whether a value only stands for a credential; ``names``: a variable's name counts too."""
    value = value.strip()
    return bool(_PLACEHOLDER.search(value) or _REFERENCE.match(value) or names and _CAMEL_NAME.match(value))


def is_password(value: str, exact: bool) -> bool:
    """Whether a value named or introduced as a password can be one.  ``exact``: a quoted value of a name that ends so."""
    if len(value) < 6 or any(c.isspace() for c in value) or is_placeholder(value, names=True):
        return False
    mixed = any(c.isdigit() for c in value) or any(not c.isalnum() and c not in "_-./" for c in value)
    return mixed or (exact and len(value) >= 8 and value.lower() != value.upper() and not value.isupper())


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name)]


def judge_named(name: str, value: str) -> str | None:
    """What a quoted value assigned to ``name`` is."""
    words = words_of(name)
    if not words:
        return None
    joined = "".join(words[-2:])
    has = {*words, joined}
    if has & HARMLESS and not (words[-1] in PASSWORDS):
        return None
    if words[-1] in PASSWORDS or (has & PASSWORDS and not has & {"policy", "length", "min", "max", "reset", "strength", "input"}):
        return "password" if is_password(value, words[-1] in PASSWORDS) else None
    strong = has & SECRETS
    if not strong or is_placeholder(value) or _UUID.match(value) or _DIGEST.match(value):
        return None
    if strong <= WEAK and _HEX.match(value) and not has & {"cookie", "master", "session", "auth"} and "key" not in words:
        return None
    return "secret" if is_random(value) else None


def _basic(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = plain.partition(":")
    return bool(colon) and bool(password) and plain.isprintable() and not is_placeholder(password)


def scan_line(line: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of the credentials in one line, private key blocks aside."""
    if not _TRIGGER.search(line):
        return []
    spans: list[tuple[int, int, str]] = []
    for m in ISSUED.finditer(line):
        body = m.group()
        if not is_placeholder(body) and entropy(body[4:]) > 2.5:
            spans.append((m.start(), m.end(), "issued"))
    for m in _ADDRESS.finditer(line):
        user, password, host = m.groups()
        if not _LOCAL.match(host) and not is_placeholder(password) and password.lower() != user.lower():
            spans.append((m.start(2), m.end(2), "address"))
    for m in _QUERY.finditer(line):
        if is_random(m.group(1)) and not is_placeholder(m.group(1)):
            spans.append((m.start(1), m.end(1), "address"))
    for m in _HEADER.finditer(line):
        kind, value = m.groups()
        if _basic(value) if kind == "Basic" else is_random(value) and not is_placeholder(value):
            spans.append((m.start(2), m.end(2), "header"))
    for m in _XHEADER.finditer(line):
        if is_random(m.group(1)) and not is_placeholder(m.group(1)):
            spans.append((m.start(1), m.end(1), "header"))
    for m in _ASSIGN.finditer(line):
        lit = _LITERAL.match(line, m.end())
        if not lit:
            continue
        start, end, value = lit.start() + 1, lit.end() - 1, lit.group()[1:-1]
        ends = [(start, end)]
        while (j := _JOIN.match(line, ends[-1][1])) and (nxt := _LITERAL.match(line, j.end() - 1)):
            ends.append((nxt.start() + 1, nxt.end() - 1))
            value += nxt.group()[1:-1]
        kind = judge_named(m.group(1), value)
        if not kind and len(ends) > 1:
            whole = ISSUED.fullmatch(value)
            kind = "issued" if whole and not is_placeholder(value) else None
        if kind:
            spans += [(a, b, kind) for a, b in ends if b > a]
    if not spans:
        for m in _JOIN.finditer(line):  # a token cut in two outside of an assignment
            left = re.search(r"[\w-]+$", line[: m.start()])
            right = re.match(r"[\w-]+", line[m.end() :])
            if left and right and ISSUED.fullmatch(left.group() + right.group()) and not is_placeholder(left.group() + right.group()):
                spans += [(left.start(), left.end(), "issued"), (m.end(), m.end() + right.end(), "issued")]
    for m in _SPOKEN.finditer(line):
        word, sign, value = m.groups()
        value = value.rstrip(".!?") if not sign or sign in ("is", "was") else value
        if word.lower() in PASSWORDS:
            good = bool(sign) and is_password(value, False) if sign not in ("is", "was") else is_password(value, False) and any(map(str.isdigit, value))
        else:
            good = is_random(value) and not is_placeholder(value) and not _UUID.match(value)
        if good and not _ADDRESS.search(value) and "(" not in value and not value.startswith(("$", "//")):
            spans.append((m.start(3), m.start(3) + len(value), "spoken"))
    known = list(spans)  # the kind that a name or form gives comes before
    spans += [x for x in unnamed(line) if all(x[1] <= a or b <= x[0] for a, b, _ in known)]
    return _merge(spans)


def _merge(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


_CLEAN: set[str] = set()
_BODY = re.compile(r"[A-Za-z0-9+/=]{20,}")


def scan(source: str) -> list[tuple[int, int, int, str]]:
    """``(line, start, end, kind)`` of all credentials; offsets count from the start of the source, lines from 1."""
    found: list[tuple[int, int, int, str]] = []
    at = 0
    for number, line in enumerate(source.split("\n"), 1):
        if line not in _CLEAN:
            spans = scan_line(line)
            found += [(number, at + a, at + b, kind) for a, b, kind in spans]
            key = "-----BEGIN" in line and PRIVATE.search(line)
            if key:
                begin = at + key.end()
                end = PRIVATE_END.search(source, begin)
                stop = end.start() if end else at + len(line)
                other = source.find("-----BEGIN", begin)
                if 0 <= other < stop:
                    stop = other
                block = source[begin:stop]
                body = re.search(r"[A-Za-z0-9+/=]{16,}", re.sub(r"\\[nr]|[\s\"'+,.]", "", block))
                if body and not is_placeholder(body.group()):
                    found.append((number, begin, stop, "private key"))
            if not spans and not key:
                if len(_CLEAN) >= REMEMBERED:
                    _CLEAN.clear()
                _CLEAN.add(line)
        at += len(line) + 1
    return found


_MASKED = re.compile(r"(\\.|[\s\"'`+,])|.", re.S)


def mask(source: str, found: list[tuple[int, int, int, str]]) -> str:
    """The source with every found span replaced, character by character, by ``X``.

    Length, line breaks, escapes and quotes stay, so the code around a span and
    every offset after it remain valid.
    """
    out, at = [], 0
    for _, start, end, _ in sorted(found, key=lambda x: (x[1], x[2])):
        start = max(start, at)
        if end <= start:
            continue
        out.append(source[at:start])
        out.append(_MASKED.sub(lambda m: m.group(1) or "X", source[start:end]))
        at = end
    out.append(source[at:])
    return "".join(out)


def _find(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"node_id": [], "line_number": [], "kind": []}
    for node, source in zip(cols["id"], cols["source"]):
        for line, kind in dict.fromkeys((x[0], x[3]) for x in scan(source)):
            out["node_id"].append(node)
            out["line_number"].append(line)
            out["kind"].append(kind)
    return out


def find_credentials(nodes: DataFrame) -> DataFrame:
    """``node_id, line_number, kind`` of the lines of FILE sources that hold a usable credential.

    Lines are split at LF and count from 1.  Null or empty sources give no row;
    repeated deliveries of a file give each line once; other columns are
    ignored; an empty table gives no rows.
    """
    kept = files(nodes).where(F.col("id").isNotNull()).select("id", "source")
    return map_columns(kept, _find, "node_id string, line_number bigint, kind string").distinct()


def _redact(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"node_id": [], "masked": [], "found": []}
    for node, source in zip(cols["id"], cols["source"]):
        found = scan(source)
        if found:
            out["node_id"].append(node)
            out["masked"].append(mask(source, found))
            out["found"].append(len({(x[0], x[3]) for x in found}))
    return out


def redact(nodes: DataFrame) -> DataFrame:
    """``node_id, masked, found``: the masked source of every FILE that holds a credential; as many characters and lines as before."""
    kept = files(nodes).where(F.col("id").isNotNull()).select("id", "source")
    return map_columns(kept, _redact, "node_id string, masked string, found int").dropDuplicates(["node_id"])
