"""Credentials in source code and configuration: find them corpus-wide and mask them (problem 4).

Three steps. Literals that stand where a secret would stand are indexed from all files and variables. Every
file and variable is scanned again for these values with an automaton, so that a value is also found where
nothing around it gives it away. Values that many owners have, anywhere in the corpus, are placeholders,
samples or defaults and are suppressed; the places of all that is rare and structured enough are confirmed.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A literal that this share of all owners (repositories) have, and at least so many, is shared widely: no
#: secret. A share, as weak passwords of different owners coincide in a large corpus. PEM blocks are exempt.
SHARED_SHARE, SHARED_LEAST = 0.02, 5
#: A confirmed value shorter than this is looked for if it is no plain word, and with a delimiter on both sides.
RESCAN_LENGTH = 8
#: Characters that a word goes on with: between two of them a short value is a part of something else.
_JOINS = frozenset("_-.$@#%&+*/\\~!?^=")
#: Values that one automaton holds (about 10 MB). More are looked for with a filter of FILTER_BITS bits for values
#: and their heads, which is of a fixed size, and a join with the values: one scan for any number of them.
BLOCK_VALUES, FILTER_BITS = 200_000, 1 << 27
#: Characters of a value's head that the automaton holds; the rest is compared in place. Characters of the part that
#: the join compares; the rest of a longer value is compared after it.
HEAD, JOINED = 8, 256
#: Characters of a text that the filter reads at once.
SLICE = 1_000_000
#: A longer value is no password that someone chose; it is a token if it looks drawn at random.
LONGEST = 200

SPANS = "origin string, record_key string, version bigint, owner string, line_no bigint, first int, last int, kind string, literal string"

# Prefixes and forms of public credential formats.
_FORMS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"
    r"|(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})"
    r"|(?P<git>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,})"
    r"|(?P<chat>xox[abeprs]-[A-Za-z0-9-]{16,})"
    r"|(?P<live>[a-z]{2,8}_(?:live|test|prod)_[A-Za-z0-9]{16,})"
    r"|(?P<google>AIza[A-Za-z0-9_-]{35})"
    r")(?![A-Za-z0-9_])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
# What stands for a key's body; words long enough not to stand in one by chance.
_NO_KEY = re.compile(r"\.\.\.|…|<[^<>]*>|\$\{|\{\{|\*{4,}|[xX]{8,}|redacted|placeholder|changeme|your[-_ ]|insert[-_ ]|example[-_ ]", re.I)
# The patterns below take time in proportion to a line's length, as a file may be one line.
_URL = re.compile(r"(?<=[A-Za-z0-9+.-])://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s/\"'`<>]*?)@(?=[\w.\[-])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
_QUERY = re.compile(r"[?&](?=[A-Za-z_]*=)(?=[A-Za-z_]*(?:token|key|secret|password|passwd|pwd|sig|auth|credential))[A-Za-z_]*=(?P<value>[^&\s\"'`#<>]+)", re.I)
_HEADER = re.compile(r"\b(?P<how>Bearer|Basic|Token|ApiKey)\s+(?P<value>[A-Za-z0-9._~+/=-]{8,})")
_USER_FLAG = re.compile(r"(?:\s|^|[\"'`])(?:-u|--user)[ =][\"']?(?P<user>[\w.@-]+):(?P<value>[^\s\"'`]+)")
_STRING = r"(?:\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*`)"
_ASSIGN = re.compile(
    r"(?<![\w.-])(?P<name>(?!(?:var|const|let|export|final|static|public|private|val|set|return|local|readonly)\b)[A-Za-z_][\w.-]*)[\"'`]?\]?"
    r"(?:[ \t]+[\w.\[\]*]+(?=[ \t]*=)|[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\]]*(?=[ \t]*=))?[ \t]*(?::=|=>|=|:)[ \t]*"
    r"(?P<value>" + _STRING + r"(?:\s*(?:\+\s*)?(?:\\\s*)?" + _STRING + r")*|[^\s\"'`,;])"  # without quotes: the first character of what goes on to a white space
)
_SPACE = re.compile(r"\s")
_CALL = re.compile(r"\b(?=\w*(?:login|logon|sign_?in|authenticate|connect|password|passwd|credential|basic_?auth))(?P<name>\w+)\((?P<args>[^()\n]*)\)", re.I)
_LITERAL = re.compile(_STRING)
# What a comment tells: 'login for the box: admin / value', 'the password is value'.
_PROSE = re.compile(r"\b(?:log-?in|sign-?in|logon|pass(?:word|phrase|wd)?|credentials?)\b", re.I)
_PROSE_PAIR = re.compile(r"(?<=[\w.@-])\s+/\s+(?P<value>[^\s\"'`,;]+)")
_PROSE_IS = re.compile(r"\s(?:is|was)\s+[\"']?(?P<value>[^\s\"'`,;]+)", re.I)
_PROSE_END = re.compile(r"[/:=]|[.;!?](?=\s|$)")
# Key material that is meant to be public.
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|CRL|DH PARAMETERS)[A-Z ]*-----.*?-----END [A-Z0-9 ]+-----", re.S)
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Anything that makes a line worth a look, in small letters; each is found by a plain substring search.
_TRIGGERS = ("pass", "pwd", "secret", "token", "auth", "cred", "key", "pw", "salt", "://", "bearer", "basic", "eyj", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "_live_", "_test_", "_prod_", "aiza", "-u ", "-u=", "--user", "signer", "login", "logon", "signin", "sign_in", "sign-in", "log-in", "connect", "pat")

# Words of names that hold secrets, words that say what else a name holds, and words that
# make a key one.
_SECRET_WORDS = frozenset("pass passwd password pwd pw passphrase passcode secret token auth cred creds credential credentials apikey pat".split())
_OTHER_WORDS = frozenset(
    "label name names header headers type pattern regex timeout ttl expiry expires count max min limit field prefix suffix path file dir url uri endpoint host hint prompt message text title length size len policy mode "
    "scope scopes id ids index column format provider enabled enable required public pub error err test_id kind class retry skip use default usage help desc description placeholder algorithm alg method issuer audience realm bucket version".split()
)
_KEY_WORDS = frozenset("api master enc encryption storage signing sign hmac private priv tls ssl ssh deploy access secret service account session license auth app client crypto aes rsa admin root webhook hook shared server consumer".split())
_NO_KEY_WORDS = frozenset("public cache primary foreign sort partition idempotency map dict object row lookup index group hash routing".split())
# What stands for a value that is kept elsewhere or still to come.
_ELSEWHERE = re.compile(
    r"\$\{|\$\(|\{\{|\{[A-Za-z_.]*\}|<[^<>]*>|%[sdvq(]|^\$[A-Za-z_]|^%\w+%$|^(?:env|vault|secret|ssm|arn|file|ref|kms|op|keyring|sops)[:/]|^@|getenv|environ|process\.env|mustenv"
    r"|change[-_ ]?me|replace[-_ ]?(?:me|this|with)|your[-_ ]|[-_ ]here$|placeholder|example|sample|dummy|redacted|masked|hidden|todo|fixme|insert[-_ ]|^(?:test|foo|bar|none|null|nil|undefined|true|false|secret|password|passwd|token|admin|root|user|username)$"
    r"|^(.)\1*$|^[x*.#\-_]+$|\*{3,}|x{6,}|^0+$|1234567|abcdef",
    re.I,
)


def is_elsewhere(value: str) -> bool:
    """Whether a value only refers to a secret or stands in for one."""
    return bool(_ELSEWHERE.search(value))


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name) if not w.isdigit()]


def is_random(value: str) -> bool:
    """Whether a value looks drawn at random: long, of one alphabet, its kinds of characters mixed."""
    if len(value) < 16 or not re.fullmatch(r"[A-Za-z0-9+/_=.~-]+", value):
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return len(value) >= 24 and len(set(value)) >= 8
    body = value.rstrip("=")
    kinds = sum(bool(re.search(k, body)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    changes = sum(a.islower() != b.islower() or a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return kinds >= 2 and len(set(body)) >= 10 and changes * 4 >= len(body)


def is_password(value: str) -> bool:
    """Whether a value could be a chosen or generated password: one word with digits or signs in it."""
    if len(value) < 5 or re.search(r"\s", value) or is_elsewhere(value):
        return False
    if len(value) > LONGEST:
        return is_random(value)
    if re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)*|[A-Z_]+|[\d.,:]+|v?\d+(?:\.\d+)+|\d+[smhd]", value):
        return False
    return bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"[0-9!$#%^&*+?~@=]", value) or is_random(value))


def names_secret(name: str) -> str:
    """'word' for a name of a password or token, 'key' for a secret key, '' for any other name."""
    words = name_words(name)
    if not words:
        return ""
    if words[-1] in _OTHER_WORDS or any(w in ("public", "pub") for w in words) or words[0] in ("err", "error", "retry", "skip", "use", "enable", "max", "min", "default") and words[-1] not in ("key", "cred", "creds", "password", "passwd", "pwd", "pw"):
        return ""
    if any(w in _SECRET_WORDS for w in words) or name.lower().replace("_", "") in ("apikey",):
        return "word"
    if words[-1] in ("key", "keys", "salt", "signer") and not set(words) & _NO_KEY_WORDS and (len(words) == 1 or set(words) & _KEY_WORDS or words[-1] != "key"):
        return "key"
    return ""


def _unquote(raw: str, base: int) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The text of one or several joined literals, with the span from its first to its last character."""
    if raw[0] not in "\"'`":
        return raw.rstrip(",;)}]"), base, base + len(raw.rstrip(",;)}]")), []
    parts = [(m.start() + 1, m.end() - 1) for m in _LITERAL.finditer(raw)]
    return "".join(raw[a:b] for a, b in parts), base + parts[0][0], base + parts[-1][1], [(base + a, base + b) for a, b in parts]


def _basic(value: str) -> bool:
    """Whether a Basic header's value holds a user and a password."""
    try:
        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return False
    return bool(colon and user and password) and not is_elsewhere(password)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(first, last, kind, literal) of every place in a text where a secret seems to stand.

    A later form that overlaps an earlier one is left out. kind 'pem' needs no further proof; all others
    are held against the owners of their literal.
    """
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, none overlapping

    def add(first: int, last: int, kind: str, literal: str) -> None:
        k = bisect.bisect_left(taken, (first, last))
        if last > first and not (k and taken[k - 1][1] > first or k < len(taken) and taken[k][0] < last):
            taken.insert(k, (first, last))
            found.append((first, last, kind, literal))

    if "-----BEGIN" in text:
        taken += [m.span() for m in _PUBLIC.finditer(text)]
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\n|[^A-Za-z0-9+/]", "", m["body"])
            if len(body) >= 40 and len(set(body)) >= 10 and not _NO_KEY.search(m["body"]):
                add(m.start(), m.end(), "pem", m[0])
    for a, b in _lines_of_interest(text):
        _line(text, a, b, add)
    return found


def _lines_of_interest(text: str) -> list[tuple[int, int]]:
    """(first, last) of every line that holds a trigger, in order."""
    low = text.lower()
    if len(low) != len(text):  # some letters have longer small forms
        low = "".join(c.lower() if c.isascii() else c for c in text)
    lines: dict[int, int] = {}
    for word in _TRIGGERS:
        at = low.find(word)
        while at >= 0:
            a = text.rfind("\n", 0, at) + 1
            b = text.find("\n", at)
            b = len(text) if b < 0 else b
            lines[a] = b
            at = low.find(word, b)
    return sorted(lines.items())


def _line(text: str, a: int, b: int, add) -> None:
    line = text[a:b]
    if "://" in line:
        for m in _URL.finditer(line):
            if _has_scheme(line, m.start()) and len(m["value"]) >= 3 and not is_elsewhere(m["value"]) and not m["value"].startswith("$"):
                add(a + m.start("value"), a + m.end("value"), "url", m["value"])
        for m in _QUERY.finditer(line):
            if is_random(m["value"]) and not is_elsewhere(m["value"]):
                add(a + m.start("value"), a + m.end("value"), "query", m["value"])
    for m in _FORMS.finditer(line):
        if not is_elsewhere(m[0]):
            add(a + m.start(), a + m.end(), m.lastgroup, m[0])
    for m in _HEADER.finditer(line):
        value = m["value"]
        if m["how"] == "Basic" and _basic(value) or m["how"] != "Basic" and is_random(value) and not is_elsewhere(value):
            add(a + m.start("value"), a + m.end("value"), "header", value)
    for m in _USER_FLAG.finditer(line):
        if is_password(m["value"]):
            add(a + m.start("value"), a + m.end("value"), "flag", m["value"])
    for m in _CALL.finditer(line):
        for s in _LITERAL.finditer(m["args"]):
            value = s[0][1:-1]
            if is_password(value) and "/" not in value[:1]:
                first = a + m.start("args") + s.start() + 1
                add(first, first + len(value), "call", value)
    _assignments(text, a, b, add)
    for m in _told(line):
        value = m["value"].rstrip(".)]>")
        if is_password(value) and not re.search(r"[(\[{]", value):
            add(a + m.start("value"), a + m.start("value") + len(value), "prose", value)


def _told(line: str) -> Iterator[re.Match]:
    """What stands after a word for a login, within the same sentence: 'user / value' behind it, or 'is value'."""
    words = list(_PROSE.finditer(line))
    if not words:
        return
    pairs, says = list(_PROSE_PAIR.finditer(line)), list(_PROSE_IS.finditer(line))
    if not pairs and not says:
        return
    ends = [m.start() for m in _PROSE_END.finditer(line)]
    strokes, verbs = [m.start() for m in pairs], [m.start() for m in says]
    at = 0
    for m in words:
        k = m.end()
        if m.start() < at:
            continue
        told = None
        n = bisect.bisect_right(strokes, k)
        e = bisect.bisect_left(ends, k)
        while e < len(ends) and line[ends[e]] in ":=":  # 'login: admin / value'
            e += 1
        if n < len(pairs) and (e == len(ends) or pairs[n].start() <= ends[e] <= pairs[n].start("value")):
            told = pairs[n]
        else:
            n, e = bisect.bisect_left(verbs, k), bisect.bisect_left(ends, k)
            if n < len(says) and (e == len(ends) or verbs[n] < ends[e]):
                told = says[n]
        if told:
            yield told
            at = told.end()


def _has_scheme(line: str, at: int) -> bool:
    """Whether a URL's scheme ends at `at`: what stands before has a letter in it."""
    while at > 0 and line[at - 1] in "0123456789+.-":
        at -= 1
    return at > 0 and bool(_SCHEME.match(line, at - 1))


def _assignments(text: str, a: int, b: int, add) -> None:
    """Every assignment of a line. A value without quotes may be a whole program or record without a white
    space: if it is no secret itself, the quoted values that are assigned within it are looked at."""
    at = end = a
    while m := _ASSIGN.search(text, at, b):
        first = m.start("value")
        if m.start() < end <= first:  # such a value's end is the name of no other
            at = end
            continue
        if text[first] in "\"'`":
            _assigned(text, m, m.end(), add)
            at = m.end()
            continue
        within = first < end
        if not within:
            space = _SPACE.search(text, first, b)
            end = space.start() if space else b
        at = end if not within and _assigned(text, m, end, add) else first


def _assigned(text: str, m: re.Match, end: int, add) -> bool:
    """Whether an assignment, whose value ends at `end`, is one of a secret; it is added then."""
    how = names_secret(m["name"])
    if not how:
        return False
    first = m.start("value")
    raw = text[first:end]
    if text[first] not in "\"'`" and len(raw.rstrip(",;)}]")) > LONGEST and not re.fullmatch(r"[A-Za-z0-9+/_=.~-]++[,;)}\]]*", raw):
        return False  # too long for a password, and no token by its letters
    if raw[0] == "=":
        return False  # a comparison, or padding
    if raw[0] in "\"'`":
        more = _ASSIGN.match(text, m.start())  # joined pieces may go on in the next lines
        raw = more["value"] if more else raw
    value, first, last, _ = _unquote(raw, m.start("value"))
    if not value or is_elsewhere(value) or "://" in value or "-----BEGIN" in value:
        return False
    if raw[0] not in "\"'`" and re.search(r"[()\[\]{}]|^(?:[a-z_]\w*\.)+\w+$", value):
        return False  # an expression, not a literal
    if how == "word" and is_password(value) or how == "key" and is_random(value):
        add(first, last, how, value)
        return True
    return False


# ------------------------------------------------------------------------------------------ the operator


def decode(content: bytes | str | None) -> str:
    """The text of a file; bytes that are no UTF-8 survive a way back with the same error handler."""
    return "" if content is None else content if isinstance(content, str) else bytes(content).decode("utf-8", "surrogateescape")


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def owner_of(path: str | None) -> str:
    """The repository of a file: the first part of its path."""
    parts = [p for p in re.split(r"[\\/]+", path or "") if p not in ("", ".")]
    return parts[0] if parts else ""


def _rows_of(origin: str, key: str, version: int, owner: str, text: str, spans: list[tuple[int, int, str, str]], shift: int = 0) -> list[tuple]:
    ends: list[int] | None = None
    rows = []
    for first, last, kind, literal in spans:
        line = 0
        if origin == "source":
            if ends is None:
                ends = [m.start() for m in re.finditer("\n", text)]
            line = bisect.bisect_left(ends, first) + 1
        rows.append((origin, key, version, owner, line, first - shift, last - shift, kind, _clean(literal)))
    return rows


def _pieces(sources: DataFrame | None, variables: DataFrame | None) -> DataFrame:
    """(origin, record_key, version, owner, name, body) of every row, nulls left out.

    Rows stay where they are: repeated rows of a path or id are not brought together here, which would
    move all contents, but in the small results. version is a hash of the content.
    """
    parts = []
    if sources is not None:
        some = sources.filter("path is not null and content is not null").select("path", F.col("content").cast("binary").alias("body"))
        parts.append(some.select(F.lit("source").alias("origin"), F.col("path").alias("record_key"), F.xxhash64("body").alias("version"), F.col("path").alias("owner"), F.lit("").alias("name"), "body"))
    if variables is not None:
        some = variables.filter("id is not null and initial_value is not null").select("id", "name", "file_path", F.col("initial_value").cast("binary").alias("body"))
        parts.append(some.select(F.lit("variable").alias("origin"), F.col("id").alias("record_key"), F.xxhash64("body").alias("version"), F.coalesce("file_path", "id").alias("owner"), F.coalesce("name", F.lit("")).alias("name"), "body"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SPANS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for origin, key, version, owner, name, body in batch[["origin", "record_key", "version", "owner", "name", "body"]].itertuples(index=False):
            text = decode(body)
            if origin == "variable":
                lead = f"{name} = " if name else ""
                spans = [s for s in candidates(lead + text) if s[1] > len(lead)]
                rows += _rows_of(origin, key, version, owner_of(owner), lead + text, spans, len(lead))
            else:
                rows += _rows_of(origin, key, version, owner_of(owner), text, candidates(text))
        yield pd.DataFrame(rows, columns=columns)


def index_literals(sources: DataFrame | None, variables: DataFrame | None) -> DataFrame:
    """Every place where a secret seems to stand, one row each, over all files and variables."""
    return _pieces(sources, variables).mapInPandas(_extract, SPANS)


def confirm(places: DataFrame) -> DataFrame:
    """The places whose literal is not shared widely. Owners are counted per literal over all places in the
    corpus: first distinct (literal, owner), so that a literal that stands everywhere is no hot group."""
    owners = places.filter("kind <> 'pem'").select("literal", "owner").distinct().groupBy("literal").agg(F.count("*").alias("_owners"))
    total = places.select("owner").distinct().agg(F.count("*").alias("_total"))
    shared = owners.join(F.broadcast(total), F.col("_owners") >= F.greatest(F.lit(SHARED_LEAST), F.col("_total") * SHARED_SHARE)).select(F.col("literal").alias("_shared"))
    return places.join(shared, (F.col("literal") == F.col("_shared")) & (F.col("kind") != "pem"), "left_anti")


def _delimited(text: str, first: int, last: int) -> bool:
    """Whether a short value stands alone: not joined to a word, but behind '=' and before a full stop."""
    before = text[first - 1 : first]
    if before in _JOINS and before != "=":
        return False
    after = text[last : last + 1]
    return after not in _JOINS or after in ".!?" and not text[last + 1 : last + 2].strip()


class Automaton:
    """All occurrences of many values in a text: their heads in an Aho-Corasick automaton, the rest
    compared where a head stands. An occurrence inside a longer word is none."""

    def __init__(self, values: list[str]):
        import ahocorasick

        by_head: dict[str, set[str]] = {}
        for v in values:
            by_head.setdefault(v[:HEAD], set()).add(v)
        self.machine = ahocorasick.Automaton()
        for head, own in by_head.items():  # tokens of one issuer share a head: lengths are tried, not values
            self.machine.add_word(head, (head, sorted({len(v) for v in own}, reverse=True), own))
        if by_head:
            self.machine.make_automaton()
        self.empty = not by_head

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        if self.empty:
            return []
        met = []
        for end, (head, lengths, own) in self.machine.iter(text):
            first = end - len(head) + 1
            if first and text[first - 1].isalnum():
                continue
            for n in lengths:
                last = first + n
                if (value := text[first:last]) in own and not (last < len(text) and text[last].isalnum()) and (n >= RESCAN_LENGTH or _delimited(text, first, last)):
                    met.append((first, last, value))
                    break
        return apart(met)


def apart(met: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """Occurrences of which none overlaps another: the first, then the longest, wins."""
    found, reach = [], -1
    for first, last, v in sorted(met, key=lambda x: (x[0], -x[1])):
        if first >= reach:
            reach = last
            found.append((first, last, "known", v))
    return found


# ------------------------------------------------------------------------- more values than an automaton holds

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` characters."""
    n = max(0, len(codes) - length + 1)
    h = np.full(n, length, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            h = (h ^ codes[k : k + n]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32 | zlib.adler32(text.encode("utf-8", "surrogatepass"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _spots(h: int) -> tuple[int, int]:
    """Two bits of the filter for a hash."""
    h = (h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h % FILTER_BITS, (h >> 32) * 2654435761 % FILTER_BITS


def _bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, mask): the bits that some values set in the filter, for their heads and for their first JOINED characters."""
    for batch in batches:
        words: dict[int, int] = {}
        for v in batch.literal:
            head = v[:HEAD]
            for spot in (*_spots(int(_hashes(_codes(head), len(head))[0])), *_spots(_hash(v[:JOINED]))):
                words[spot >> 6] = words.get(spot >> 6, 0) | 1 << (spot & 63)
        yield pd.DataFrame({"word": list(words), "mask": np.array(list(words.values()), dtype=np.uint64).view(np.int64)})


class Filter:
    """What may be a value in a text, by a filter of fixed size."""

    def __init__(self, words: np.ndarray, masks: np.ndarray):
        self.words = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
        self.words[words] = masks

    def has(self, h: int) -> bool:
        return all(int(self.words[s >> 6]) >> (s & 63) & 1 for s in _spots(h))

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(first, slice) of every part of a text between word bounds that may be a value's first JOINED characters."""
        for a in range(0, len(text), SLICE):
            yield from self._find(text, a, min(len(text), a + SLICE))

    def _find(self, text: str, a: int, b: int) -> Iterator[tuple[int, str]]:
        """Those that begin in a..b: of a long text one slice at a time is hashed."""
        lead, till = max(0, a - 1), min(len(text), b + JOINED)
        codes = _codes(text[lead:till])
        word = np.fromiter((c.isalnum() for c in text[lead:till]), dtype=bool, count=till - lead)
        starts = np.ones(len(word), dtype=bool)
        starts[1:] = ~word[:-1]
        starts[: a - lead] = starts[b - lead :] = False
        ends = np.flatnonzero(~word) + lead
        ends = np.append(ends, till) if till == len(text) else ends
        for length in range(5, HEAD + 1):
            h = _hashes(codes, length)
            at = np.flatnonzero(starts[: len(h)])
            with np.errstate(over="ignore"):
                m = h[at] * _MIX
                one, two = m % np.uint64(FILTER_BITS), (m >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(FILTER_BITS)
            hit = np.ones(len(at), dtype=bool)
            for s in (one, two):
                hit &= (self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
            for first in (at[hit] + lead).tolist():
                if length < HEAD:
                    lasts = [first + length]
                else:  # a value ends before a character that is no letter or digit
                    near = ends[np.searchsorted(ends, first + HEAD) :]
                    near = near[: np.searchsorted(near, first + JOINED)].tolist()
                    lasts = sorted({first + HEAD, *near, min(first + JOINED, len(text))})
                for last in lasts:
                    if first + length <= last and self.has(_hash(text[first:last])):
                        yield first, text[first:last]


def find(sources: DataFrame | None, variables: DataFrame | None) -> DataFrame:
    """Every place of a secret: (origin, record_key, version, owner, line_no, first, last, kind, literal).

    first and last are character offsets in the decoded text (for a variable, in its value). A place that
    both scans find comes twice, and so do those of repeated rows; take the distinct places. Null and
    empty texts hold nothing. File contents are never shuffled.
    """
    from symloom.session import Cuts

    some = sources if sources is not None else variables
    spark = some.sparkSession
    cuts = Cuts(spark, "secrets")
    pieces = _pieces(sources, variables)
    index = cuts.cut(index_literals(sources, variables))
    values = cuts.cut(index.filter("kind <> 'pem'").select("literal").distinct().mapInPandas(_worth, "literal string"))
    places = index.unionByName(cuts.cut(rescan(pieces, values)))
    confirmed = confirm(places)
    # A key with several contents is one record, the one with the greatest hash; there are few such keys.
    versions = pieces.groupBy("origin", "record_key").agg(F.max("version").alias("_version"), F.min("version").alias("_other")).filter("_version <> _other").select(F.col("origin").alias("_origin"), F.col("record_key").alias("_key"), "_version")
    joined = confirmed.join(versions, (F.col("origin") == F.col("_origin")) & (F.col("record_key") == F.col("_key")), "left")
    return joined.filter("_version is null or _version = version").drop("_origin", "_key", "_version")


def _worth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values that are looked for again: all but short plain words."""
    for batch in batches:
        yield batch[[len(v) >= RESCAN_LENGTH or is_password(v) for v in batch.literal]]


def rescan(pieces: DataFrame, values: DataFrame) -> DataFrame:
    """Every place of a value of `values` (literal, distinct), kind 'known'. Either way gives the same places: an
    automaton where one holds all values, else a filter and a join, so that the values never meet on one machine."""
    spark = pieces.sparkSession
    columns = [c.split()[0] for c in SPANS.split(", ")]
    if values.count() <= BLOCK_VALUES:
        sent = spark.sparkContext.broadcast([r[0] for r in values.toLocalIterator()])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = Automaton(sent.value)
            for batch in batches:
                rows: list[tuple] = []
                for origin, key, version, owner, body in batch[["origin", "record_key", "version", "owner", "body"]].itertuples(index=False):
                    text = decode(body)
                    spans = machine.find(text)
                    if spans:
                        rows += _rows_of(origin, key, version, owner_of(owner), text, spans)
                yield pd.DataFrame(rows, columns=columns)

        return pieces.mapInPandas(scan, SPANS)
    bits = values.mapInPandas(_bits, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most FILTER_BITS / 64 rows
    held = spark.sparkContext.broadcast((bits["word"].to_numpy(), bits["mask"].to_numpy().view(np.uint64)))
    longest = int(values.agg(F.max(F.length("literal"))).first()[0])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve = Filter(*held.value)
        for batch in batches:
            rows: list[tuple] = []
            for origin, key, version, owner, body in batch[["origin", "record_key", "version", "owner", "body"]].itertuples(index=False):
                text = decode(body)
                for first, part in sieve.find(text):
                    line = text.count("\n", 0, first) + 1 if origin == "source" else 0
                    rows.append((origin, key, version, owner_of(owner), line, first, _clean(part), _clean(text[first : first + longest + 2]) if len(part) == JOINED else _clean(text[first : first + len(part) + 2]), _clean(text[first - 1 : first])))
            yield pd.DataFrame(rows, columns=[*columns[:6], "part", "rest", "before"])

    near = pieces.mapInPandas(pick, ", ".join(SPANS.split(", ")[:6]) + ", part string, rest string, before string")
    wanted = values.select("literal", F.substring("literal", 1, JOINED).alias("part"))
    met = near.join(wanted, "part").filter(F.startswith("rest", "literal"))
    grouped = met.groupBy("origin", "record_key", "version", "owner").agg(F.collect_list(F.struct("first", "line_no", "literal", "rest", "before")).alias("met"))  # bounded by the record

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for origin, key, version, owner, own in batch[["origin", "record_key", "version", "owner", "met"]].itertuples(index=False):
                at, lines = [], {}
                for m in own:
                    v, text = m["literal"], m["before"] + m["rest"]
                    a = len(m["before"])
                    after = text[a + len(v) : a + len(v) + 1]
                    if not after.isalnum() and (len(v) >= RESCAN_LENGTH or _delimited(text, a, a + len(v))):
                        at.append((m["first"], m["first"] + len(v), v))
                        lines[m["first"]] = m["line_no"]
                rows += [(origin, key, version, owner, lines[a], a, b, kind, v) for a, b, kind, v in apart(at)]
            yield pd.DataFrame(rows, columns=columns)

    return grouped.mapInPandas(settle, SPANS)


_MASKED = re.compile(r"[^\s\"'`+\\]")


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span's characters replaced; quotes, white space, joins and PEM frames stay."""
    out, at = [], 0
    for first, last in sorted(spans):
        first = max(first, at)
        if last <= first:
            continue
        out.append(text[at:first])
        out.append("\n".join(line if line.lstrip().startswith("-----") else _MASKED.sub("x", line) for line in text[first:last].split("\n")))
        at = last
    out.append(text[at:])
    return "".join(out)


def redact(sources: DataFrame | None, variables: DataFrame | None) -> DataFrame:
    """(origin, record_key, n_secrets, redacted) of every record that holds a secret.

    Lengths, lines and all other characters (and bytes that are no UTF-8) stay as they were.
    """
    spans = find(sources, variables).select("origin", "record_key", "version", "first", "last").distinct()
    # The spans of one file are bounded by the file, which is one row already.
    per = spans.groupBy("origin", "record_key", "version").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    joined = _pieces(sources, variables).join(per, ["origin", "record_key", "version"])
    # Only records that hold a secret are brought together; find() has chosen one content of each, which may be repeated.
    one = joined.groupBy("origin", "record_key").agg(F.max(F.struct("body", "firsts", "lasts")).alias("r")).select("origin", "record_key", "r.*")

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, key, body, firsts, lasts in batch[["origin", "record_key", "body", "firsts", "lasts"]].itertuples(index=False):
                text = _masked(decode(body), list(zip(firsts, lasts)))
                rows.append((origin, key, len(firsts), text.encode("utf-8", "surrogateescape")))
            yield pd.DataFrame(rows, columns=["origin", "record_key", "n_secrets", "redacted"])

    return one.mapInPandas(mask, "origin string, record_key string, n_secrets int, redacted binary")
