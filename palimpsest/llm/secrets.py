"""Secret scans: candidate strings judged by a random forest.

Patterns propose candidates: private key blocks, with their header lines and escaped line
ends; passwords in urls, up to the last ``@`` before a slash or white space; values after
``:`` or ``=``, a quoted one to its closing quote and one after a secret's name to white
space; dotted tokens; and every long run of key characters, plain long words among them.
Proposals may overlap, as a value may hold a shorter key.  A forest trained on labelled
findings then removes the false positives from features of the candidate (length,
character transitions, class shares, entropy, dictionary coverage), of the document's
path, and of the neighbouring words.  Training data are bounded by ``MAX_TRAINING_ROWS``;
scoring reads every whole text in one pass, without a shuffle.

What is proposed has least lengths: 6 characters after a secret's name, 8 after any other
name, 16 (or three dotted parts of 8) without one; shorter secrets are not looked for.

Defined results: a null or empty text has no candidates and stays as it is; a null
path, or none in the table, counts as no path; overlapping candidates judged secret are
masked as one span; a score that equals the threshold is a finding; a quoted value whose
quote does not close on its line ends at white space; very long texts and secrets are read
once and masked whole; repeated rows each give their own row; an empty table gives an
empty one; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import claim, map_rows, slices, with_text

#: At most so many labelled findings train a forest.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.5
MASK = "[SECRET]"
_NEAR_CHARS = 48

_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"
#: No upper lengths: a whole run is one candidate, and is read once.
CANDIDATE = re.compile(
    rf"""({_BLOCK}(?:(?:[^-]|-(?!----))*-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----|(?:[A-Za-z0-9+/=\s]|\\[nr])*))"""
    r"""|://[^\s/:@]*:([^\s/"]+)@"""
    r"""|[:=](?![ \t]*\\?["'`]{0,3}-----BEGIN )[ \t]{0,2}["']?([A-Za-z0-9+/_.~!@$%^*-]{8,}={0,2})"""
    r"""|(?<![\w+/-])([A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,})"""
    r"""|(?<![\w+/-])([A-Za-z0-9+/_-]{16,}={0,2})"""
)
#: Number of the pattern's group for a value after ``:`` or ``=``.
_ASSIGNED = 3
#: A value between quotes on one line, the quotes escaped or not.
QUOTED = re.compile(
    r"""(?:=>|[:=])[ \t]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`|\\"((?:[^"\\\n]|\\(?!"))*)\\")"""
)
_SEPARATOR = re.compile(r"==|=>|:=|[:=]")
_UNQUOTED = re.compile(r"""[ \t]{0,2}(?:\\?["'`]){0,3}+(?!-----BEGIN )(\S{6,})""")
#: Words that speak for and against a secret nearby, and prefixes of issued keys.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private")
DECOY_WORDS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "example", "placeholder", "version", "build", "etag", "href", "src", "isbn", "integrity", "base64", "http", "revision")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xox", "eyJ", "AIza", "glpat-")
_NAME = rf"(?i:pass(?:word|wd|phrase|code)?|pwd|{'|'.join(SECRET_WORDS)}|api key)" + r"""\w{0,16}[\\"'\])]{0,3}[ \t]{0,2}"""
#: A secret's name at the end of what stands before a separator, and before a value.
_NAMED = re.compile(_NAME + "$")
_NAMED_VALUE = re.compile(_NAME + r"""(?:=>|[:=]{1,2})[ \t]{0,2}\\?["'`]?$""")
#: An expression of a programming language: names with calls, attributes, places, or a variable to be filled in.
_EXPRESSION = re.compile(r"""[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_]\w*|\([^()]*\)?|\[[^\[\]]*\])+[,;)\]}]*|\$?\{[^{}]*\}+[,;]?|<[^<>]*>[,;]?|%\([^()]*\)s""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PATH_DECOYS = ("test", "spec", "example", "sample", "fixture", "mock", "doc")
FEATURES = (
    "length", "transitions", "digits", "uppers", "lowers", "symbols", "entropy", "hexadecimal",
    "dictionary", "assigned", "prefix", "secret_before", "decoy_before", "decoy_after", "path_decoy", "slashes",
    "likelihood", "case_changes", "glued", "armoured", "named", "quoted", "spaces", "part_length", "own_name", "expression", "in_url",
)


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """Plain words of four letters or more in a public rank file."""
    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]).strip() for line in lines)
        return frozenset(t.decode().lower() for t in tokens if len(t) >= 4 and t.isalpha())


class Lexicon:
    """Plain words, the lengths they have by their first four letters, and how likely their letters follow one another."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        lengths: dict[str, set[int]] = {}
        counts = np.ones((26, 26))
        for word in words:
            lengths.setdefault(word[:4], set()).add(len(word))
            letters = [ord(c) - 97 for c in word if "a" <= c <= "z"]
            for a, b in pairwise(letters):
                counts[a, b] += 1
        self.lengths = {start: sorted(n, reverse=True) for start, n in lengths.items()}
        self.pairs = np.log2(counts / counts.sum(1, keepdims=True)).ravel()

    def coverage(self, candidate: str) -> float:
        """Share of the characters that longest words cover, left to right."""
        low, i, covered = candidate.lower(), 0, 0
        while i < len(low):
            step = next((k for k in self.lengths.get(low[i : i + 4], ()) if low[i : i + k] in self.words), 0)
            covered += step
            i += step or 1
        return covered / max(1, len(low))

    def likelihood(self, candidate: str) -> float:
        """Mean log-likelihood, in bits, of neighbouring letters; that of a random pair where there are none."""
        codes = np.frombuffer(candidate.lower().encode("latin-1", "replace"), np.uint8).astype(np.int64) - 97
        letters = (codes >= 0) & (codes < 26)
        both = letters[1:] & letters[:-1]
        return float(self.pairs[codes[:-1][both] * 26 + codes[1:][both]].mean()) if both.any() else -4.7


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(dictionary(path))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(candidate: str, before: str, after: str, path: str | None, assigned: bool, lexicon_: Lexicon) -> list[float]:
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    share = np.unique(list(candidate), return_counts=True)[1] / n
    glued = before[-1:].isalpha() or after[:1].isalpha()
    parts, call = _PARTS.findall(candidate), after[:1] in ("(", "[") and candidate[-1:].isalnum()
    named, quoted = bool(_NAMED_VALUE.search(before)), assigned and before[-1:] in ('"', "'", "`")
    before, after, path = before.lower(), after.lower(), (path or "").lower()
    return [
        min(n, 200),
        sum(a != b for a, b in pairwise(kinds)) / max(1, n - 1),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        float(-(share * np.log2(share)).sum()),
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        lexicon_.coverage(candidate),
        float(assigned),
        float(candidate.startswith(KEY_PREFIXES)),
        float(any(w in before for w in SECRET_WORDS)),
        float(any(w in before for w in DECOY_WORDS)),
        float(any(w in after for w in DECOY_WORDS)),
        float(any(w in path for w in PATH_DECOYS)),
        candidate.count("/") / n,
        lexicon_.likelihood(candidate),
        sum({a, b} == {1, 2} for a, b in pairwise(kinds)) / max(1, n - 1),
        float(glued),
        float(candidate.startswith("-----BEGIN")),
        float(named),
        float(quoted),
        sum(map(str.isspace, candidate)) / n,
        min(32.0, sum(map(len, parts)) / max(1, len(parts))),
        float(any(w in candidate.lower() for w in SECRET_WORDS)),
        float(call or _EXPRESSION.fullmatch(candidate) is not None),
        float(after.startswith("@")),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, left child (right follows), share of secrets."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                at = node[rows]
                node[rows] = left[at] + (x[rows, feature[at]] > threshold[at])
            total += share[node]
        return total / max(1, len(self.trees))


def train(x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 10, least: int = 4, seed: int = 7) -> Forest:
    """Bagged trees; each split takes the best of 1.5 sqrt(features) random features by Gini impurity."""
    rng, grown = np.random.default_rng(seed), []
    tried = max(1, round(1.5 * x.shape[1] ** 0.5))
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, threshold, left, share = [-1], [0.0], [0], [0.0]
        waiting = [(0, rows, 0)]
        while waiting:
            node, rows, level = waiting.pop()
            share[node] = float(y[rows].mean())
            if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], tried, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                value, positive = x[rows, f][order], np.cumsum(y[rows][order])
                n = np.arange(1, len(rows))
                p, q = positive[:-1] / n, (positive[-1] - positive[:-1]) / (len(rows) - n)
                impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                impurity[(value[1:] == value[:-1]) | (n < least) | (len(rows) - n < least)] = np.inf
                k = int(impurity.argmin())
                if impurity[k] < best[0]:
                    middle = (value[k] + value[k + 1]) / 2
                    best = (impurity[k], int(f), middle if middle < value[k + 1] else value[k])
            if best[1] < 0:
                continue
            feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
            above = x[rows, best[1]] > best[2]
            for part in (rows[~above], rows[above]):
                waiting.append((len(feature), part, level + 1))
                feature.append(-1), threshold.append(0.0), left.append(0), share.append(0.0)
        grown.append((np.array(feature), np.array(threshold), np.array(left), np.array(share)))
    return Forest(tuple(grown))


def fit(findings: pd.DataFrame, lexicon_: Lexicon) -> Forest:
    """Train from labelled findings: columns candidate, before, after, path, assigned, label."""
    if len(findings) > MAX_TRAINING_ROWS:
        raise ValueError(f"at most {MAX_TRAINING_ROWS} labelled findings")
    x = np.array([features(r.candidate, r.before, r.after, r.path, r.assigned, lexicon_) for r in findings.itertuples()])
    return train(x, findings["label"].to_numpy(np.float64))


class Findings:
    """Findings made by rule, in named forms: issued-looking keys against what only looks like them.

    Each form gives the candidate, the text right before it, and whether it is assigned.
    """

    HEX, UPPER, LETTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
    LITTLE = ("a", "the", "of", "to", "in", "is", "and", "or", "your", "for", "not", "on", "with", "new", "please")
    PLAIN_NAMES = ("name", "title", "label", "message", "text", "class", "id", "type", "value", "description", "path", "format", "lang", "state")
    PASS_NAMES = ("password", "passwd", "pwd", "passphrase", "db_password", "secret", "PASSWORD", "user_pass")
    MIXED, URLSAFE, BASE64 = LETTERS + "0123456789", LETTERS + "0123456789_-", LETTERS + "0123456789+/"

    def __init__(self, words: list[str], seed: int):
        self.words, self.rng = words, np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def size(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high))

    def run(self, letters: str, n: int) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), n))

    def join(self, by: str, n: int) -> str:
        return by.join(self.pick(self.words) for _ in range(n))

    def named(self, names: tuple[str, ...] | list[str]) -> str:
        return f"{self.pick(names)}{self.pick(['=', ': ', ' = '])}{self.pick(['', chr(34), chr(39)])}"

    def sentence(self) -> str:
        """Plain words with little ones between them, as labels and messages have."""
        words = [self.pick(self.LITTLE) if not self.size(0, 3) else self.pick(self.words) for _ in range(self.size(4, 15))]
        return " ".join([words[0].capitalize(), *words[1:]]) + self.pick(["", "", ".", "!", ":"])

    def expression(self) -> str:
        """Code that stands where a secret's value might."""
        name = f"{self.pick(self.words)}{self.pick(['_', '.', ''])}{self.pick(['password', 'token', 'secret', 'key', 'auth'])}"
        forms = (f"self.{name}", f'os.environ["{name.upper()}"]', f"get{self.pick(self.words)}()", f'{self.pick(self.words)}.{self.pick(self.words)}.get({self.pick([chr(34), chr(39)])}{self.pick([name, self.pick(self.words).capitalize()])}")', f"self.{self.pick(self.words)}({name})", f"os.environ['{self.pick(self.words).upper()}_KEY']", f"{self.pick(self.words)}.{self.pick(self.words)}({name})", name, f"${{{name.upper()}}}", f"<{name}>", f"{{{{{name}}}}}", f"{self.pick(self.words).capitalize()}[{self.pick(self.words)}]")
        return self.pick(forms) + self.pick(["", "", ",", ";", ")"])

    def camel(self) -> str:
        """An identifier of several words, whole or cut, with capitals and sometimes a figure."""
        parts = [(w if self.size(0, 2) else w[: self.size(2, 7)]) for w in (self.pick(self.words) for _ in range(self.size(2, 6)))]
        parts = [p.upper() if len(p) < 5 and not self.size(0, 6) else p.capitalize() for p in parts]
        if self.size(0, 3):
            parts[0] = parts[0].lower()
        return "".join(parts) + (str(self.size(0, 100)) if not self.size(0, 6) else "")

    def invented(self) -> str:
        """A long word of no listed language: chunks of plain words."""
        word = ""
        while len(word) < self.size(16, 34):
            piece = self.pick(self.words)
            word += piece[: self.size(2, 6)] if self.size(0, 2) else piece[-self.size(2, 6) :]
        return word.capitalize() if not self.size(0, 5) else word

    #: Forms of secrets, each with what stands before it.
    def secret(self, form: str) -> tuple[str, str, bool]:
        secret_name = self.named(SECRET_WORDS)
        match form:
            case "hex":
                return self.run(self.HEX, self.pick([16, 18, 20, 32, 40, 64])), secret_name, True
            case "access_id":
                return self.pick(["AKIA", "ASIA"]) + self.run(self.UPPER, 16), "", False
            case "prefixed":
                return self.pick(["ghp_", "gho_", "sk-", "sk_live_", "glpat-", "AIza"]) + self.run(self.MIXED, self.size(20, 40)), "", False
            case "mixed":
                return self.run(self.MIXED, self.size(20, 64)), secret_name, True
            case "password":
                return self.pick(self.words) + self.run(self.MIXED + "!@$%", self.size(5, 12)), self.named(["password", "passwd", "pwd"]), True
            case "punctuated":
                return self.run(self.MIXED + self.PUNCTUATION, self.size(8, 28)), self.named(self.PASS_NAMES), True
            case "phrase":
                return self.join(self.pick(["-", "_", ""]), self.size(3, 6)) + self.pick(["", "", "!", "7", "42"]), self.named(self.PASS_NAMES), True
            case "spoken":
                return self.join(" ", self.size(3, 7)), self.named(self.PASS_NAMES).rstrip("\"'") + self.pick(['"', "'"]), True
            case "bearer":
                return self.run(self.MIXED, self.size(28, 48)), self.pick(["bearer ", "token ", "auth "]), False
            case "letters":
                return self.run(self.LETTERS, self.size(20, 64)), self.pick(["bearer ", "token ", "the key ", secret_name]), False
            case "blob":
                return self.run(self.BASE64, self.size(80, 900)), self.pick([secret_name, "bearer ", "private "]), bool(self.size(0, 2))
            case "jwt":
                return ".".join(["eyJ" + self.run(self.URLSAFE, self.size(20, 40)), self.run(self.URLSAFE, self.size(40, 300)), self.run(self.URLSAFE, 43)]), self.pick(["bearer ", "", "token "]), False
            case "pem":
                lines = "\n".join(self.run(self.BASE64, 64) for _ in range(self.size(3, 20)))
                return f"-----BEGIN {self.pick(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----", self.pick(["", "", secret_name, "key: |\n"]), False
            case _:
                return self.run(self.pick([self.MIXED, self.LETTERS, self.MIXED + "!@#$%&*"]), self.size(8, 20)), f"{self.pick(['postgres', 'https', 'amqp'])}://{self.pick(self.words)}:", False

    def decoy(self, form: str) -> tuple[str, str, bool]:
        match form:
            case "hash":
                return self.run(self.HEX, self.pick([32, 40, 64])), f"{self.pick(['commit', 'sha256', 'md5', 'checksum', 'digest', 'etag'])}{self.pick([' ', ': ', '='])}", bool(self.size(0, 2))
            case "uuid":
                return "-".join(self.run(self.HEX, k) for k in (8, 4, 4, 4, 12)), self.pick(["uuid ", "id ", "guid "]), False
            case "path":
                return self.join("/", 4) + f"/{self.size(0, 1000)}", self.pick(["", "href=", "see "]), bool(self.size(0, 2))
            case "snake":
                return self.join("_", 3) + f"{self.size(0, 100)}", "", False
            case "joined":
                return self.join("", 2), ": ", True
            case "placeholder":
                return self.pick(["changeme", "password", "your_password", "example_token", "xxxxxxxx", "placeholder"]), f"{self.pick(['password', 'token', 'secret'])}=", True
            case "digits":
                return self.run("0123456789", self.size(16, 22)), self.pick(["isbn: ", "id: ", "no ", "number ", "with "]), bool(self.size(0, 2))
            case "kebab":
                return self.join("-", 3) + f"-{self.size(0, 10000)}", "", False
            case "invented":
                return self.invented(), "", False
            case "near_secret":
                return self.invented(), f"{self.pick(SECRET_WORDS)} {self.pick(['', 'and ', 'or '])}", False
            case "camel":
                return self.camel(), self.pick(["", "", "call ", "new ", "token ", "= "]), False
            case "value":
                made = self.pick([self.join(self.pick(["-", "_", " ", "", ".", "/"]), self.size(2, 5)), self.camel(), self.invented()])
                return made, self.named(self.PLAIN_NAMES), True
            case "prose":
                return self.sentence(), self.named(self.PLAIN_NAMES if self.size(0, 3) else SECRET_WORDS).rstrip("\"'") + self.pick(['"', "'"]), True
            case "expression":
                return self.expression(), self.named(SECRET_WORDS if self.size(0, 3) else self.PLAIN_NAMES).rstrip("\"'"), True
            case "url":
                return f"//{self.join('.', 2)}.com/{self.join('/', 2)}", self.pick(["http:", "https:"]), True
            case "integrity":
                return f"sha384-{self.run(self.BASE64, 64)}", "integrity=" + chr(34), True
            case _:
                return self.run(self.BASE64, self.size(60, 400)), "src=data:image/png;base64,", False


SECRET_FORMS = ("hex", "access_id", "prefixed", "mixed", "password", "bearer", "letters", "blob", "jwt", "pem", "url_password", "punctuated", "phrase")
#: Secrets that need their closing quote to be seen whole.
QUOTED_FORMS = ("spoken",)
DECOY_FORMS = ("hash", "uuid", "path", "snake", "joined", "placeholder", "digits", "kebab", "invented", "near_secret", "camel", "url", "integrity", "image", "value", "prose", "expression")


def labelled_findings(n: int, words: list[str], seed: int = 11, secrets: tuple[str, ...] = SECRET_FORMS + QUOTED_FORMS, decoys: tuple[str, ...] = DECOY_FORMS) -> pd.DataFrame:
    """``n`` labelled findings, half of them secrets, of the given forms."""
    made, rows = Findings(words, seed), []
    for i in range(n):
        label, form = i % 2, made.pick(secrets if i % 2 else decoys)
        candidate, before, assigned = made.secret(form) if label else made.decoy(form)
        before, after = f"{made.join(' ', 4)} {before}", made.pick([" ", ". ", ", ", '" ']) + made.join(" ", 4)
        if label and form == "url_password":
            after = "@" + made.join(".", 2)
        if not label and form in ("invented", "near_secret") and made.size(0, 3) == 0:  # part of a word with accents
            before, after = before[:-1] + made.pick("éüñàß"), made.pick(["", "é"]) + after
        path = made.pick(["", "src1", "config/app.py", "web", "notes.txt", *(["tests/data", "docs/example.md"] if not label else [])])
        rows.append((candidate, before[-_NEAR_CHARS:], after[:_NEAR_CHARS], path, assigned, label, form))
    return pd.DataFrame(rows, columns=["candidate", "before", "after", "path", "assigned", "label", "form"])


@lru_cache(maxsize=2)
def default_forest(dictionary_path: str, rows: int = 12_000) -> Forest:
    """A forest from the rule-made findings; the same on every call."""
    known = lexicon(dictionary_path)
    return fit(labelled_findings(rows, sorted(known.words)[::7]), known)


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether the value was assigned, left to right; a wider one before those it holds."""
    found = {m.span(m.lastindex): m.lastindex == _ASSIGNED for m in CANDIDATE.finditer(text)}
    closed = set()
    for m in QUOTED.finditer(text):
        closed.add(m.start())
        a, b = m.span(m.lastindex)
        named = _NAMED.search(text, max(0, m.start() - _NEAR_CHARS), m.start()) is not None
        if b - a >= (6 if named else 8) and (named or not any(map(str.isspace, m[m.lastindex]))):
            found.setdefault((a, b), True)
    end = 0
    for m in _SEPARATOR.finditer(text):
        if m.start() >= end and closed.isdisjoint((m.start(), m.end() - 1)) and _NAMED.search(text, max(0, m.start() - _NEAR_CHARS), m.start()) and (value := _UNQUOTED.match(text, m.end())):
            found.setdefault(value.span(1), True)
            end = value.end()
    return sorted(((a, b, assigned) for (a, b), assigned in found.items()), key=lambda c: (c[0], -c[1]))


def findings_of(text: str | None, path: str | None, forest: Forest, lexicon_: Lexicon, threshold: float) -> tuple[int, list[dict], str | None]:
    """Number of candidates, the spans judged secret, overlapping ones as one, and the text with them masked."""
    spans = candidates(text) if text else []
    if not spans:
        return 0, [], text
    hits: list[dict] = []
    for at in range(0, len(spans), 4096):
        some = spans[at : at + 4096]
        x = np.array([features(text[a:b], text[max(0, a - _NEAR_CHARS) : a], text[b : b + _NEAR_CHARS], path, assigned, lexicon_) for a, b, assigned in some])
        for (a, b, _), score in zip(some, forest.score(x).tolist(), strict=True):
            if score < threshold:
                continue
            if hits and a < hits[-1]["end"]:
                hits[-1].update(end=max(b, hits[-1]["end"]), score=max(score, hits[-1]["score"]))
            else:
                hits.append({"start": a, "end": b, "score": score})
    out, at = [], 0
    for h in hits:
        out += [text[at : h["start"]], MASK]
        at = h["end"]
    return len(spans), hits, "".join([*out, text[at:]])


def scan(df: DataFrame, forest: Forest, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_candidates, n_findings, findings, clean_text``; spans count code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        words, span = lexicon(dictionary_path), pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for part in slices(batch):
                found = [findings_of(t, p, forest, words, threshold) for t, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                counts, hits, clean = zip(*found, strict=True)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(list(hits), pa.list_(span)), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_candidates", "n_findings", "findings", "clean_text"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return chosen.mapInArrow(run, "doc_id long, n_candidates long, n_findings long, findings array<struct<start: bigint, end: bigint, score: double>>, clean_text string")


def masked_documents(df: DataFrame, forest: Forest, dictionary_path: str, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, with secrets masked in their texts."""

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("secrets")
        words, names = lexicon(dictionary_path), batch.schema.names
        texts = batch.column(names.index(text_col)).to_pylist()
        paths = batch.column(names.index(path_col)).to_pylist() if path_col in names else [None] * batch.num_rows
        return with_text(batch, text_col, [findings_of(t, p, forest, words, threshold)[2] for t, p in zip(texts, paths, strict=True)])

    return map_rows(df, mask)
