"""Secret scans: candidates by patterns, false positives removed by a random forest.

A candidate is a token of at least MIN_LENGTH characters that mixes character kinds or stands behind
a name such as `token =`; behind the name of a credential it is the whole value, to the closing quote
or the next blank, of any SHORT characters or more.  The forest looks at its length, at its character
transitions (how often kinds change, and how likely its letters follow each other in words), how much of it
words of a dictionary cover, whether it stands in a path, and the words beside it.  Dictionary and letter
transitions are a Lexicon: the WORDS words that most documents have, counted over all of them.

The forest is trained in numpy on labelled findings: a table (text, start, end, label) of any origin, or, where
none is at hand, labelled_findings(), a repeatable set of made-up secrets and look-alikes of public kinds.
Scanning is one narrow pass over whole texts.  Null and empty texts have no findings; findings do not
overlap and are in text order.  Repeated rows stay; a column named findings is replaced, others are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MIN_LENGTH = 12
#: Characters of a value behind the name of a credential, at least and at most.
SHORT, LONG = 8, 4096
TREES, DEPTH, LEAF = 40, 8, 3
#: Findings that training takes at most (a sample of more).
MOST_FINDINGS = 20_000
#: Words of a lexicon at most, documents that must have a word, and its letters.
WORDS, LEAST_DOCS, WORD_LETTERS = 50_000, 3, (3, 20)
THRESHOLD = 0.5
MASK = "<secret>"

# Words by which names of credentials, and names of harmless identifiers, are told.
SECRET_WORDS = ("key", "secret", "token", "password", "passwd", "pwd", "auth", "credential", "private", "bearer", "apikey", "access")
HARMLESS_WORDS = ("commit", "sha", "md5", "sha256", "checksum", "digest", "hash", "uuid", "guid", "id", "isbn", "phone", "tel", "card", "version", "example", "sample", "test", "image", "build", "order", "invoice", "file", "path", "url", "etag")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "secret", "password", "todo", "none", "null", "test", "here", "insert")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "rk_live_", "AIza", "eyJ", "SG.", "npm_", "hf_")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-=]{%d,}" % MIN_LENGTH)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
_END = re.compile(r"-----END (?:[A-Z]+ )?PRIVATE KEY-----")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]*)[\"']?\s{0,2}(?:[:=]|=>|:=)\s{0,2}[\"']?$")
_BEARER = re.compile(r"\b(bearer|basic)\s$", re.I)
_MARK = re.compile(r"=>|:=|[:=]")
_BEFORE = re.compile(r"([A-Za-z][A-Za-z0-9_.-]*)[\"']?\s{0,2}$")
_AFTER = re.compile(r"\s{0,2}(?:\"([^\"\n]{%d,%d})\"|'([^'\n]{%d,%d})'|([^\s\"']\S{%d,}))" % (SHORT, LONG, SHORT, LONG, SHORT - 1))
_WORD = re.compile(r"[A-Za-z]{2,}")
_PARTS = re.compile(r"[A-Za-z]{3,}")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOWELS = frozenset("aeiouAEIOU")

NAMES = (
    "length", "digit", "upper", "lower", "symbol", "classes", "changes", "entropy", "hex", "vowel", "repeat", "cover", "transition", "placeholder", "prefix", "assigned",
    "secret_name", "harmless_name", "secret_near", "harmless_near", "path", "quoted", "digits_only", "words", "dashes", "run",
)


# -- lexicon -----------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Words, and log probabilities of a letter behind a letter in them (0 to 25; 26 is the word's edge)."""

    words: frozenset[str]
    follow: np.ndarray

    def cover(self, s: str) -> float:
        """The largest share of s that disjoint words cover."""
        best = 0
        for m in _PARTS.finditer(s):
            best += self._covered(m.group().lower())
        return best / len(s)

    def _covered(self, run: str) -> int:
        if run in self.words:
            return len(run)
        upto = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            upto[end] = upto[end - 1]
            for n in range(WORD_LETTERS[0], min(end, WORD_LETTERS[1]) + 1):
                if upto[end - n] + n > upto[end] and run[end - n : end] in self.words:
                    upto[end] = upto[end - n] + n
        return upto[-1]

    def transition(self, s: str) -> float:
        """Mean log probability of the letters that follow letters in s; that of a chance sequence without any."""
        pairs = [(ord(a) - 97, ord(b) - 97) for m in _LETTERS.finditer(s) for a, b in zip(m.group().lower(), m.group().lower()[1:])]
        return float(np.mean([self.follow[p] for p in pairs])) if pairs else -float(np.log(26))


def make_lexicon(words: list[str]) -> Lexicon:
    """A lexicon of the words of ASCII letters; others count as they are, without their transitions."""
    count = np.ones((27, 27))
    for w in words:
        codes = [26, *(ord(c) - 97 for c in w), 26] if w.isascii() else []
        for a, b in zip(codes, codes[1:]):
            count[a, b] += 1
    return Lexicon(frozenset(words), np.log(count / count.sum(1, keepdims=True)))


def lexicon(df: DataFrame, text: str = "text", words: int = WORDS) -> Lexicon:
    """The `words` commonest words of df by the documents that have them; all documents are counted, and ties go by the word."""
    least, most = WORD_LETTERS
    runs = F.array_distinct(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}]+"))
    each = F.filter(runs, lambda w: F.length(w).between(least, most))
    counts = df.select(F.explode(each).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    return make_lexicon([r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(words).collect()])


# -- candidates --------------------------------------------------------------------------------


def _values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of whole values behind names of credentials."""
    at = 0
    for mark in _MARK.finditer(text):
        if mark.start() < at or not (name := _BEFORE.search(text[max(at, mark.start() - 80) : mark.start()])):
            continue
        if not any(w in name.group(1).lower() for w in SECRET_WORDS) or not (m := _AFTER.match(text, mark.end())):
            continue
        kind = next(i for i in (1, 2, 3) if m.group(i) is not None)
        start, value = m.start(kind), m.group(kind)
        if kind == 3:
            value = value.rstrip(".,;\"'")
        kinds = _kinds(value)
        if len(value) >= SHORT and (kinds[0] or kinds[1] or kinds[3]):
            yield start, start + len(value), name.group(1)
        at = m.end(kind)


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, name it is assigned to) of what may be a secret, in text order; a value may hold further candidates."""
    if not text:
        return []
    pems = list(_pems(text)) if "PRIVATE KEY" in text else []
    starts = [a for a, _, _ in pems]

    def inside(c: tuple[int, int, str]) -> bool:
        at = bisect_left(starts, c[1]) - 1
        return at >= 0 and c[0] < pems[at][1]

    values = [c for c in _values(text) if not inside(c)]
    taken = {c[0] for c in values}
    return sorted([*pems, *values, *(c for c in _tokens(text) if c[0] not in taken and not inside(c))])


def _pems(text: str) -> Iterator[tuple[int, int, str]]:
    """Private keys from a BEGIN line to the next END line; the search ends with the last END line."""
    at = 0
    while (first := _BEGIN.search(text, at)) and (last := _END.search(text, first.end())):
        yield first.start(), last.end(), "private key"
        at = last.end()


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    after = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        name = ""
        body = m.group()
        head, mark, tail = body.partition("=")
        if mark and len(tail.rstrip("=")) >= MIN_LENGTH - 4 and head.replace("_", "").replace("-", "").isalpha():
            name, start, body = head, start + len(head) + 1, tail
        stripped = body.rstrip(".-=/" if body.count("=") == 0 else ".-/")
        end = start + len(stripped)
        if start < after or len(stripped) < MIN_LENGTH - 4:
            continue
        if not name:
            before = text[max(0, start - 48) : start]
            found = _NAME.search(before) or _BEARER.search(before)
            name = found.group(1) if found else ""
        kinds = _kinds(stripped)
        if name or kinds[0] and (kinds[1] or kinds[2]) or kinds[1] and kinds[2] and kinds[3] or stripped.startswith(PREFIXES):
            if kinds[0] or kinds[1] or kinds[3]:
                after = end
                yield start, end, name


def _kinds(s: str) -> tuple[bool, bool, bool, bool]:
    return any(map(str.isdigit, s)), any(map(str.isupper, s)), any(map(str.islower, s)), not s.isalnum()


def describe(text: str, start: int, end: int, name: str, known: Lexicon) -> list[float]:
    """The forest's view of a candidate."""
    s = text[start:end]
    n = len(s)
    kind = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    count = np.bincount(kind, minlength=4) / n
    changes = sum(a != b for a, b in zip(kind, kind[1:])) / max(1, n - 1)
    share = np.unique(list(s), return_counts=True)[1] / n
    low = s.lower()
    names = set(re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-4:]
    near = set(before + [w.lower() for w in _WORD.findall(text[end : end + 40])][:3])
    runs, longest = 1, 1
    for a, b in zip(s, s[1:]):
        runs = runs + 1 if a == b else 1
        longest = max(longest, runs)
    return [
        np.log(n), *count, float((count > 0).sum()), changes, float(-(share * np.log2(share)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        sum(c in _VOWELS for c in s) / n, longest / n, known.cover(s), known.transition(s), float(any(p in low for p in PLACEHOLDERS)), float(s.startswith(PREFIXES)), float(bool(name)),
        float(any(w in x for x in names for w in SECRET_WORDS)), float(bool(names.intersection(HARMLESS_WORDS))), float(bool(near.intersection(SECRET_WORDS))), float(bool(near.intersection(HARMLESS_WORDS))),
        float(s.count("/") > 1 or text[max(0, start - 1) : start] == "/" or bool(re.search(r"\.[a-z]{2,4}$", s))), float(text[start - 1 : start] in ("'", '"') and start > 0),
        float(s.isdigit()), float(len(_PARTS.findall(s))), float(s.count("-")), float(longest),
    ]


# -- forest ------------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), cut, left child (right is the next), share of secrets."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(self.feature), len(x)), np.int64)
        tree, row = np.arange(len(self.feature))[:, None], np.arange(len(x))[None]
        for _ in range(DEPTH):
            f = self.feature[tree, at]
            inner = f >= 0
            right = x[row, np.maximum(f, 0)] > self.cut[tree, at]
            at = np.where(inner, self.left[tree, at] + right, at)
        return self.share[tree, at].mean(0)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list]:
    feature, cut, left, share = [-1], [0.0], [0], [0.5]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        p = float(y[rows].mean())
        share[node] = p
        if depth == DEPTH or len(rows) < 2 * LEAF or p in (0.0, 1.0):
            continue
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]]
            n = np.arange(1, len(rows))
            ones = np.cumsum(t)[:-1]
            a, b = ones / n, (t.sum() - ones) / (len(rows) - n)
            impurity = (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
            gain = np.where((v[1:] > v[:-1]) & (n >= LEAF) & (len(rows) - n >= LEAF), p * (1 - p) - impurity, 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], cut[node], left[node] = best[1], best[2], len(feature)
        goes = x[rows, best[1]] > best[2]
        for side, part in enumerate((rows[~goes], rows[goes])):
            todo.append((left[node] + side, part, depth + 1))
        for values, empty in ((feature, -1), (cut, 0.0), (left, 0), (share, 0.5)):
            values += [empty, empty]
    return feature, cut, left, share


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[rows], y[rows], rng))
    size = max(len(g[0]) for g in grown)
    pad = lambda k, fill, kind: np.array([g[k] + [fill] * (size - len(g[k])) for g in grown], kind)
    return Forest(pad(0, -1, np.int64), pad(1, 0.0, float), pad(2, 0, np.int64), pad(3, 0.5, float))


@dataclass
class Scanner:
    """A trained forest and the lexicon that its descriptions use."""

    forest: Forest
    known: Lexicon


def train(findings: list[tuple[str, int, int, int]], known: Lexicon, trees: int = TREES, seed: int = 5) -> Scanner:
    """From labelled findings (text, start, end, label); with one label only, that label is predicted everywhere."""
    if len(findings) > MOST_FINDINGS:
        findings = [findings[i] for i in np.sort(np.random.default_rng(seed).choice(len(findings), MOST_FINDINGS, replace=False))]
    x, y = [], []
    for text, start, end, label in findings:
        found = _NAME.search(text[max(0, start - 48) : start]) or _BEARER.search(text[max(0, start - 48) : start])
        x.append(describe(text, start, end, found.group(1) if found else "", known))
        y.append(label)
    return Scanner(fit(np.array(x, float).reshape(-1, len(NAMES)), np.array(y, float), trees, seed), known)


def trained(df: DataFrame, text: str = "text") -> Scanner:
    """A scanner for df: its lexicon, and a forest trained on made-up findings among its words."""
    known = lexicon(df, text)
    return train(labelled_findings(known), known)


def labelled_findings(known: Lexicon, n: int = 4000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """Made-up secrets and look-alikes, half and half, among words of the lexicon and some made-up ones."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    one = lambda items: items[int(rng.integers(len(items)))]
    hexes, digits, upper, lower = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    alnum = digits + upper + lower
    words = sorted(w for w in known.words if w.isascii() and len(w) <= 9)

    def word() -> str:
        if words and rng.random() < 0.8:
            return one(words)
        return "".join(one(("th", "er", "on", "an", "re", "in", "st", "en", "de", "la", "qu", "ment", "ung", "ció", "ado", "ou", "al", "ti")) for _ in range(int(rng.integers(1, 5))))

    def name(words: tuple[str, ...]) -> str:
        base = one(words)
        return one((base, base.upper(), f"{word()}_{base}", f"api_{base}", base.title(), f"{base}_{one(('id', 'value', 'new'))}"))

    def secret() -> tuple[str, str]:
        kind = int(rng.integers(10))
        value = (
            pick(hexes, one((18, 20, 24, 32, 40, 48, 64))), pick(alnum, int(rng.integers(16, 48))), pick(alnum + "+/", int(rng.integers(20, 60))), pick(lower + digits, int(rng.integers(14, 40))),
            one(("AKIA", "ASIA")) + pick(upper + digits, 16), one(("ghp_", "gho_", "glpat-", "npm_", "hf_", "sk_live_", "sk-", "AIza")) + pick(alnum, int(rng.integers(20, 40))),
            "eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", 30) + "." + pick(alnum + "_-", 30), pick(alnum + "!_-", int(rng.integers(12, 24))),
            pick(alnum + "!@#$%^&*?+", int(rng.integers(8, 24))), "".join(word()[:6] for _ in range(int(rng.integers(1, 3)))) + pick(digits + "!@#$&*", 2) + pick(alnum, int(rng.integers(2, 6))) + pick(digits, 1),
        )[kind]
        bare = kind in (4, 5, 6) and rng.random() < 0.6
        lead = "" if bare else name(SECRET_WORDS) + one(("=", " = ", ": ", '="', ' = "', '": "'))
        return lead, value + ('"' if lead.endswith('"') else "")

    def harmless() -> tuple[str, str]:
        kind = int(rng.integers(13))
        if kind == 11:
            return name(SECRET_WORDS) + one((": ", " = ", "=")), one((word().title() + word() + word() + "nd", word() + "ing-" + word() + word() + "ed", word() + "tion/" + word() + "ing", "(" + word() + word() + "ment)"))
        if kind == 12:
            return name(SECRET_WORDS) + one((" = ", "=", ": ")), one((f"os.environ['{word().upper()}']", "getpass.getpass()", f"config.{word()}_{word()}", f"${{{word().upper()}_{word().upper()}}}", f"self.{word()}.{word()}()", f"<{word()}-{word()}>", "Optional[str]", f"{{{{{word()}_{word()}}}}}"))
        if kind == 0:
            return one(("commit ", "sha: ", "md5 ", "checksum: ", "etag = ", "digest=", "")), pick(hexes, one((32, 40, 64)))
        if kind == 1:
            return one(("uuid=", "id: ", "guid ", "")), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return one(("", "card ", "order: ", "id=")), pick(digits, one((12, 13, 15, 16, 19)))
        if kind == 3:
            return name(SECRET_WORDS) + one(("=", ": ", ' = "')), one(("your_api_key_here", "changeme123456", "xxxxxxxxxxxxxxxx", "placeholder_value_1", "INSERT_TOKEN_HERE_0", "example-password-1", "test1234test1234"))
        if kind == 4:
            return "", "/".join(word() for _ in range(int(rng.integers(3, 6)))) + one((".py", ".html", "/v2", ".jpg", "1.txt"))
        if kind == 5:
            return "", one(("v", "build-", "release_")) + ".".join(pick(digits, 2) for _ in range(4)) + "-" + word() + pick(digits, 2)
        if kind == 6:
            return one(("", "phone: ", "tel=")), "-".join(pick(digits, k) for k in (3, 3, 4, 2))
        if kind == 7:
            return "", word() + "-" + word() + "-" + word() + pick(digits, 1)
        if kind == 8:
            return one(("", "file = ", "url=")), word().title() + word().title() + word().title() + pick(digits, int(rng.integers(1, 3)))
        if kind == 9:
            return one(("date=", "", "time: ")), f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}-{pick(digits, 2)}"
        return one(("", "title=", "name: ")), "".join(word() for _ in range(3)) + one(("", "_"))+ word() + pick(digits, 1)

    out = []
    for i in range(n):
        lead, value = secret() if i % 2 else harmless()
        before = " ".join(word() for _ in range(int(rng.integers(0, 8))))
        text = f"{before} {lead}{value} " + " ".join(word() for _ in range(int(rng.integers(0, 6))))
        start = len(before) + 1 + len(lead)
        out.append((text, start, start + len(value.rstrip('"')), i % 2))
    return out


# -- Spark -------------------------------------------------------------------------------------

FINDING = "array<struct<start:int,end:int,score:double>>"
_FINDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan_text(texts: list[str | None], scanner: Scanner, threshold: float = THRESHOLD) -> list[list[dict]]:
    found = [candidates(t) for t in texts]
    x = [describe(t, *c, scanner.known) for t, cs in zip(texts, found, strict=True) for c in cs]
    score = scanner.forest.predict(np.array(x)).tolist() if x else []
    out, at = [], 0
    for cs in found:
        spans: list[dict] = []
        for (a, b, name), p in zip(cs, score[at : at + len(cs)], strict=True):
            if p < threshold and name != "private key":
                continue
            if spans and a < spans[-1]["end"]:  # inside the last one, or across its end
                spans[-1] = {"start": spans[-1]["start"], "end": max(b, spans[-1]["end"]), "score": max(p, spans[-1]["score"])}
            else:
                spans.append({"start": a, "end": b, "score": p})
        out.append(spans)
        at += len(cs)
    return out


def scan(df: DataFrame, scanner: Scanner, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with `findings`: spans in characters (end exclusive) and the forest's share of votes; replaces a column of that name."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(scanner)  # at most WORDS words and TREES trees
    rows = df.drop("findings")
    names, place = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scan_text(batch.column(place).to_pylist(), shared.value, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, _FINDING)], [*names, "findings"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, findings {FINDING}")


def redact(scanned: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """scanned without `findings`, each found span of the text replaced by the mask."""
    joined = F.expr(
        f"aggregate(findings, struct('' as done, 0 as at), (acc, f) -> struct(concat(acc.done, substring(`{text}`, acc.at + 1, f.start - acc.at), '{mask}') as done, f.end as at),"
        f" acc -> concat(acc.done, substring(`{text}`, acc.at + 1)))"
    )
    return scanned.withColumn(text, F.when(F.size("findings") > 0, joined).otherwise(F.col(text))).drop("findings")
