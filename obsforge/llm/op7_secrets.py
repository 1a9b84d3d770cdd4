"""Secret scans: three fixed kinds, and a linear-chain conditional random field for more.

The field tags the tokens of a sequence (words, and signs one by one) as the beginning of a secret,
its inside or outside. Features are a token's shape and that of the run it is glued into, the words
and signs around it and the file's. Every line of a text is a sequence. Lines whose best labels are
outside by a bound on what any secret in them could gain are not decoded; the result is the same.

It is learned from generated lines and from stretches of lines of a bounded sample of documents, those
around anchors (a change between letters and digits or from lower to upper case inside a word, a cue
that is assigned a value, a known prefix, or a password in a URL), where the values of the fixed kinds
are the secrets.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_share, map_batches, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)

#: Bounds of what the field learns from besides the generated lines: documents, about so many, sequences, and tokens of each piece of one.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_SEQUENCES = 4_000
PIECE_TOKENS = 64
GENERATED = 2_400
STEPS = 120
#: Characters before and after an anchor that its stretch takes in, up to the next white space, within the line.
AROUND = 80

_CUE = r"pass(?:word|wd|[_-]?phrase|code)?|pwd|secret|token|(?:api|access|private|signing|encryption)?[_-]?key|bearer|auth(?:orization)?|credentials?|cred|login|pin"
_PREFIXES = ("ghp_", "gho_", "github_pat_", "sk_live_", "sk_test_", "sk-", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "npm_", "AKIA", "ASIA")
_ANCHOR = re.compile(
    r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]"
    rf"|(?i:(?<![a-z])(?:{_CUE}))[\"']?(?:\x20{{0,3}}(?:=>|[:=])|\x20+(?:is|was)\b|\x20+(?=[A-Za-z0-9+/_.~-]{{12}}))"
    r"|(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, _PREFIXES)) + r")[A-Za-z0-9]"
    r"|://[^\s/@:]+:[^\s/@]+@"
)
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CONSONANTS = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{6}")
_PIECES = re.compile(r"[A-Za-z0-9]+")
_WORD_PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]+|[0-9]{1,4}")
_RUN = re.compile(r"""[^\s"'`<>()\[\]{},;:=|]+""")
_CUES = frozenset("password passwd passphrase passcode pass pwd secret secrets token key apikey bearer authorization auth credential credentials cred login pin signature private".split())
_COPULA = frozenset("is was are ist war est es lautet".split())
_SIGNS = ":=\"'-/.@,_&+#!?()<>|~$%*"
LABELS = 3  # outside, begin, inside

#: A sequence: where its tokens stand, and the features that hold of each.
Sequence = tuple[list[tuple[int, int]], list[list[int]]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds, leftmost and not overlapping in a kind, in order of start and kind."""
    out = []
    if _KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def base_values(text: str) -> list[tuple[int, int]]:
    """What is secret in the fixed kinds: of an assignment its value, of the others all."""
    out = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8} if _KEYWORD.search(text) else set()
    return sorted(out | {(a, b) for kind, a, b in base_spans(text) if kind != "assign"})


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def entropy(s: str) -> float:
    return math.log2(len(s)) - sum([c * math.log2(c) for c in map(s.count, set(s)) if c > 1]) / len(s)


class _Names(dict):
    """Numbers of features, given as they are first asked for; a fixed vocabulary after ``_vocabulary``."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]


def _bucket(n: float, *edges: float) -> int:
    return bisect_right(edges, n)


@lru_cache(1 << 14)
def _kind(token: str) -> str:
    if not token[0].isalnum():
        return "sign"
    if token.isdigit():
        return "digits"
    if not token.isascii():
        return "other"
    if any(map(str.isdigit, token)):
        return "hexlike" if re.fullmatch("[0-9a-f]{8,}", token) else "letters and digits"
    return "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"


@lru_cache(1 << 14)
def _shape(token: str) -> tuple[str, ...]:
    kind = _kind(token)
    if kind == "sign":
        return ("kind:sign", f"sign:{token if token in _SIGNS else 'other'}")
    return (f"kind:{kind}", f"{kind} length:{_bucket(len(token), 3, 5, 8, 12, 20, 32)}", f"token entropy:{_bucket(entropy(token), 2, 2.75, 3.25, 3.75, 4.25)}") + (("cue itself",) if token.lower() in _CUES else ())


@lru_cache(1 << 14)
def _run_shape(run: str) -> tuple[str, ...]:
    """Features of a stretch without white space, quotes and brackets."""
    n = len(run)
    digits, lower, upper = any(map(str.isdigit, run)), re.search("[a-z]", run) is not None, re.search("[A-Z]", run) is not None
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "-" for c in run]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    parts = _PIECES.findall(run)
    worded = all(map(_WORD_PIECE.fullmatch, parts))
    out = [f"run length:{_bucket(n, 4, 8, 12, 16, 24, 36)}", f"run entropy:{_bucket(entropy(run), 2, 2.6, 3.1, 3.6, 4.1)}", f"run turns:{_bucket(turns, 0.08, 0.2, 0.4)}", f"run worded:{worded} {len(parts) > 1}"]
    for name, holds in (
        ("run digits and letters", digits and (lower or upper)), ("run three cases", digits and lower and upper), ("run inner case", re.search(r"[a-z][A-Z]", run)), ("run number", not (lower or upper)),
        ("run mail", re.fullmatch(r"[^@]+@[^@]+\.[A-Za-z.]+", run)), ("run host or path", "/" in run and worded), ("run prefix", run.startswith(_PREFIXES)), ("run consonants", _CONSONANTS.search(run)),
        ("run hex", n >= 16 and re.fullmatch("[0-9a-fA-F-]+", run)), ("run date", re.fullmatch(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\S*", run)), ("run signs", re.search(r"[+!$%^&*#~]", run)), ("run repeats", len(set(run)) * 3 < n), ("run caps", upper and not lower),
    ):
        if holds:
            out.append(name)
    return tuple(out)


def windows(text: str) -> list[tuple[int, int]]:
    """The stretches of a sampled ``text`` that are learned from (all lines are tagged): lines around anchors, at most AROUND characters to each side and up to white space."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.end() + AROUND <= out[-1][1]:
            continue
        line = text.rfind("\n", 0, m.start()) + 1
        a = max(line, m.start() - AROUND)
        while a > line and not text[a - 1].isspace():
            a -= 1
        b = m.end() + AROUND
        at = text.find("\n", m.end(), b)
        if at >= 0:
            b = at
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def lines(text: str) -> Iterator[tuple[int, int]]:
    """Where the lines of a text stand, blank ones left out."""
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            yield at, at + len(line)
        at += len(line) + 1


#: What is asked of a whole text: whether it reads as code, and whether it names a secret.
File = tuple[bool, bool]


def file_of(text: str) -> File:
    return sum(map(text.count, "={};")) * 100 > len(text), _KEYWORD.search(text) is not None


def sequences(text: str, names: dict[str, int], stretches: Iterable[tuple[int, int]] | None = None, about: File | None = None) -> Iterator[Sequence]:
    """The token sequences of a text, one a line (or of the ``stretches`` given); features without a number in ``names`` are left out."""
    code, cued = about or file_of(text)
    file = [f"file code:{code}", f"file cue:{cued}"]
    for begin, end in lines(text) if stretches is None else stretches:
        part = text[begin:end]
        spans = [m.span() for m in _TOKEN.finditer(part)]
        tokens = [part[a:b] for a, b in spans]
        kinds = [_kind(t) for t in tokens]
        run_of: dict[int, tuple[int, int, tuple[str, ...]]] = {}
        for m in _RUN.finditer(part):
            shape = _run_shape(m[0])
            for k in range(bisect_left(spans, (m.start(), 0)), bisect_left(spans, (m.end(), 0))):
                run_of[k] = *m.span(), shape
        out, words = [], []  # words: how far back each cue stands
        double = single = 0  # quotes so far
        for k, (a, b) in enumerate(spans):
            t, kind = tokens[k], kinds[k]
            f = [*file, "bias", *_shape(t)]
            near = [i for i, w in enumerate(reversed(words[-5:])) if w in _CUES]
            cue = f"cue:{near[0] if near else 'none'}"
            back = k - 1
            while back >= 0 and tokens[back] in "\"'`":
                back -= 1
            sign = "start" if back < 0 else ":=" if tokens[back] in ":=" or tokens[back] == ">" and back and tokens[back - 1] in "=-" else "copula" if tokens[back].lower() in _COPULA else "other"
            f += [cue, f"after {sign}", f"{cue} after {sign}", f"glued {k > 0 and spans[k - 1][1] == a} {kind}", f"last {kinds[k - 1] if k else 'none'} {kind}", f"next {kinds[k + 1] if k + 1 < len(spans) else 'none'} glued {k + 1 < len(spans) and spans[k + 1][0] == b}"]
            if k in run_of:
                x, y, shape = run_of[k]
                first = "first" if x == a else "later"
                quoted = x > 0 and part[x - 1] in "\"'`" and y < len(part) and part[y] == part[x - 1]
                f += shape
                f += [f"{first} quoted:{quoted}", f"{first} {shape[0]}", f"{first} {shape[1]}", f"{first} after {sign}", f"{kind} {shape[3]}", f"{cue} {shape[0]}", f"{cue} {shape[3]}", f"after {sign} {shape[3]} {kind}"]
                if "://" in part[max(0, x - 90) : x] and not any(c.isspace() for c in part[part.rfind("://", 0, x) : x]):
                    f.append(f"in url, user:{'@' in part[x:y] and part[x - 1] == ':' and part.find('@', x) > a} {first}")
            if k and tokens[k - 1] in "\"'`" or k + 1 < len(tokens) and tokens[k + 1] in "\"'`":
                f.append(f"at quote {kind}")
            if near and near[0] <= 4 and double % 2 + single % 2:
                f.append(f"in quotes after cue {kind}")
            double, single = double + (t == '"'), single + (t == "'")
            out.append([names[x] for x in dict.fromkeys(f) if isinstance(names, _Names) or x in names])
            if kind != "sign":
                words.append(t.lower())
        yield [(a + begin, b + begin) for a, b in spans], out


@dataclass
class Field:
    """Numbers of features, weights of features by label, and of each label after another (row LABELS: at the start of a sequence)."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: list[list[int]]) -> list[int]:
        """The best labels of one sequence of tokens, given by their features."""
        score, back = None, []
        for f in x:
            e = self.emit[f].sum(0)
            if score is None:
                score = self.move[LABELS] + e
            else:
                ways = score[:, None] + self.move[:LABELS]
                back.append(ways.argmax(0))
                score = ways.max(0) + e
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def spans(self, text: str, outside: Outside | None = None) -> list[tuple[int, int]]:
        """The secrets of a text, from the best labels of each of its lines; not worked out where ``outside`` knows them to be outside."""
        out: list[tuple[int, int]] = []
        about = file_of(text)
        some = lines(text) if outside is None else [x for x in lines(text) if not outside.sure(text[slice(*x)], about)]
        for at, x in sequences(text, self.names, some, about):
            if at:
                for (a, b), label in zip(at, self.viterbi(x), strict=True):
                    if label == 1:
                        out.append((a, b))
                    elif label == 2:
                        out[-1] = (out[-1][0], b)
        return out


_CONTEXT = {"lower": "zu", "title": "Zu", "upper": "ZU", "mixed": "zUz", "digits": "00", "letters and digits": "z0", "hexlike": "00000000a", "other": "é"}
_NEVER = -math.inf


_SIMPLE = re.compile(r"([A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]{1,14})([.,;:!?#*$%&|<>]{0,4})")


class _Words(dict):
    """What ``Outside.word`` tells of each word, asked once."""

    def __init__(self, outside: Outside, about: File) -> None:
        self.outside, self.about = outside, about

    def __missing__(self, word: str) -> tuple[str, dict] | None:
        self[word] = found = self.outside.word(word, self.about)
        return found


class Outside:
    """Tells lines whose best labels are all outside, as ``Field.viterbi`` would find, from what their words have in common.

    What a word (a stretch without white space) gains by a label over outside depends on its form, the
    shapes of its tokens and runs and its signs, and on the kinds of the tokens next to it, as long as
    no cue stands in the line. So the best that a secret can gain that lies in it, goes on into it,
    begins in it, or goes all through it is worked out once a form and neighbours, by the features of
    ``sequences`` and with the most that any step from label to label gives. A line where no secret
    gains anything has none. Of a line with a cue, a URL or a word over LONG nothing is said.
    """

    LONG, KNOWN, FORMS = 64, 1 << 17, 1 << 14

    def __init__(self, field: Field) -> None:
        self.field = field
        m = field.move
        self.begin = float(max(m[LABELS, 1] - m[LABELS, 0], (m[:LABELS, 1] - m[0, 0]).max()))
        self.inside = float((m[1:LABELS, 2] - m[0, 0]).max())
        self.end = float(max(0.0, (m[1:LABELS, 0] - m[0, 0]).max()))
        self.words: dict[File, _Words] = {}
        self.forms: dict[tuple, dict] = {}
        self.simple: dict[tuple, dict] = {}

    def sure(self, line: str, about: File) -> bool:
        """Whether the field labels all tokens of a line outside; False if that is not known."""
        known = self.words.get(about)
        if known is None or len(known) > self.KNOWN:
            known = self.words[about] = _Words(self, about)
        if len(self.forms) > self.FORMS or len(self.simple) > self.KNOWN:
            self.forms.clear()
            self.simple.clear()
        words = line.split()
        found = [known[w] for w in words]
        if None in found:
            return False
        before, run = "", _NEVER
        for word, (_, table), (after, _) in zip(words, found, [*found[1:], ("", None)], strict=True):
            gains = table.get((before, after))
            if gains is None:
                gains = table[before, after] = self._gains(before, word, after, about)
            whole, ends, begins, through, before = gains
            if whole > 0 or run + ends > 0:
                return False
            run = max(run + through, begins)
        return True

    def word(self, word: str, about: File) -> tuple[str, dict] | None:
        """The kind of a word's first token, for the word before it, and the gains of its form by neighbours."""
        if m := _SIMPLE.fullmatch(word):  # how often its letters stand in it tells its lengths and entropies
            core, signs = m.groups()
            low = core.lower()
            if low in _CUES:
                return None
            key = (about, core != low, signs, low in _COPULA, _CONSONANTS.search(low) is not None, *sorted(map(core.count, set(core))))
            if not core.isascii():
                parts = _PIECES.findall(core)
                key += (all(map(_WORD_PIECE.fullmatch, parts)), len(parts) > 1, "A" <= core[0] <= "Z", re.search("[a-z]", core) is not None)
            table = self.simple.get(key)
            if table is None:
                table = self.simple[key] = self._table(_TOKEN.findall(word), word, about)
            return _CONTEXT["other"] if not core.isascii() else "Zu" if core != low else "zu", table
        if len(word) > self.LONG or "://" in word:
            return None
        tokens = _TOKEN.findall(word)
        if not _CUES.isdisjoint(t.lower() for t in tokens):
            return None
        first = tokens[0]
        return ("'" if first in "\"'`" else "#") if not first[0].isalnum() else _CONTEXT[_kind(first)], self._table(tokens, word, about)

    def _table(self, tokens: list[str], word: str, about: File) -> dict:
        """The gains of a word's form, by neighbours."""
        signs = tuple(t if not t[0].isalnum() else "is" if t.lower() in _COPULA else "a" for t in tokens)
        form = (about, signs, tuple(map(_shape, tokens)), tuple(map(_run_shape, _RUN.findall(word))))
        return self.forms.setdefault(form, {})

    def _gains(self, before: str, word: str, after: str, about: File) -> tuple[float, float, float, float, str]:
        """What a secret gains at most that lies in the word, goes on into it and ends there, begins in
        it and goes on, or goes through it; and what stands for the line up to here, for the next word."""
        (_, x), *_ = sequences(f"{before} {word} {after}", self.field.names, [(0, len(before) + len(word) + len(after) + 2)], about)
        skip, n = len(_TOKEN.findall(before)), len(_TOKEN.findall(word))
        whole = ends = begins = _NEVER
        through = 0.0
        for f in x[skip : skip + n]:
            e = self.field.emit[f].sum(0)
            begin, go = self.begin + float(e[1] - e[0]), self.inside + float(e[2] - e[0])
            through += go
            begins = max(begins + go, begin)
            ends = max(ends, through)
            whole = max(whole, begins)
        room = 1e-6 + self.end  # for sums in another order
        tokens = _TOKEN.findall(f"{before} {word}")
        quoted = tokens[-1] in "\"'`"
        while tokens and tokens[-1] in "\"'`":
            tokens.pop()
        last = tokens[-1] if tokens else ""
        if last[:1].isalnum():
            last = "ist" if last.lower() in _COPULA else _CONTEXT[_kind(last)]
        elif last == ">" and tokens[-2:-1] in (["="], ["-"]):
            last = "=>"
        elif last and last not in ":=->":
            last = "#"
        return whole + room, ends + room, begins, through, f"{last} '" if quoted else last


#: Features of each token, a label for each, and how often the sequence counts.
Labelled = tuple[list[list[int]], list[int], float]


def learn(rows: list[Labelled], names: dict[str, int], steps: int = STEPS, penalty: float = 2e-4) -> Field:
    """Weights of the highest penalised likelihood, by Adam on forward-backward gradients."""
    emit, move = np.zeros((len(names) + 1, LABELS)), np.zeros((LABELS + 1, LABELS))  # the last row: no feature
    never = np.zeros_like(move)
    never[0, 2] = never[LABELS, 2] = -1e9  # inside only after begin or inside
    if not rows:
        emit[names["bias"], 0] = 1.0
        return Field(dict(names), emit, move + never)
    none, total = len(names), sum(w for *_, w in rows)
    by_length: dict[int, list[Labelled]] = defaultdict(list)
    for r in rows:
        by_length[(len(r[1]) - 1).bit_length()].append(r)
    parts = []  # sequences of about the same length together
    for group in by_length.values():
        n, longest, most = len(group), max(len(y) for _, y, _ in group), max(len(f) for x, _, _ in group for f in x)
        x, y, live = np.full((n, longest, most), none), np.zeros((n, longest), int), np.zeros((n, longest))
        for i, (fs, labels, weight) in enumerate(group):
            for t, f in enumerate(fs):
                x[i, t, : len(f)] = f
            y[i, : len(labels)] = labels
            live[i, : len(labels)] = weight / total
        parts.append((x, y, live))

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    def add(into: np.ndarray, x: np.ndarray, p: np.ndarray) -> None:
        flat = x.reshape(-1)
        for k in range(LABELS):
            into[:, k] += np.bincount(flat, np.repeat(p[..., k].reshape(-1), x.shape[-1]), none + 1)

    first, second = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    seen = [np.zeros_like(emit), np.zeros_like(move)]
    for x, y, live in parts:
        onehot = np.eye(LABELS)[y] * live[..., None]
        add(seen[0], x, onehot)
        seen[1][LABELS] += onehot[:, 0].sum(0)
        for t in range(1, y.shape[1]):
            seen[1][:LABELS] += np.einsum("na,nb->ab", np.eye(LABELS)[y[:, t - 1]], onehot[:, t])
    for step in range(1, steps + 1):
        want = [np.zeros_like(emit), np.zeros_like(move)]
        m = move + never
        for x, _, live in parts:
            n, longest, _ = x.shape
            on = live > 0
            e = emit[x].sum(2)
            ahead = [m[LABELS] + e[:, 0]]
            for t in range(1, longest):
                to = lse(ahead[-1][:, :, None] + m[None, :LABELS], 1) + e[:, t]
                ahead.append(np.where(on[:, t, None], to, ahead[-1]))
            whole = lse(ahead[-1], 1)
            behind, p = np.zeros((n, LABELS)), np.zeros((n, longest, LABELS))
            for t in reversed(range(longest)):
                p[:, t] = np.exp(ahead[t] + behind - whole[:, None]) * live[:, t, None]
                if t:
                    pair = np.exp(ahead[t - 1][:, :, None] + m[None, :LABELS] + (e[:, t] + behind)[:, None] - whole[:, None, None]) * live[:, t, None, None]
                    want[1][:LABELS] += pair.sum(0)
                    back = lse(m[None, :LABELS] + (e[:, t] + behind)[:, None], 2)
                    behind = np.where(on[:, t, None], back, behind)
            want[1][LABELS] += p[:, 0].sum(0)
            add(want[0], x, p)
        for k, w in enumerate((emit, move)):
            g = seen[k] - want[k] - penalty * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
        emit[none] = 0
    return Field(dict(names), emit, move + never)


def labelled(text: str, secrets: list[tuple[int, int]], names: dict[str, int], stretches: Iterable[tuple[int, int]] | None = None) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Each sequence of a text with its labels: begin at the first token in a secret, inside after it."""
    for at, x in sequences(text, names, stretches):
        labels, inside = [], None
        for a, b in at:
            hit = next((k for k, (s, e) in enumerate(secrets) if a < e and s < b), None)
            labels.append(0 if hit is None else 2 if hit == inside else 1)
            inside = hit
        if labels:
            yield x, labels


def generated(count: int = GENERATED, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets of many makes, and lines with numbers, dates, ids, code and cues that hold none."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def pick(chars: str, a: int, b: int | None = None) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))

    def word() -> str:
        """A word of syllables, as prose has them."""
        return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "t")) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice((word(), word(), word().capitalize(), rng.choice(("the", "of", "and", "to", "in", "is", "a")))) for _ in range(rng.randint(a, b)))

    def strong() -> str:
        """Characters without sense: letters with digits or without, of both cases or one, in pieces or whole."""
        chars = rng.choice((lower + upper + digits, lower + upper + digits, lower + upper, lower + digits, upper + digits))
        s = pick(chars, 16, 44)
        for _ in range(rng.choice((0, 0, 0, 1, 2, 3))):
            at = rng.randrange(1, len(s))
            s = s[:at] + rng.choice("-_./+~") + s[at:]
        return s

    def chosen() -> str:
        """A password as people make them."""
        w = word() + word()
        return rng.choice((
            w.capitalize() + pick("!$%&*#@", 1) + pick(digits, 1, 4), w[:3] + pick(digits, 1) + w[3:] + pick("!$%&*#", 1) + pick(digits, 1, 2), w + word(), pick(lower + upper, 9, 16), w + pick(digits, 2, 4),
            w.replace("o", "0").replace("e", "3") + pick("&!#", 1) + pick(digits, 1), pick(lower + digits, 8, 14),
        ))

    def phrase() -> str:
        return " ".join(word() for _ in range(rng.randint(3, 5)))

    token = [
        lambda: rng.choice(("ghp_", "gho_", "npm_", "glpat-", "sk_live_", "sk_test_", "sk-", "pk_live_", "AIza", "xoxb-")) + pick(rng.choice((lower + upper + digits, lower + upper, lower)), 18, 38),
        lambda: pick(lower + upper + digits + "+/", 30, 60) + rng.choice(("", "=", "==")),
        lambda: "eyJ" + pick(lower + upper + digits, 14, 40) + ".eyJ" + pick(lower + upper + digits, 20, 60) + "." + pick(lower + upper + digits + "-_", 30, 44),
        lambda: pick("0123456789abcdef", 32, 64), lambda: "AKIA" + pick(upper + digits, 16), strong, strong,
    ]
    clean = [
        lambda: pick(digits, 8, 16), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{pick(digits, 2)}:00Z", lambda: f"{word()}{pick(digits, 1, 4)}{word()}", lambda: f"{word()}-{pick(digits, 1, 3)}-{word()}",
        lambda: f"{word()}_{word()}_{pick(digits, 1, 3)}", lambda: f"{word().capitalize()}{pick(digits, 2, 4)}", lambda: f"{rng.choice(('DE', 'FR', 'ES', 'GB'))}{pick(digits, 18, 22)}", lambda: f"{word()}/{word()}/{pick(digits, 2, 6)}.html",
        lambda: f"{word()}.{pick(digits, 2)}@{word()}{pick(digits, 1)}.example.com", lambda: f"{word().capitalize()}{word().capitalize()}", lambda: f"{word()}{word().capitalize()}{word().capitalize()}()", lambda: f"v{pick(digits, 1)}.{pick(digits, 1, 2)}.{pick(digits, 1)}rc1",
        lambda: f"{pick(digits, 1, 3)}{rng.choice(('px', 'km', 'MB', 'th', 'kg', 'ms'))}", lambda: f"{word()}{word().capitalize()}.{word()}()", lambda: f"https://{word()}.example.org/{word()}/{pick(lower + digits, 6)}", lambda: f"{pick(upper, 2, 4)}-{pick(digits, 2, 5)}",
    ]
    cues = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "auth_token", "credential", "secret_key", "secret_access_key", "passphrase", "key", "pass", "login", "signing_key")

    def cue() -> str:
        name = rng.choice(("", "", "", "db_", "my_", f"{word()}_")) + rng.choice(cues)
        return rng.choice((name, name, name.upper(), name.title()))

    told = ("{}={}", "{}: {}", "{} = {}", '{}="{}"', "{} = '{}'", '"{}": "{}"', "export {}={}", "{}:{}", "{} => '{}'", "--{}={}", "the {} is {}", "my {} is {} ,")
    alone = ("{}", '"{}"', "Authorization: Bearer {}", "bearer {}", "use {} to sign in", "key {}", "?auth={}", "Authorization: Basic {}", "curl -H 'X-Auth: {}'")
    plain = ("{}", "{}", '"{}"', "({})", "id: {}", "no. {}", "ref={}", "tel {}", "see {}", "{},", "name = {}", "mail: {}", "{}.", "version={}")
    harmless = (
        "the key to the {} is {}", "a token of {} and {}", "password: required", "password is too short", "secret: none", "token = null", "the secret of {} was {}", "key: {}", "login is at {} {}", "pin the {} to {}", "pass: true", "the password was changed by {}", "enter your password: ",
        "credentials are kept by the {}", "api key is missing", "secret = os.environ", "token: {}", "keyboard {} {}", "token is {}",
    )
    for _ in range(count):
        left, right = words(0, 8), words(0, 6)
        draw, secret = rng.random(), ""
        if draw < 0.25:
            secret = rng.choice((chosen, chosen, chosen, strong, rng.choice(token)))()
            name, form = cue(), rng.choice(told)
            line = form.replace("{}", name, 1)
        elif draw < 0.32:
            secret, line = phrase(), rng.choice(("passphrase", "password", "pass_phrase", "login password", cue())) + rng.choice((': "{}"', ' = "{}"', ": '{}'", '="{}"'))
        elif draw < 0.38:
            secret, line = rng.choice((chosen, strong))(), rng.choice(("https://{u}:{}@{h}.example", "postgres://{u}:{}@{h}/db", "ftp://{u}:{}@{h}.example/x")).replace("{u}", word()).replace("{h}", word())
            secret = re.sub(r"[/#@]", "", secret)
        elif draw < 0.55:
            secret, line = rng.choice(token)(), rng.choice(alone)
        elif draw < 0.85:
            line = rng.choice(plain).replace("{}", rng.choice(clean)())
        else:
            line = rng.choice(harmless)
            while "{}" in line:
                line = line.replace("{}", word(), 1)
        at = line.find("{}") if secret else -1
        text = " ".join(x for x in (left, line.replace("{}", secret) if secret else line, right) if x)
        at += len(left) + bool(left)
        yield text, [(at, at + len(secret))] if secret else []


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_sequences: int = SAMPLE_SEQUENCES) -> Field:
    """A field learned from generated lines and from ``windows`` of a sample of ``documents``.

    The sample is bounded and repeatable: about ``sample_documents`` documents, whose text has a
    small hash, and ``sample_sequences`` of their sequences, in pieces of PIECE_TOKENS. There the
    values of base spans are secrets and nothing else is, so sequences with a cue that no base span
    answers tell nothing and are left out. All of them together weigh as much as the generated lines.
    """
    names = _Names()
    rows = [(x, y, 1.0) for t, s in generated() for x, y in labelled(t, s, names)]
    known = dict(names)
    share = min(1.0, sample_documents / max(documents.count(), 1))
    some = documents.select("text").where(F.col("text").isNotNull() & hashed_share(F.xxhash64("text"), share)).distinct()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: Counter = Counter()
        for t in batch.column(0):
            text = t.as_py()
            for x, y in labelled(text, base_values(text), known, windows(text)):
                if any(y) or not any(known["cue itself"] in f for f in x):
                    for k in range(0, len(y), PIECE_TOKENS):
                        part = y[k : k + PIECE_TOKENS]
                        out[tuple(map(tuple, x[k : k + PIECE_TOKENS])), (min(part[0], 1), *part[1:])] += 1
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.list_(pa.list_(pa.int32()))), pa.array([y for _, y in out], pa.list_(pa.int32())), pa.array(list(out.values()), pa.int64())], ["x", "y", "n"])

    found = map_batches(some, each, "x array<array<int>>, y array<int>, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.xxhash64("x", "y"), "y", "x").limit(sample_sequences).collect()
    scale = len(rows) / max(sum(r.n for r in found), 1)
    return learn(rows + [([list(f) for f in r.x], list(r.y), r.n * scale) for r in found], known)


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, by start and kind) of every row.

    Base spans are those of the fixed kinds; spans of kind ``crf`` are added where the field finds
    a secret that overlaps none of them. Null and empty texts have no spans; a very long text costs
    time in proportion. Null ids and repeated rows stay as rows; other columns are not looked at; no
    rows, no result.
    """

    def spans(text: str | None, outside: Outside) -> list[tuple[str, int, int]]:
        if not text:
            return []
        found = base_spans(text)
        ends = list(accumulate((e for _, _, e in found), max))  # by start, the furthest end so far
        starts = [s for _, s, _ in found]
        extra = [("crf", a, b) for a, b in field.spans(text, outside) if not ((k := bisect_left(starts, b)) and ends[k - 1] > a)]
        return sorted(found + extra, key=_order)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    known: list[Outside] = []  # one a task

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not known:
            known.append(Outside(field))
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py(), known[0])] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = scan(documents, fit(documents))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
