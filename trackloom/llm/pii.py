"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds what they miss.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns over whole texts. The model
looks at windows of tokens (letter-digit runs and single marks) around digits, at-signs and their spelled-out forms.
Every run of at most ``MAX_TOKENS`` tokens that could be an entity is a candidate segment with features of the whole
span (digits, groups, separators, check digit, edges, words before); anything else is one-token background. A
segmentation's score is the sum of its segments' scores for their types and of a weight for each pair of neighbouring
types; dynamic programming over positions and types finds the best one, so boundaries and types are chosen jointly.
Segments that overlap a base span are not candidates: base spans stay as they are, and the model's come beside them.

The weights are fitted by conditional likelihood on the driver, over a bounded sample (``SAMPLE_DOCS`` documents with the
smallest hashes of their ids, ``TRAIN_WINDOWS`` windows): windows as the base labels them, the same with its spans
rewritten into forms that it doesn't know, and look-alikes as negatives. Everything else covers all rows.

Defined results: a null or empty text has no spans; a null ``doc_id`` is kept; repeated rows each get a row; an empty
table gives an empty result (templates stand in for the sample); other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, TRAIN_WINDOWS, MAX_TOKENS = 4000, 240, 18
#: Candidates that are scored at a time.
BLOCK = 40_000
Span = tuple[int, int, str]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base's spans by start, then kind. Each kind is searched leftmost and without overlap in time linear in the text."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        # local parts hold no at-sign, so the leftmost match has the first at-sign with a local part and a domain
        start = at
        while start > floor and not LOCAL_END.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := DIGITS_ONLY.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS_ONLY.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


DIGITS_ONLY = re.compile(r"[^0-9]")


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2]), s[1]


# ---- the model

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
ANCHOR = re.compile(r"[0-9]|@|[\[(]\s?(?:at|AT)\s?[\])]|\b(?:at|AT)\s+[A-Za-z0-9-]+\s+(?:dot|DOT)\b")
AT_WORD, DOT_WORD = re.compile(r"(?i)[\[(]\s?at\s?[\])]|\sat\s"), re.compile(r"(?i)[\[(]\s?dot\s?[\])]|\sdot\s")
HINTS = {"mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "pay": 2, "tel": 3, "phone": 3, "call": 3, "mobile": 3, "fax": 3}
NAMES = [
    "bias", "at", "at_word", "dots_after_at", "dot_words", "no_letters", "letters", "plus", "opens", "plus_inside", "luhn", "ip_parts", "ip_range", "hex", "edge_mark", "glued_left", "glued_right",
    *(f"digits_{k}" for k in ("0", "1", "4", "7", "9", "12", "16", "17", "20")), *(f"groups_{k}" for k in range(1, 6)), *(f"sep_{k}" for k in ("space", "dash", "dot", "slash", "mixed", "none")), *(f"hint_{k}" for k in KINDS), *(f"tokens_{k}" for k in ("1", "2", "5", "8")),
    "one_space_email", "date_like", "luhn_and_length", "phone_like", "long_digits_fail", "continues", "continued", "local_words", "ends_in_dot", "ends_after_dot",
]
CONTINUES = re.compile(r"(?i)\s?[\[(]\s?(?:dot|at)\s?[\])]|\s(?:dot|at)\s[a-z0-9-]+(?:$|\s(?:dot)\s|[^\w\s])|[.@-][a-z0-9]")
CONTINUED = re.compile(r"(?i)(?:[\[(]\s?(?:dot|at)\s?[\])]\s?|\s(?:dot)\s|[a-z0-9][.@-])$")
ENDS_IN, ENDS_AFTER = re.compile(r"(?i)[\s\[(](?:dot|at)$"), re.compile(r"(?i)(?:\.|\sdot\s|[\[(]\s?dot\s?[\])]\s?)[a-z0-9-]+$")
AT = {n: k for k, n in enumerate(NAMES)}
AT_AHEAD, WORDS = re.compile(rf"(?=({AT_WORD.pattern.replace('(?i)', '(?i:')})))"), re.compile("[a-z]+")


def features(text: str, start: int, end: int, tokens: int) -> list[int]:
    """Indices of the span features that hold."""
    s = text[start:end]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    n, letters = len(digits), re.search("[A-Za-z]", s) is not None
    f = ["bias", "letters" if letters else "no_letters"]
    at = s.find("@") if "@" in s else -1
    word_at, word_dot = AT_WORD.search(s), DOT_WORD.search(s)
    f += ["at"] * (s.count("@") == 1) + ["dots_after_at"] * (at > 0 and "." in s[at:] and " " not in s) + ["at_word"] * (word_at is not None) + ["dot_words"] * (word_at is not None and word_dot is not None and word_dot.start() > word_at.start())
    f += ["one_space_email"] * ((at > 0 or word_at is not None) and s.count(" ") > 8)
    f += ["plus"] * (s[0] == "+") + ["opens"] * (s[0] == "(") + ["plus_inside"] * ("+" in s[1:]) + ["edge_mark"] * (not s[0].isalnum() and s[0] not in "+(" or not s[-1].isalnum())
    f += ["glued_left"] * (start > 0 and text[start - 1].isalnum()) + ["glued_right"] * (end < len(text) and text[end].isalnum())
    f += ["continues"] * (CONTINUES.match(text, end) is not None) + ["continued"] * (CONTINUED.search(text, max(0, start - 8), start) is not None)
    f += ["local_words"] * (word_at is not None and " " in s[: word_at.start()].strip())
    f += ["ends_in_dot"] * (ENDS_IN.search(s) is not None) + ["ends_after_dot"] * (word_at is not None and ENDS_AFTER.search(s) is not None)
    parts = s.split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    f += ["ip_parts"] * ip + ["ip_range"] * (ip and all(len(p) <= 3 and int(p) <= 255 for p in parts))
    check = n >= 12 and not letters and luhn(digits)
    seps = set(re.sub("[A-Za-z0-9+()]", "", s))
    f += ["luhn"] * check + ["luhn_and_length"] * (check and n <= 19 and len(groups) <= 5) + ["long_digits_fail"] * (n >= 12 and not check) + ["hex"] * (letters and n >= 4 and re.fullmatch("[0-9a-fA-F]+", s) is not None)
    f += ["phone_like"] * (not letters and 9 <= n <= 15 and len(groups) >= 3 and (s[0] in "+(" or len(groups[-1]) == 4 and len(groups[-2]) == 3))
    f += ["date_like"] * (not letters and 6 <= n <= 8 and len(groups) == 3)
    f.append("digits_" + next(k for k, top in (("0", 0), ("1", 3), ("4", 6), ("7", 8), ("9", 11), ("12", 15), ("16", 16), ("17", 19), ("20", 1 << 30)) if n <= top))
    f.append(f"groups_{min(5, max(1, len(groups)))}")
    f.append("sep_" + ("none" if not seps else {" ": "space", "-": "dash", ".": "dot", "/": "slash"}.get(next(iter(seps)), "mixed") if len(seps) == 1 else "mixed"))
    for w in re.findall("[a-z]+", text[max(0, start - 24) : start].lower())[-2:]:
        if w in HINTS:
            f.append(f"hint_{KINDS[HINTS[w]]}")
    f.append("tokens_" + ("1" if tokens == 1 else "2" if tokens < 5 else "5" if tokens < 8 else "8"))
    return [AT[x] for x in f]


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each stretch of near anchors, with context on both sides."""
    anchors = [m.start() for m in ANCHOR.finditer(text)]
    if not anchors:
        return
    k = 0
    while k < len(anchors):
        first = last = anchors[k]
        while k + 1 < len(anchors) and anchors[k + 1] - last <= 40:
            k += 1
            last = anchors[k]
        k += 1
        lo = max(0, first - 60)
        hi = min(len(text), last + 90)
        tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        a = bisect.bisect_right(tokens, (first, 1 << 60)) - 1
        b = bisect.bisect_right(tokens, (last, 1 << 60))
        yield tokens[max(0, a - 8) : b + MAX_TOKENS]


def covered(fixed: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that ``fixed`` spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for b, e, _ in sorted(fixed):
        if starts and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(b)
            ends.append(e)
    return starts, ends


def candidates(text: str, tokens: list[tuple[int, int]], fixed: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): tokens i to j - 1 may be an entity: gaps of at most three blanks on one line, a digit or an at inside, at most
    one at, plain edges, clear of the ``covered`` stretches."""
    m = len(tokens)
    ts, te = np.array(tokens, np.int64).reshape(m, 2).T
    words = [text[s:e] for s, e in tokens]
    is_at = np.array([w == "@" or (len(w) == 2 and w.lower() == "at") for w in words], bool)
    digit = np.array([DIGIT.search(w) is not None for w in words], bool)
    plain = np.array([w.isalnum() for w in words], bool)
    first = np.array([w[0].isalnum() or w[0] in "+(" for w in words], bool)
    near = np.ones(m, bool)
    near[1:] = [a + 3 >= s and "\n" not in text[a:s] for (_, a), (s, _) in zip(tokens, tokens[1:])]
    starts, ends = fixed
    k = np.searchsorted(ends, ts, side="right") if ends else np.zeros(m, int)
    free = np.array([i >= len(starts) or starts[i] >= e for i, e in zip(k, te)], bool)
    at_sum, digit_sum = np.concatenate([[0], np.cumsum(is_at)]), np.concatenate([[0], np.cumsum(digit)])
    i, out_i, out_j = np.flatnonzero(free & first), [], []
    for d in range(1, MAX_TOKENS + 1):
        i = i[i + d <= m]
        j = i + d
        i = i[free[j - 1] & (near[j - 1] | (d == 1)) & (at_sum[j] - at_sum[i] <= 1)]
        j = i + d
        ok = plain[j - 1] & ((digit_sum[j] > digit_sum[i]) | (at_sum[j] > at_sum[i]))
        out_i.append(i[ok])
        out_j.append(j[ok])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    order = np.lexsort((j, i))
    return i[order], j[order]


class Scorer:
    """Scores of many candidates of one window at once: what ``features`` holds of a span, from running sums over characters.

    Spans with an at in them go through ``features`` itself; there are few, as a candidate holds one at most.
    """

    TOPS = np.array([0, 3, 6, 8, 11, 15, 16, 19])
    BUCKETS = ("0", "1", "4", "7", "9", "12", "16", "17", "20")

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.lo = text, tokens[0][0]
        part = text[self.lo : tokens[-1][1]]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        digit, letter = (c >= 48) & (c <= 57), ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
        self.digits, self.letters, self.hexes = sums(digit), sums(letter), sums(digit | letter & ((c | 32) <= 102))
        self.groups = sums(digit & ~np.concatenate([[False], digit[:-1]]))
        marks = {k: c == v for k, v in (("plus", 43), ("space", 32), ("dash", 45), ("dot", 46), ("slash", 47), ("at", 64))}
        paren = (c == 40) | (c == 41)
        self.marks = {k: sums(v) for k, v in marks.items()} | {"paren": sums(paren)}
        self.other = sums(~(digit | letter | paren | marks["plus"] | marks["space"] | marks["dash"] | marks["dot"] | marks["slash"]))
        place = np.arange(len(c))
        self.last_digit = np.maximum.accumulate(np.where(digit, place, -1))
        self.run = place - np.maximum.accumulate(np.where(~digit, place, -1))
        d = c[digit].astype(np.int64) - 48
        twice = np.where(d < 5, 2 * d, 2 * d - 9)
        even = np.arange(len(d)) % 2 == 0
        self.luhn = sums(np.where(even, d, twice)), sums(np.where(even, twice, d))
        at_end = np.full(len(c) + 1, 1 << 60)
        for m in AT_AHEAD.finditer(part):
            at_end[m.start()] = m.end(1)
        self.at_end = np.minimum.accumulate(at_end[::-1])[::-1]
        self.tokens = np.array(tokens, np.int64)
        self.left = self.right = None

    def _edges(self) -> None:
        """What depends on a span's first or last token only."""
        text, n = self.text, len(self.tokens)
        self.left, self.right = {k: np.zeros(n, bool) for k in ("plus", "opens", "glued_left", "continued", *(f"hint_{k}" for k in KINDS))}, {k: np.zeros(n, bool) for k in ("glued_right", "continues", "ends_in_dot")}
        for k, (s, e) in enumerate(self.tokens.tolist()):
            self.left["plus"][k], self.left["opens"][k] = text[s] == "+", text[s] == "("
            self.left["glued_left"][k] = s > 0 and text[s - 1].isalnum()
            self.left["continued"][k] = CONTINUED.search(text, max(0, s - 8), s) is not None
            for w in WORDS.findall(text[max(0, s - 24) : s].lower())[-2:]:
                if w in HINTS:
                    self.left[f"hint_{KINDS[HINTS[w]]}"][k] = True
            self.right["glued_right"][k] = e < len(text) and text[e].isalnum()
            self.right["continues"][k] = CONTINUES.match(text, e) is not None
            self.right["ends_in_dot"][k] = s > 0 and (text[s - 1].isspace() or text[s - 1] in "[(") and text[s:e].lower() in ("dot", "at")

    def scores(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(candidate, kind) for tokens i to j - 1 under the weights ``w``."""
        if self.left is None:
            self._edges()
        a, b = self.tokens[i, 0] - self.lo, self.tokens[j - 1, 1] - self.lo
        out = np.zeros((len(i), len(KINDS)))
        within = lambda x: x[b] - x[a]
        by_at = (within(self.marks["at"]) > 0) | (self.at_end[a] <= b)
        n, groups, letters = within(self.digits), within(self.groups), within(self.letters) > 0
        plus = within(self.marks["plus"])
        seps = np.stack([within(self.marks[k]) > 0 for k in ("space", "dash", "dot", "slash")], axis=1)
        other = within(self.other) > 0
        kinds = seps.sum(axis=1)
        da, db = self.digits[a], self.digits[b]
        total = np.where((db - 1) % 2 == 0, self.luhn[0][db] - self.luhn[0][da], self.luhn[1][db] - self.luhn[1][da])
        check = (n >= 12) & ~letters & (total % 10 == 0)
        p = self.last_digit[b - 1]
        last = np.where(p >= a, np.minimum(self.run[p], p - a + 1), 0)
        q = self.last_digit[np.maximum(p - last, 0)]
        before = np.where((p - last >= a) & (q >= a), np.minimum(self.run[q], q - a + 1), 0)
        ip = ~letters & (plus == 0) & (within(self.marks["paren"]) == 0) & ~other & (kinds == 1) & (within(self.marks["dot"]) == 3) & (groups == 4)
        in_range = np.zeros(len(i), bool)
        for k in np.flatnonzero(ip):
            in_range[k] = all(len(x) <= 3 and int(x) <= 255 for x in self.text[a[k] + self.lo : b[k] + self.lo].split("."))
        holds = {
            "bias": np.ones(len(i), bool), "letters": letters, "no_letters": ~letters, "plus": self.left["plus"][i], "opens": self.left["opens"][i], "plus_inside": plus > self.left["plus"][i],
            "glued_left": self.left["glued_left"][i], "glued_right": self.right["glued_right"][j - 1], "continues": self.right["continues"][j - 1], "continued": self.left["continued"][i],
            "ends_in_dot": self.right["ends_in_dot"][j - 1] & (j - i > 1), "ip_parts": ip, "ip_range": in_range, "luhn": check, "luhn_and_length": check & (n <= 19) & (groups <= 5), "long_digits_fail": (n >= 12) & ~check,
            "hex": letters & (n >= 4) & (within(self.hexes) == b - a), "phone_like": ~letters & (n >= 9) & (n <= 15) & (groups >= 3) & (self.left["plus"][i] | self.left["opens"][i] | (last == 4) & (before == 3)),
            "date_like": ~letters & (n >= 6) & (n <= 8) & (groups == 3), "sep_none": ~other & (kinds == 0), "sep_mixed": other | (kinds > 1), **{f"sep_{k}": ~other & (kinds == 1) & seps[:, x] for x, k in enumerate(("space", "dash", "dot", "slash"))},
            **{f"hint_{k}": self.left[f"hint_{k}"][i] for k in KINDS},
        }
        for name, x in holds.items():
            out[x] += w[:, AT[name]]
        d = j - i
        out += w[:, [AT[f"digits_{k}"] for k in self.BUCKETS]].T[np.searchsorted(self.TOPS, n)]
        out += w[:, [AT[f"groups_{k}"] for k in range(1, 6)]].T[np.clip(groups, 1, 5) - 1]
        out += w[:, [AT[f"tokens_{k}"] for k in ("1", "2", "5", "8")]].T[(d > 1).astype(int) + (d >= 5) + (d >= 8)]
        for k in np.flatnonzero(by_at):
            out[k] = w[:, list(set(features(self.text, int(a[k]) + self.lo, int(b[k]) + self.lo, int(d[k]))))].sum(axis=1)
        return out


class SemiMarkov:
    """Weights over span features and neighbouring types (0 is background), with decoding and fitting."""

    def __init__(self) -> None:
        self.w = np.zeros((len(KINDS), len(NAMES)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _rows(self, text: str, tokens: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = np.zeros((len(i), len(NAMES)))
        for k in range(len(i)):
            x[k, features(text, tokens[i[k]][0], tokens[j[k] - 1][1], int(j[k] - i[k]))] = 1
        return x

    def decode(self, text: str, tokens: list, fixed: list[Span]) -> list[Span]:
        """The entities of the best segmentation of a window's tokens, clear of ``fixed`` spans."""
        return self.decode_clear(text, tokens, covered(fixed))

    def decode_clear(self, text: str, tokens: list, stretches: tuple[list[int], list[int]]) -> list[Span]:
        ci, cj = candidates(text, tokens, stretches)
        if not len(ci):
            return []
        scorer = Scorer(text, tokens)
        score = np.concatenate([scorer.scores(ci[k : k + BLOCK], cj[k : k + BLOCK], self.w) for k in range(0, len(ci), BLOCK)])
        useful = np.flatnonzero(score.max(axis=1) + self.t.max() * 2 > 0)  # a segment that can't beat background is in no best path
        if not len(useful):
            return []
        ci, cj, score = ci[useful], cj[useful], score[useful]
        order = np.argsort(cj, kind="stable")
        ci, cj, score = ci[order], cj[order], score[order]
        m, types = len(tokens), len(KINDS) + 1
        edges = np.searchsorted(cj, np.arange(m + 2))
        best, back = np.full((m + 1, types), -np.inf), {}
        best[0, 0] = 0
        stay, only = float(self.t[0, 0]), True  # only: at j - 1 nothing but background is possible
        for j in range(1, m + 1):
            if only:
                best[j, 0] = best[j - 1, 0] + stay
                back[j, 0] = (j - 1, 0)
            else:
                step = best[j - 1] + self.t[:, 0]
                back[j, 0] = (j - 1, int(step.argmax()))
                best[j, 0] = step.max()
            lo, hi = edges[j], edges[j + 1]
            only = lo == hi
            if not only:
                into = best[ci[lo:hi]][:, :, None] + self.t[None, :, 1:] + score[lo:hi, None, :]
                before = into.argmax(axis=1)
                top = np.take_along_axis(into, before[:, None, :], axis=1)[:, 0, :]
                k = top.argmax(axis=0)
                for y in range(1, types):
                    best[j, y], back[j, y] = top[k[y - 1], y - 1], (int(ci[lo + k[y - 1]]), int(before[k[y - 1], y - 1]))
        out, j, y = [], m, int(best[m].argmax())
        while j:
            i, p = back[j, y]
            if y:
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[y - 1]))
            j, y = i, p
        return out[::-1]

    def _gradient(self, text: str, tokens: list, cands: list, x: np.ndarray, gold: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood: gold's feature counts less the expected ones, by forward and backward sums."""
        score, m, types = x @ self.w.T, len(tokens), len(KINDS) + 1
        by_end, by_start = [[] for _ in range(m + 1)], [[] for _ in range(m + 1)]
        for k, (i, j) in enumerate(cands):
            by_end[j].append(k)
            by_start[i].append(k)
        e, lift = np.exp(self.t), np.exp(score)
        f, b = np.zeros((m + 1, types)), np.zeros((m + 1, types))
        f[0, 0] = 1
        for j in range(1, m + 1):
            f[j, 0] = f[j - 1] @ e[:, 0]
            for k in by_end[j]:
                f[j, 1:] += (f[cands[k][0]] @ e[:, 1:]) * lift[k]
        b[m] = 1
        for i in range(m - 1, -1, -1):
            b[i] = e[:, 0] * b[i + 1, 0]
            for k in by_start[i]:
                b[i] += e[:, 1:] @ (lift[k] * b[cands[k][1], 1:])
        z = f[m].sum()
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for j in range(1, m + 1):
            gt[:, 0] -= f[j - 1] * e[:, 0] * b[j, 0] / z
        expected = np.zeros_like(score)
        for k, (i, j) in enumerate(cands):
            flow = f[i][:, None] * e[:, 1:] * (lift[k] * b[j, 1:])[None, :] / z
            expected[k] = flow.sum(axis=0)
            gt[:, 1:] -= flow
        gw -= expected.T @ x
        j, y = 0, 0
        while j < m:
            k, kind = gold.get(j, (None, 0))
            gt[y, kind] += 1
            if kind:
                gw[kind - 1] += x[k]
            j, y = (cands[k][1] if kind else j + 1), kind
        return gw, gt

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 10, rate: float = 0.5, decay: float = 2e-3) -> SemiMarkov:
        """Adaptive-step ascent of the penalised likelihood of ``examples``: (text, its entities)."""
        ready = []
        for text, spans in examples:
            want = {(s, e): KINDS.index(k) + 1 for s, e, k in spans}
            for tokens in windows(text):
                ci, cj = candidates(text, tokens, covered([]))
                cands = list(zip(ci.tolist(), cj.tolist()))
                if cands:
                    at = {(tokens[i][0], tokens[j - 1][1]): (i, k) for k, (i, j) in enumerate(cands)}
                    gold = {at[s][0]: (at[s][1], y) for s, y in want.items() if s in at}
                    ready.append((text, tokens, cands, self._rows(text, tokens, ci, cj), gold))
        hw, ht = np.full_like(self.w, 1e-3), np.full_like(self.t, 1e-3)
        for epoch in range(epochs):
            random.Random(epoch).shuffle(ready)
            for one in ready:
                gw, gt = self._gradient(*one)
                gw, gt = gw - decay * self.w, gt - decay * self.t
                hw += gw**2
                ht += gt**2
                self.w += rate * gw / np.sqrt(hw)
                self.t += rate * gt / np.sqrt(ht)
        return self


def find_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    if "@" not in text and not ANCHOR.search(text):
        return [], []
    base, more = base_spans(text), []
    starts, ends = covered(base)
    for tokens in windows(text):
        a, b = bisect.bisect_right(ends, tokens[0][0]), bisect.bisect_left(starts, tokens[-1][1])
        more += model.decode_clear(text, tokens, (starts[a:b], ends[a:b]))
    out, top = [], -1
    for s in sorted(set(more), key=_order):  # stretches may share context tokens: the first span found stays
        if s[0] >= top:
            out.append(s)
            top = s[1]
    return base, sorted(base + out, key=_order)


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---- training examples


def _rewritten(span: str, kind: str, rng: random.Random) -> str:
    """The same entity in a form that the base patterns don't know."""
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT ")])
        local, _, host = span.partition("@")
        return re.sub("[^A-Za-z0-9]", "", local)[-12:] + at + host.replace(".", dot)
    if kind == "card":
        digits = DIGITS_ONLY.sub("", span)
        return rng.choice([".", "/", "  "]).join(re.findall(".{1,4}", digits))
    if kind == "phone":
        groups = re.findall("[0-9]+", span)[1:]
        if len(groups) == 3:
            return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "{} {} {}"]).format(*groups)
    return span


def _look_alikes(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    while luhn(fail := d(rng.choice((12, 14, 16, 16, 16, 18)))):
        pass
    return rng.choice([f"version {d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"in 19{d(2)} and", fail, f"{fail[:4]} {fail[4:8]} {fail[8:]}", f"{d(3)},{d(3)}.{d(2)}", f"at {d(2)}:{d(2)}", f"pages {d(3)}-{d(3)}", f"3{d(2)}.{d(3)}.9{d(2)}.{d(1)}", 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', f"at the {d(1)} of", f"@{d(2)} said", f"{d(5)}", f"{d(9)}", f"id {d(7)}"])


def training_examples(found: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled windows: entities (text, kind) from the sample and from templates, as found, rewritten, and look-alikes, in random contexts."""
    rng, out = random.Random(seed), []
    words = ["the", "of", "and", "call", "mail", "to", "de", "la", "und", "card", "at", "ip", "number", "host", "from", "is"]
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pool = {k: [s for s, kind in found if kind == k] for k in KINDS}
    for _ in range(30):
        pool["email"].append(f"{rng.choice(words)}.{d(2)}@mail{d(1)}.{rng.choice(('example.com', 'site.org', 'web.co.uk'))}")
        pool["ip"].append(".".join(str(rng.randrange(256)) for _ in range(4)))
        pool["phone"].append(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}")
        stem = d(15)
        pool["card"].append(next(stem + c for c in "0123456789" if luhn(stem + c)))
    left = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    for n in range(TRAIN_WINDOWS):
        text, spans = left() + " ", []
        for _ in range(rng.choice((1, 1, 2))):
            if n % 3 == 2 or rng.random() < 0.15:
                text += _look_alikes(rng)
            else:
                kind = KINDS[n % 4]
                s = rng.choice(pool[kind])
                s = _rewritten(s, kind, rng) if rng.random() < 0.5 else s
                spans.append((len(text), len(text) + len(s), kind))
                text += s
            text += rng.choice([" ", ", ", ". ", "%%% ", " | ", "\n"]) + left() + " "
        out.append((text, spans))
    return out


def _sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Base entities of the sampled documents: at most TRAIN_WINDOWS short strings of each kind, found in the tasks."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(d, t[s:e], k) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for s, e, k in base_spans(t) if e - s <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "span", "kind"])

    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(found, "doc_id long, span string, kind string")  # SAMPLE_DOCS ids at most
    ranked = rows.distinct().orderBy(F.xxhash64("doc_id", "span"), "doc_id", "span", "kind").limit(4 * TRAIN_WINDOWS)
    return [(r.span, r.kind) for r in ranked.collect()]


def train(docs: DataFrame) -> SemiMarkov:
    return SemiMarkov().fit(training_examples(_sample(common.texts(docs))))


# ---- over documents


def pii_spans(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, spans (all, as ``kind:start:end`` in code points), n_added."""
    common.small_batches(docs.sparkSession)
    model = model or train(docs)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, added = [], [], [], []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text, model)
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                sums.append(hashlib.sha256(rendered(base).encode()).hexdigest())
                spans.append(rendered(every))
                added.append(len(every) - len(base))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return common.texts(docs).mapInArrow(scan, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at, end = [], 0, -1
    for s, e, k in spans:
        if s >= end:
            out += [text[at:s], f"[{k.upper()}]"]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """``docs`` with all spans masked in ``text``; ``n_chars``, if there, follows where a text changed. Other columns stay."""
    common.small_batches(docs.sparkSession)
    model = model or train(docs)
    at = docs.columns.index("text")
    follow = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            after = [t if t is None else masked(t, find_spans(t, model)[1]) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(after, columns[at].type)
            if follow is not None:
                columns[follow] = pa.array([n if a == t else len(a) for n, t, a in zip(columns[follow].to_pylist(), texts, after)], columns[follow].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.map_rows(docs, mask, docs.schema)


def op2_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans with the model's."""
    return pii_spans(common.table(spark, sf_dir, "documents"))
