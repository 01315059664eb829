"""Noise in text from scanned pages: furniture, words broken over lines, misread words.

Method: correction candidates come from an inverted join on character q-grams between all words and the words of
ordinary language; boosted trees rank them and the most probable replaces the word. Boosted trees over a line and its
neighbours tell furniture; boosted trees over pairs of lines decide whether the second line ends a word that the first
begins, runs on, or begins something new.

All counts (words, q-grams) are taken over all texts, and no decision depends on how large they are: how often a word
occurs enters only as its share of the candidate's count, lowered by the error of so small a count. The classifiers are
fitted on the driver on samples of at most SAMPLE generated rows: words of the corpus with generated misreadings, and
generated pages of invented wording.

Defined results: null and empty texts have no cases; repeated rows give each case once; a word that has no candidate
above the threshold stays; capitalised words inside a sentence, words with figures only and words in furniture stay. A
broken word keeps its hyphen if the corpus knows that spelling at least as well as the joined one.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.durable import durable
from ledgerloom.llm.boost import Boosted
from ledgerloom.llm.patterns import rx
from ledgerloom.sources.tables import spread

SAMPLE = 4000
#: Lines of generated pages that the line classifier is fitted on.
LINES = 12_000
#: Signs that break a word at a line's end, and what scanners take for what.
HYPHENS = "-‐‑‒–¬­"
LOOKS = (("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("|", "l"), ("!", "l"), ("$", "s"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("li", "h"), ("ir", "n"), ("nn", "m"), ("iu", "m"), ("q", "g"), ("u", "ii"), ("h", "li"), ("o", "0"), ("s", "5"), ("l", "1"), ("in", "m"), ("ni", "m"))
_SWAP = {(a, b) for a, b in LOOKS}
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[^\p{L}\p{N}|$!]+|[^\p{L}\p{N}|$]+$")
_PLAIN = re.compile(r"^[A-Za-z](?:[a-z0-9|!$]|(?<=\p{L})[-‑](?=\p{L}))*$|^[0-9|$!][a-z0-9|!$-]*[a-z]{2,}[a-z0-9|!$-]*$")
PAGE = re.compile(r"^\W*(?:(?:page|pg|p|seite|पृष्ठ)\W*(?:no|number)?\W*)?\d{1,4}(?:\s*(?:of|/|-)\s*\d{1,4})?\W*$", re.I)
PAGE_WORD = re.compile(r"^\W*(?:page|pg)\b\W*(?:no)?\W*\d{1,4}\s*(?:(?:of|/)\s*\d{1,4})?\W*$", re.I)


def core(token: str) -> str:
    """The token without adjacent punctuation."""
    return _EDGE.sub("", token)


def shape(line: str) -> str:
    """A line without what differs from page to page: figures, case and spacing."""
    return rx(r"\s+").sub(" ", rx(r"[\d]+").sub("9", line.lower())).strip()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4:
        return False
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) >= 0.75 * (len(a) + len(b) - 2)


def _likes(shapes: list[str]) -> list[int]:
    """For each line, how many others are alike. A misread place can't spoil both ends, so likes share their first or last signs."""
    times = Counter(s for s in shapes if len(s) >= 6)
    ends: dict[str, list[str]] = {}
    for s in times:
        k = 5 if len(s) < 16 else 8
        ends.setdefault("^" + s[:k], []).append(s)
        ends.setdefault(s[-k:] + "$", []).append(s)
    likes = {s: n - 1 for s, n in times.items()}
    seen = set()
    for group in ends.values():
        group.sort(key=len)
        for i, s in enumerate(group):
            for t in group[i + 1 :]:
                if len(t) - len(s) > 4:
                    break
                if (s, t) not in seen:
                    seen |= {(s, t), (t, s)}
                    if _alike(s, t):
                        likes[s] += times[t]
                        likes[t] += times[s]
    return [likes.get(s, 0) for s in shapes]


# --- furniture -------------------------------------------------------------------------------------------------


_NUMBER = re.compile(r"\d+")
_LETTERS = re.compile(r"\p{L}+")
_MONEY = re.compile(r"(?:\brs\b|₹|\binr\b|\d[.,]\d\d)", re.I)
_CONTACT = re.compile(r"@|[:]|\bsd/-", re.I)
_PAGED = re.compile(r"\s{2,}\d{1,3}$")
_FIGURES = re.compile(r"\D+")


def line_features(lines: list[str]) -> np.ndarray:
    """A row of features for each line, from the line, its neighbours and its likes in the text."""
    clean = [x.strip() for x in lines]
    shapes = [shape(_PAGED.sub("", x)) for x in clean]
    pages = {i: int(m.group()) if (m := _NUMBER.search(x)) else None for i, x in enumerate(clean) if x and len(x) <= 40 and PAGE.match(x)}
    order = list(pages)
    rising = set()
    for k, i in enumerate(order):
        if pages[i] is not None and (k and pages[order[k - 1]] is not None and pages[i] == pages[order[k - 1]] + 1 or k + 1 < len(order) and pages[order[k + 1]] == pages[i] + 1):
            rising.add(i)
    likes = _likes(shapes)
    filled = [i for i, x in enumerate(clean) if x]
    widths = sorted(len(x) for x in clean if x)
    usual = widths[(len(widths) * 3) // 4] if widths else 1
    figures = [_FIGURES.sub("", _PAGED.sub("", x)) for x in clean]
    recurs = Counter(g for g in figures if len(g) >= 4)
    out = np.zeros((len(lines), 23))
    for k, i in enumerate(filled):
        x = clean[i]
        before = clean[filled[k - 1]] if k else ""
        after = clean[filled[k + 1]] if k + 1 < len(filled) else ""
        words = _LETTERS.findall(x)
        out[i] = (
            i in pages,
            i in pages and PAGE_WORD.match(x) is not None,
            i in rising,
            likes[i],
            len(x) / usual,
            sum(w[0].isupper() for w in words) / len(words) if words else 0,
            x.isupper(),
            x[-1] in ".,;:!?",
            bool(before) and before[-1:] in "abcdefghijklmnopqrstuvwxyz,‐-" and after[:1].islower(),
            (k > 0 and filled[k - 1] in pages) or (k + 1 < len(filled) and filled[k + 1] in pages),
            x[0].islower(),
            _MONEY.search(x) is not None,
            min(k, len(filled) - 1 - k) == 0,
            _CONTACT.search(x) is not None,
            len(words),
            _PAGED.search(x) is not None,
            i > 0 and not clean[i - 1],
            i + 1 < len(clean) and not clean[i + 1],
            len(before) / usual,
            before[-1:] in ".!?",
            x.count(","),
            len(figures[i]),
            recurs[figures[i]] - 1 if len(figures[i]) >= 4 else 0,
        )
    return out


#: Words of the generated pages; neither they nor the headers below are taken from any given table.
_FILL = "a an about across after again along also among any around because been before below between both cold could day deep down each early eight even every far few first five for from full garden good great had hand has heard her high him how if into just kind know land large last late left less letter light little long made main man many may mean might more morning most move much must near need never next night number of often old once only open other our over own paper part people place point quite rather read right river round said same school second see seem should show side since small some sound south start state still stone such take than that the their then there these they thing this those three through time together too took town tree turn two under until upon very walk warm was watch water well went were what when where which while white who why wide wind winter with word work world would year young".split()
_HEADS = "annual archive branch bulletin catalogue chronicle circular county digest gazette guide handbook inventory journal ledger library manual minutes museum notice office proceedings protocol register review schedule series society survey treatise volume yearbook".split()


def generated_paper(seed: int, pages: int) -> tuple[list[str], list[int], list[str]]:
    """Lines of one generated paper, which of them are furniture, and how each other line is joined to the next of them.

    'w': a word is broken; 's': the text runs on; 'b': something new begins; '' on furniture and blank lines.
    """
    draw = random.Random(seed)
    name = lambda: "".join(draw.choice("bdgklmnprstv") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5))).title()
    head_word = lambda: draw.choice(_HEADS).title()
    style = draw.randrange(9)
    number = lambda n: (f"Page {n} of {pages}", f"- {n} -", str(n), f"Pg. {n}", f"Page No: {n:02d}", f"{n}/{pages}", f"[{n}]", f"Page{n} of{pages}", f"Page {n}")[style]
    serial = draw.randrange(10**5, 10**6)
    head = (f"{name()} {head_word()} | {head_word()} {head_word()} {head_word()}", f"{name()} {head_word()} - {head_word()} {head_word()} Part {draw.choice('ABCDE')}", f"{name()} {head_word()}, {name()}pur", f"{head_word()} {head_word()} continued", f"{head_word()} {head_word()} no. {serial}", f"{head_word().upper()}  {head_word()} {draw.choice('ABCDEFG')}{draw.choice('KLMN')}{serial}", f"{name()} {head_word()} and {head_word()}", f"{name()} {head_word()} {head_word()} and {head_word()} - {head_word()} {head_word()} Part {draw.choice('ABCDE')}", f"{head_word()} {head_word()} {head_word()}   {draw.choice('KLMN')}{draw.choice('KLMN')}/{serial}/24", f"{head_word().upper()}  {head_word()} {draw.choice('KLMN')}{draw.choice('KLMN')}000{serial}")[draw.randrange(10)]
    if draw.random() < 0.3:
        head = head.upper()
    labels = [head_word() for _ in range(3)]
    phrases = [[draw.choice(_FILL) for _ in range(draw.randrange(3, 9))] for _ in range(6)]
    lines: list[str] = []
    mark: list[int] = []
    ends: list[str] = []
    width = draw.randrange(48, 84)
    hyphen = draw.choice("---‐‑¬")
    has_head, top, has_number, gaps = draw.random() < 0.75, draw.random() < 0.6, draw.random() < 0.8, draw.random() < 0.4
    single = pages == 1 and draw.random() < 0.5

    def add(text: str, off: int, end: str) -> None:
        lines.append(text)
        mark.append(off)
        ends.append(end)

    def furniture() -> None:
        h = head
        if draw.random() < 0.25:
            i = draw.randrange(len(h) - 1)
            h = h[:i] + h[i + 1] + h[i] + h[i + 2 :]
        if draw.random() < 0.15:
            h += f"   {n}"
        for p in ([h] if has_head and not single else []) + ([number(n)] if has_number else []):
            add(p, 1, "")
        if gaps and draw.random() < 0.5:
            add("", 0, "")

    def sentence() -> str:
        words = [draw.choice(_FILL) for _ in range(draw.randrange(5, 18))]
        for i in range(len(words)):
            if draw.random() < 0.12:
                words[i] = draw.choice((name(), f"{name()} {name()}", str(draw.randrange(2000)), f"Rs. {draw.randrange(10**5)}", f"{draw.randrange(1, 29)}-{draw.randrange(1, 12)}-20{draw.randrange(10, 26)}", "twenty-one", "well-kept", "re-read", f"{draw.randrange(1, 29)} {draw.choice(('March', 'June', 'August'))} 20{draw.randrange(10, 26)}", f"{name()} Street, {name()}, {name()}pur-{draw.randrange(10**5, 10**6)}", f"{name().upper()} LANE, {name().upper()} {draw.randrange(10**5, 10**6)}"))
        if draw.random() < 0.4:  # set phrases recur in the body as well
            words[: len(words) // 2] = draw.choice(phrases)
        words[0] = words[0][:1].upper() + words[0][1:]
        return " ".join(words) + draw.choice("......!?;:")

    def form() -> str:
        if draw.random() < 0.4:  # one label recurs with other figures, which makes no header of it
            figures = draw.choice((f"{draw.randrange(10**9, 10**10)}", f"{draw.randrange(1000, 9999)} {draw.randrange(1000, 9999)} {draw.randrange(1000, 9999)}", f"+{draw.randrange(10, 99)} {draw.randrange(10**9, 10**10)} / {draw.randrange(10**9, 10**10)}", f"{draw.choice('KLMNXZ')} {draw.randrange(10**6, 10**7)}"))
            return draw.choice(labels) + draw.choice((": ", " ", " no. ")) + figures
        return draw.choice((f"{head_word()} {draw.choice(_FILL)} : Rs. {draw.randrange(10**4, 10**6)}", f"{head_word()} {head_word()}   INR {draw.randrange(10**4)}.00", f"{head_word()}: {name().lower()}@site.example", f"{name().upper()[:3]} {draw.randrange(1000, 9999)} {draw.randrange(1000, 9999)} 1234", f"{head_word()}: {name()} {name()}", f"Sd/- {name()} {name()}", f"{head_word()}: {draw.randrange(10**9, 10**10)}", f"{name()} {name()}, {draw.randrange(90)} {name()} Road", f"{head_word()} {head_word()} .... Rs.{draw.randrange(10**5)}"))

    n = 1
    left = 0  # lines until the page ends
    while True:
        if draw.random() < 0.25:  # a block of form lines, or one alone
            todo = [(form(), "b") for _ in range(draw.choice((1, 1, 2, 3)))]
        else:
            text = " ".join(sentence() for _ in range(draw.randrange(1, 7)))
            if draw.random() < 0.15:  # values in capitals stand anywhere
                text += f" {name().upper()} {name().upper()}" + draw.choice((".", f", {name().upper()} {draw.choice(('ROAD', 'LANE', 'STREET'))}, {name().upper()}PUR-{draw.randrange(10**5, 10**6)}.", f" {name().upper()}@SITE.EXAMPLE."))
            todo = []
            while len(text) > width:
                cut = text.rfind(" ", 0, width + 1 if draw.random() < 0.92 else draw.randrange(8, width))  # some lines end early
                room = width - cut - 2
                word = text[cut + 1 :].split(" ", 1)[0]
                bare = re.match(r"\p{Ll}+", word)
                if room >= 2 and bare and len(bare.group()) >= 5 and draw.random() < 0.7:
                    k = draw.randrange(2, max(3, min(room, len(bare.group()) - 2) + 1))
                    todo.append((text[: cut + 1 + k] + hyphen, "w"))
                    text = text[cut + 1 + k :]
                elif "-" in word[1:-1] and word.replace("-", "").isalpha() and word.find("-") < room and draw.random() < 0.5:
                    k = word.find("-") + 1
                    todo.append((text[: cut + 1 + k], "w"))
                    text = text[cut + 1 + k :]
                else:
                    cut = cut if cut > 0 else width
                    todo.append((text[:cut], "s"))
                    text = text[cut:].lstrip()
            if text:
                todo.append((text, "b"))
        for text, end in todo:
            if not left:
                if lines and not top:
                    furniture()
                if lines:
                    n += 1
                if n > pages:
                    break
                if gaps and lines and draw.random() < 0.5:
                    add("", 0, "")
                if top:
                    furniture()
                left = draw.randrange(5, 22)
            add(text, 0, end)
            left -= 1
        if n > pages:
            break
        if draw.random() < 0.75:
            add("", 0, "")
    return lines, mark, ends


def generated_pages(seed: int, pages: int) -> tuple[list[str], list[int]]:
    """Lines of one generated paper and which of them are furniture."""
    return generated_paper(seed, pages)[:2]


def furniture_model(seed: int = 5) -> Boosted:
    """The line classifier, fitted on about LINES lines of generated papers."""
    x, y = [], []
    n = 0
    while n < LINES:
        lines, mark = generated_pages(seed * 100_000 + len(x), 1 + (len(x) * 7) % 9)
        f = line_features(lines)
        keep = [i for i, t in enumerate(lines) if t.strip()]
        x.append(f[keep])
        y += [mark[i] for i in keep]
        n += len(keep)
    return Boosted(trees=70, depth=4).fit(np.concatenate(x), np.array(y))


# --- pairs of lines ---------------------------------------------------------------------------------------------

_FIELD = re.compile(r"[\p{L} ./]{2,28}\s?:\s")
_SUM_END = re.compile(r"(?:rs\.?|inr|₹)\s*[\d,.]+(?:/-)?$|\d{6,}$", re.I)
_BULLET = re.compile(r"(?:[-*•]|\(?\w{1,2}[.)])\s")


def join_features(lines: list[str], off: list[bool]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(line, next line) for all lines that are neither blank nor furniture, and a row of features for each pair."""
    body = [i for i, o in enumerate(off) if not o and lines[i].strip()]
    clean = {i: lines[i].strip() for i in body}
    usual = sorted(map(len, clean.values()))[(len(clean) * 3) // 4] if clean else 1
    pairs = list(zip(body, body[1:]))
    out = np.zeros((len(pairs), 20))
    for k, (i, j) in enumerate(pairs):
        a, b = clean[i], clean[j]
        first = b.split(" ", 1)[0]
        between = off[i + 1 : j]
        out[k] = (
            a[-1] in HYPHENS, len(a) > 1 and a[-1] in HYPHENS and a[-2].isalpha(), a[-1] in ".!?", a[-1] in ",;", a[-1] == ":", a[-1].islower(), a[-1].isdigit(),
            b[0].islower(), b[0].isupper(), b[0].isdigit(), len(a) / usual, len(b) / usual, (len(a) + 1 + len(first)) / usual,
            any(between), len(between) - sum(between), _FIELD.match(a) is not None, _FIELD.match(b) is not None, _SUM_END.search(a) is not None, _SUM_END.search(b) is not None,
            a.isupper() or b.isupper() or _BULLET.match(b) is not None,
        )
    return pairs, out


class Joins:
    """Two sets of trees over pairs of lines: does the second end a word of the first, and else, does it run on."""

    def __init__(self, word: Boosted, on: Boosted):
        self.word, self.on = word, on

    def of(self, texts: list[list[str]], off: list[list[bool]]) -> list[dict[int, tuple[int, str]]]:
        """For each text: line -> (next line, 'w', 's' or 'b')."""
        got = [join_features(lines, o) for lines, o in zip(texts, off)]
        x = np.concatenate([f for _, f in got]) if got else np.zeros((0, 20))
        kind = np.where(self.word.probability(x) >= 0.5, "w", np.where(self.on.probability(x) >= 0.5, "s", "b")).tolist()
        out, at = [], 0
        for pairs, _ in got:
            out.append({i: (j, kind[at + k]) for k, (i, j) in enumerate(pairs)})
            at += len(pairs)
        return out


def join_model(seed: int = 8) -> Joins:
    """The pair classifier, fitted on at most SAMPLE pairs of generated papers."""
    x, y = [], []
    n = k = 0
    while n < SAMPLE:
        lines, mark, ends = generated_paper(seed * 100_000 + k, 1 + (k * 7) % 9)
        pairs, f = join_features(lines, [bool(m) for m in mark])
        x.append(f)
        y += [ends[i] for i, _ in pairs]
        n += len(pairs)
        k += 1
    x, y = np.concatenate(x)[:SAMPLE], np.array(y[:SAMPLE])
    rest = y != "w"
    return Joins(Boosted(trees=30, depth=3).fit(x, y == "w"), Boosted(trees=40, depth=4).fit(x[rest], y[rest] == "s"))


def furniture(lines: list[str], model: Boosted) -> list[bool]:
    """Which lines are running headers or page numbers."""
    return furniture_of([lines], model)[0]


def furniture_of(texts: list[list[str]], model: Boosted) -> list[list[bool]]:
    """The same for many texts at once: the trees run over all their lines together."""
    filled = [np.array([bool(t.strip()) for t in lines], dtype=bool) for lines in texts]
    x = [line_features(lines)[f] for lines, f in zip(texts, filled)]
    p = model.probability(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for f in filled:
        off = np.zeros(len(f), dtype=bool)
        n = int(f.sum())
        off[f] = p[at : at + n] >= 0.5
        at += n
        out.append(off.tolist())
    return out


# --- words -----------------------------------------------------------------------------------------------------


def looks_distance(w: str, c: str) -> float:
    """Edit distance in which a known misreading costs a quarter."""
    n, m = len(w), len(c)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = float(i)
    for j in range(1, m + 1):
        d[0][j] = float(j)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = w[i - 1], c[j - 1]
            best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (0 if a == b else 0.25 if (a, b) in _SWAP else 1))
            if i > 1 and j > 1 and a == c[j - 2] and w[i - 2] == b:
                best = min(best, d[i - 2][j - 2] + 0.8)
            if i > 1 and (w[i - 2 : i], b) in _SWAP:
                best = min(best, d[i - 2][j - 1] + 0.25)
            if j > 1 and (a, c[j - 2 : j]) in _SWAP:
                best = min(best, d[i - 1][j - 2] + 0.25)
            if i > 1 and j > 1 and (w[i - 2 : i], c[j - 2 : j]) in _SWAP:
                best = min(best, d[i - 2][j - 2] + 0.25)
            d[i][j] = best
    return d[n][m]


def grams(w: str) -> set[str]:
    p = f"^{w}$"
    return {p[i : i + 2] for i in range(len(p) - 1)}


def share(n_w: float, n_c: float) -> float:
    """log10 of a word's count as a share of the candidate's, at least -4: the lower bound that so small a count allows.

    With growing counts it goes to the share itself, so a recurring misreading looks the same in a corpus of any size.
    """
    return max(-4.0, math.log10((max(0.0, n_w - 2 * math.sqrt(n_w)) + 0.3) / (n_c + 1)))


def pair_features(w: str, n_w: float, c: str, n_c: float) -> list[float]:
    gw, gc = grams(w), grams(c)
    d = looks_distance(w, c)
    return [d, d / max(len(c), 1), len(c), share(n_w, n_c), len(gw & gc) / len(gw | gc), any(ch in "0123456789|!$" for ch in w), w[:1] == c[:1], w[-1:] == c[-1:], len(w) - len(c)]


def misread(word: str, draw: random.Random) -> str:
    """A generated misreading: one or two known confusions, or a wrong letter."""
    for _ in range(1 + (draw.random() < 0.2)):
        fits = [(a, b) for a, b in LOOKS if b in word]
        if fits:
            a, b = draw.choice(fits)
            at = draw.choice([m.start() for m in rx(re.escape(b)).finditer(word)])
            word = word[:at] + a + word[at + len(b) :]
    return word


#: A spelling that looks like another's misreading and occurs less often than this share (log10) of it is not taught as a right word.
MAY_BE_MISREAD = -1.3


def _trusted(common: list[tuple[str, int]]) -> list[str]:
    """The words that aren't likely to be misreadings of a commoner one, in order."""
    index: dict[str, list[tuple[str, int]]] = {}
    kept = []
    for w, n in sorted(common, key=lambda x: (-x[1], x[0])):
        met = Counter(c for g in grams(w) for c in index.get(g, ()) if abs(len(c[0]) - len(w)) <= 2)
        if not any(k >= max(2, len(w) - 4) and share(n, m) < MAY_BE_MISREAD and looks_distance(w, c) <= 0.8 for (c, m), k in met.items()):
            kept.append(w)
            for g in grams(w):
                index.setdefault(g, []).append((w, n))
    return sorted(kept)


def word_model(common: list[tuple[str, int]], seed: int = 11) -> Boosted:
    """The ranking trees, fitted on at most SAMPLE pairs of generated misreadings and corpus words.

    Counts are drawn for corpora of all sizes: the words' own counts times a factor, misreadings as a share of them.
    """
    draw = random.Random(seed)
    chance = np.random.default_rng(seed)
    words = _trusted([(w, n) for w, n in common if len(w) >= 4 and w.isalpha()])
    count = dict(common)
    x, y = [], []
    if len(words) < 20:
        return Boosted(trees=1).fit(np.array([[0.25, 0.05, 6, -3, 0.7, 0, 1, 1, 0], [3, 0.5, 6, 0, 0.1, 0, 0, 0, 2]] * 20), np.array([1, 0] * 20))
    index: dict[str, list[str]] = {}
    for w in words:
        for g in grams(w):
            index.setdefault(g, []).append(w)

    def near(t: str, right: str) -> list[str]:
        seen = Counter(w for g in grams(t) for w in index.get(g, ()))
        return [w for w, k in seen.most_common(8) if w != right and k >= 2 and abs(len(w) - len(t)) <= 2][:3]

    while len(y) < SAMPLE:
        size = 10 ** draw.uniform(-1, 3)
        n = lambda w: max(1.0, count[w] * size)  # noqa: B023, E731
        w = draw.choice(words)
        wrong = misread(w, draw)
        if wrong != w and (wrong not in count or share(count[wrong], count[w]) < MAY_BE_MISREAD):
            often = max(1, int(chance.poisson(n(w) * 10 ** draw.uniform(-4, -1))))
            x.append(pair_features(wrong, often, w, n(w)))
            y.append(1)
            for other in near(wrong, w):
                if other != wrong and looks_distance(w, other) > 0.8:
                    x.append(pair_features(wrong, often, other, n(other)))
                    y.append(0)
        for other in near(w, w):  # a right word isn't a misreading of its neighbour, though it may be rarer
            x.append(pair_features(w, n(w), other, n(other)))
            y.append(0)
        name = "".join(draw.choice("bdgklmnprstv") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5)))
        for other in near(name, ""):
            x.append(pair_features(name, max(1, round(draw.randrange(1, 6) * size)), other, n(other)))
            y.append(0)
    return Boosted(trees=60, depth=4).fit(np.array(x[:SAMPLE]), np.array(y[:SAMPLE]))


#: The commonest words are the sample that the ranking trees are fitted on.
FIT_WORDS = 3000


def _texts(scans: DataFrame, codes: DataFrame) -> DataFrame:
    """(record_kind, record_id, text), one row per record."""
    one = scans.select(F.lit("scan").alias("record_kind"), F.col("scan_id").alias("record_id"), F.col("raw_text_preview").alias("text"))
    two = codes.select(F.lit("code").alias("record_kind"), F.col("code_id").alias("record_id"), F.col("context").alias("text"))
    return spread(one.unionByName(two).where("record_id IS NOT NULL AND text IS NOT NULL AND text <> ''"), None, "record_kind", "record_id").dropDuplicates(["record_kind", "record_id"])


def events(texts: DataFrame, pages: Boosted, joins: Joins) -> DataFrame:
    """(record_kind, record_id, line_no, kind, word, extra): furniture lines, words to look up, and broken words.

    kind 'furniture': word is null. 'word': a word that may be ordinary language (extra: its spelling). 'split': word is
    the joined spelling, extra the one with the hyphen. 'break': something new begins after the line.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 200):
                out: list[tuple] = []
                part = f.iloc[at : at + 200]
                pieces = [text.replace("\r\n", "\n").split("\n") for text in part["text"]]
                scans = iter(furniture_of([p for kind, p in zip(part["record_kind"], pieces) if kind == "scan"], pages))
                off = [next(scans) if kind == "scan" else [False] * len(p) for kind, p in zip(part["record_kind"], pieces)]
                for kind, rid, p, o, j in zip(part["record_kind"], part["record_id"], pieces, off, joins.of(pieces, off)):
                    out += [(kind, rid, *e) for e in line_events(p, o, j)]
                yield pd.DataFrame(out, columns=["record_kind", "record_id", "line_no", "kind", "word", "extra", "initial"])

    return texts.select("record_kind", "record_id", "text").mapInPandas(run, "record_kind string, record_id bigint, line_no int, kind string, word string, extra string, initial string")


_FULL_STOP = re.compile(r"[.!?:]['\")]*$")
_SHORTENED = re.compile(r"(?:^|\W)(?:Rs|No|Dr|Mr|Mrs|\p{Lu})\.$")
_NO_WORD = re.compile(r"[@\[\]/_]|\.\p{L}|\d{4}")
_LEFT_EDGE = re.compile(r"^[^\p{L}\p{N}]+")
_BROKEN = re.compile(r"[\p{L}'’-]+")
_REST = re.compile(r"[\p{L}\p{N}'’-]+")
_TITLES = frozenset(("Rs", "No", "Dr", "Mr", "Mrs"))


def _word(t: str) -> tuple[str, bool]:
    """The word in a token ('' if it can't be ordinary language) and whether a sentence ends after it."""
    if t.isascii():  # most tokens: letters, perhaps with one sign after them
        body = t if t.isalpha() else t[:-1]
        if body.isalpha() and (body is t or t[-1] in ".,;:"):
            ends = body is not t and (t[-1] == ":" or t[-1] == "." and body not in _TITLES and not (len(body) == 1 and body.isupper()))
            return (body if body[1:].islower() else ""), ends
    ends = _FULL_STOP.search(t) is not None and _SHORTENED.search(t) is None
    w = core(t)
    return (w if len(w) >= 2 and _PLAIN.match(w) and not _NO_WORD.search(t) else ""), ends


def line_events(lines: list[str], off: list[bool], joined: dict[int, tuple[int, str]]) -> Iterator[tuple]:
    for i, o in enumerate(off):
        if o:
            yield i + 1, "furniture", None, None, None
    start = True  # a sentence begins here
    skip = False  # the first word of this line ends a broken one
    for i, o in enumerate(off):
        tokens = [] if o else lines[i].split()
        if not tokens:
            continue
        following, how = joined.get(i, (-1, "b"))
        if how == "b" and following >= 0:
            yield i + 1, "break", None, None, None
        head = core(lines[following].split()[0]) if how == "w" else ""
        last = len(tokens) - 1
        for j, t in enumerate(tokens):
            if j == 0 and skip:
                skip = False
                start = _FULL_STOP.search(t) is not None
                continue
            if j == last and head[:1].islower() and len(t) > 1 and t[-1] in HYPHENS:
                left = _LEFT_EDGE.sub("", t[:-1])
                if _BROKEN.fullmatch(left) and _REST.fullmatch(head):
                    yield i + 1, "split", left + head, left + "-" + head, ("s" if start else "m") if left[0].isupper() else "l"
                    skip = True
                start = False
                continue
            w, ends = _word(t)
            if len(w) >= 2:
                yield i + 1, "word", w.lower(), w, "l" if not w[0].isupper() else ("s" if start else "m")
            start = ends
        start = start or how == "b" and not skip


def noise(scans: DataFrame, codes: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no, noise_kind, restored)."""
    return cases(_texts(scans, codes)).where("noise_kind <> 'break'").drop("original").distinct()


def _candidates(asked: DataFrame, common: DataFrame) -> DataFrame:
    """(word, n, right, n_right): words of ordinary language that at most two misread places part from the word.

    Two places change the length by two at most and move what follows them by two at most, so a shared gram meets only
    at such lengths and places; the words must share what two places leave of the longer one's grams.
    """
    padded = lambda c: F.concat(F.lit("^"), c, F.lit("$"))
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded(c), i, 2))
    left = asked.select("word", "n", F.length("word").alias("length"), F.posexplode(gram(F.col("word"))).alias("at", "g"))
    shifts = F.sequence(F.lit(-2), F.lit(2))
    right = common.select("right", "n_right", F.explode(shifts).alias("d"), F.posexplode(gram(F.col("right"))).alias("p", "g"))
    right = right.select("right", "n_right", "g", (F.length("right") + F.col("d")).alias("length"), F.explode(F.transform(shifts, lambda s: F.col("p") + s)).alias("at"))
    met = left.join(right, ["g", "length", "at"]).where("word <> right AND n_right >= 2 * n").groupBy("word", "n", "right", "n_right").agg(F.count_distinct("g").alias("shared"))
    return met.where("shared >= greatest(2, greatest(length(word), length(right)) - 5)").select("word", "n", "right", "n_right")


def _right_words(asked: DataFrame, common: DataFrame) -> DataFrame:
    """(word, right): the most probable candidate of each word that has one above the threshold."""
    fit = [(r["right"], r["n_right"]) for r in common.orderBy(F.col("n_right").desc(), "right").limit(FIT_WORDS).collect()]
    ranking = word_model(fit)

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array([pair_features(*r) for r in zip(f["word"], f["n"], f["right"], f["n_right"])]) if len(f) else np.zeros((0, 9))
            f = f.assign(p=np.round(ranking.probability(x), 4))
            yield f.loc[f["p"] >= 0.5, ["word", "right", "n_right", "p"]]

    # Comparing costs far more than the bytes of a pair tell: spread by row, not by size.
    best = spread(_candidates(asked, common)).mapInPandas(rank, "word string, right string, n_right bigint, p double").groupBy("word").agg(F.max_by("right", F.struct("p", "n_right", "right")).alias("right"))
    best = durable(best)
    # A misreading may itself be the likeliest candidate of one with more wrong places; counts at least double, so chains end.
    for _ in range(2):
        best = best.alias("x").join(best.select(F.col("word").alias("right"), F.col("right").alias("over")), "right", "left").select("word", F.coalesce("over", "right").alias("right"))
    return durable(best)


def cases(texts: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no, noise_kind, restored, original) of texts (record_kind, record_id, text); noise_kind also 'break'."""
    found = durable(events(texts, furniture_model(), join_model()))
    spelled = durable(found.where("kind = 'word'").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("initial") == "l").alias("low")))
    # Ordinary words: letters only, mostly met in small letters or at the head of a sentence. The ranking decides the rest.
    known = spelled.where(r"word RLIKE '^[a-z]+(-[a-z]+)*$' AND (low >= 2 OR n >= 5)")
    common = known.where("low >= 2 AND length(word) >= 4").select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    broken = found.where("kind = 'split'").select(F.explode(F.array(F.lower("word"), F.lower("extra"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asked = spelled.select("word", "n").unionByName(broken.join(spelled.select("word"), "word", "left_anti")).where("length(word) >= 4")
    right_of = _right_words(asked, common)
    plain = lambda kind: found.where(F.col("kind") == kind).select("record_kind", "record_id", "line_no", F.lit(kind).alias("noise_kind"), F.lit("").alias("restored"), F.lit("").alias("original"))
    cased = lambda spelling, right: F.when(F.substring(spelling, 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, 2, 200))).otherwise(right)
    misreadings = (
        found.where("kind = 'word' AND initial <> 'm'")
        .join(right_of, "word")
        .select("record_kind", "record_id", "line_no", F.lit("misread").alias("noise_kind"), cased(F.col("extra"), F.col("right")).alias("restored"), F.col("extra").alias("original"))
    )
    splits = found.where("kind = 'split'").withColumns({"joined": F.lower("word"), "kept": F.lower("extra")})
    is_known = known.select(F.col("word").alias("k"), "n")
    splits = splits.join(is_known.select(F.col("k").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(is_known.select(F.col("k").alias("kept"), F.col("n").alias("nk")), "kept", "left")
    splits = splits.join(right_of.select(F.col("word").alias("joined"), F.col("right").alias("rj")), "joined", "left").join(right_of.select(F.col("word").alias("kept"), F.col("right").alias("rk")), "kept", "left")
    whole = F.when((F.col("nk") >= 2) & (F.col("nk") >= F.coalesce("nj", F.lit(0))), F.coalesce("rk", "kept")).when(F.col("nj").isNotNull() | F.col("rj").isNotNull(), F.coalesce("rj", "joined")).when(F.col("rk").isNotNull(), F.col("rk")).otherwise(F.when(F.col("initial") != "m", F.col("joined")))
    # A name broken over lines isn't ordinary language: only spellings the corpus knows count for capitalised parts.
    joined = splits.select("record_kind", "record_id", "line_no", F.lit("split").alias("noise_kind"), cased(F.col("word"), whole).alias("restored"), F.lit("").alias("original"), "initial", "nj", "nk").where("restored IS NOT NULL AND (initial <> 'm' OR nj IS NOT NULL OR nk IS NOT NULL)").drop("initial", "nj", "nk")
    return plain("furniture").unionByName(plain("break")).unionByName(misreadings).unionByName(joined).distinct()


def rebuilt(text: str, found: list[tuple[int, str, str, str]]) -> str:
    """A text with its cases (line_no, noise_kind, restored, original) repaired.

    Lines that run on are one line; what begins something new is parted by a blank line where the text has one, and else
    begins a line of its own.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    by: dict[int, list[tuple[str, str, str]]] = {}
    for n, kind, restored, original in found:
        by.setdefault(n, []).append((kind, restored, original))
    out = ""
    drop = new = gap = False  # the next word ends one that was joined; the next line begins something new; a blank line before it
    for n, line in enumerate(lines, 1):
        mine = by.get(n, [])
        tokens = line.split()
        if not tokens or any(k == "furniture" for k, _, _ in mine):
            gap = gap or not tokens
            continue
        swap = {original: restored for k, restored, original in mine if k == "misread"}
        tokens = [t.replace(core(t), swap[core(t)]) if core(t) in swap else t for t in tokens]
        if drop:
            tail = _EDGE.search(tokens[0])
            out += tail.group() if tail and tail.end() == len(tokens[0]) else ""
            tokens = tokens[1:]
        drop = False
        if (joined := [r for k, r, _ in mine if k == "split"]) and tokens:
            lead = rx(r"^[^\p{L}\p{N}]*").match(tokens[-1]).group()
            tokens[-1] = lead + joined[0]
            drop = True
        if tokens:
            out += ("" if not out else ("\n\n" if gap else "\n") if new else " ") + " ".join(tokens)
            new = False
        new = new or any(k == "break" for k, _, _ in mine)
        gap = False
    return out


def repaired(scans: DataFrame, codes: DataFrame) -> DataFrame:
    """(record_kind, record_id, text): every non-empty text as readable paragraphs.

    The cases of one text meet in one task; they are bounded by its length.
    """
    texts = durable(_texts(scans, codes))
    found = cases(texts).groupBy("record_kind", "record_id").agg(F.collect_set(F.struct("line_no", "noise_kind", "restored", "original")).alias("found"))

    @F.pandas_udf("string")
    def build(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(t, [(c["line_no"], c["noise_kind"], c["restored"], c["original"]) for c in f] if f is not None else []) for t, f in zip(text, found)])

    return texts.join(found, ["record_kind", "record_id"], "left").select("record_kind", "record_id", build("text", "found").alias("text"))
