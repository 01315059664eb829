"""Sentence units across languages and scripts.

Method: unsupervised abbreviation, collocation and sentence-starter statistics per language, by log-likelihood ratios
over all documents; then every period is classified with them. A first pass counts, per language of a block, how
often a type stands with and without a period, ends a block with it or is followed by a small letter, which words
follow sure sentence ends, and which follow a number or a short type with a period. Spark sums the counts; only what
passes its threshold reaches the driver, with a checked size. The second pass splits: a word that is a collocation of
the abbreviation or number before it, and no sentence starter, goes on with the sentence.

Layout comes first: a blank line ends a unit; in a block whose lines are all list lines or form lines each line is a
unit; other lines of a block run on. Speech in quotes inside a sentence doesn't end it.

Defined results: null, empty and blank texts have no units; a block without closing punctuation is one unit; repeated
rows give each unit once; a quote that is never closed in its block is no quote. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.durable import durable
from ledgerloom.llm.patterns import rx
from ledgerloom.sources.tables import spread

#: Signs that end a sentence wherever they stand, brackets and quotes, and month names (for ordinals).
ALWAYS = "。！？｡।॥۔؟！？"
MARKS = ".!?…" + ALWAYS
CLOSING = "\"'”’»)]」』）】›"
MONTHS = frozenset(
    "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
#: Frequent function words that tell languages of one script apart.
_WORDS = {
    "de": frozenset("der die das und ist nicht wurde mit von für den dem ein eine liegt fehlt bei um sie wir haben zum lt gem hr fr sind auf".split()),
    "fr": frozenset("le la les de du des et est une un pour dans que nous avons pas dit reste au sur été prescrit l'assuré mme".split()),
    "en": frozenset("the of and to in is was for with on that by has not been this from are be at".split()),
}
_MARATHI = re.compile(r"\b(?:आहे|आहेत|नाही|यांनी|येथे|झाली|केले|होता|यांची|व|का|इतके|मिळेल|पाठवा|इतकी)\b")
_HINDI = re.compile(r"\b(?:है|हैं|का|की|के|को|ने|में|से|गया|गए|पर|लेकिन)\b")
_BLOCK = re.compile(r"[^\S\n]*\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*")
_LIST = re.compile(r"\s*(?:[-*•‣▪◦·–—]\s+\S|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlIVXL]{1,5})\)\s*\S|\d{1,2}(?:\.\d{1,2})*\.?\s+\S|[①-⑳]\s*\S)")
_FORM = re.compile(r"\s*\p{L}[\p{L}\p{M} ./()&'-]{0,40}\s?[:：]\s*\S?")
_LABEL = re.compile(r"\s*(?:\p{Lu}[\p{L}.-]*\s+){1,3}(?:[\p{L}.]*\s*)?[\w/-]*\d[\w/-]*\s*$")
_CODE = re.compile(r"\s*[!-~]{24,}\s*$")
_LETTERS = re.compile(r"[\p{L}'’]+")
_SPACE = re.compile(r"\s+")
_NEXT = re.compile(r"[\s\"'“”„«»‘’(\[「『（]*([\p{L}\p{N}][\p{L}\p{M}\p{N}'’-]*)")
_MARK = re.compile(r"[.!?…" + ALWAYS + r"]+|(?<=[\p{Deva}])\|")
_THAI = re.compile(r"(?<=[\p{Thai}])\s+(?=[\p{Thai}])")
_LAST = re.compile(r"[^\s(\"“„«「\[,;:/'’]*$")
_RUN_ON = re.compile(r"(?<=\p{Ll}{3})\.(?=\p{Lu}\p{Ll})")
_TOKEN = re.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}.'’/-]*")
_SCRIPTS = tuple((name, re.compile(script)) for name, script in (("ta", r"\p{Tamil}"), ("th", r"\p{Thai}"), ("ur", r"\p{Arabic}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}")))
_DEVANAGARI = re.compile(r"\p{Deva}")
_QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“", '"': '"', "‹": "›", "（": "）", "(": ")"}
_OPEN = re.compile("[" + re.escape("".join(_QUOTES)) + "]")


def language(text: str, lang: str | None) -> str:
    """The language of a block, by script, then by function words, then by what the document is said to be in."""
    said = (lang or "").strip().lower()[:2]
    if text.isascii():
        return _latin(text, said)
    for name, script in _SCRIPTS:
        if script.search(text):
            return said if name == "ur" and said in ("ar", "fa") else name
    if _DEVANAGARI.search(text):
        hindi, marathi = len(_HINDI.findall(text)), len(_MARATHI.findall(text))
        return "mr" if marathi > hindi or (marathi == hindi and said == "mr") else "hi"
    return _latin(text, said)


def _latin(text: str, said: str) -> str:
    words = _LETTERS.findall(text.lower())
    score = {k: sum(map(v.__contains__, words)) for k, v in _WORDS.items()}
    best = max(score, key=lambda k: (score[k], k == said, k == "en"))
    return best if score[best] else (said if said in score else "en")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start and end of the units of layout, and whether each is one unit whatever it contains: list, form and code lines are; runs of other lines aren't."""
    for m in _BLOCK.finditer(text.replace("\r\n", " \n").replace("\r", "\n")):
        lines, at = [], m.start()
        for line in m.group().split("\n"):
            lines.append((at, at + len(line), line))
            at += len(line) + 1
        kinds = [_kind(x) for _, _, x in lines]
        run = None
        if all(k in ("list", "form", "code", "label") for k in kinds) and (len(kinds) > 1 or kinds[0] in ("list", "code")):
            yield from ((a, b, True) for a, b, _ in lines)
            continue
        for i, ((a, b, _), k) in enumerate(zip(lines, kinds)):
            alone = k == "code" or (k == "bullet") or (k == "list" and (i + 1 == len(kinds) or kinds[i + 1] == "list") and (i == 0 or kinds[i - 1] == "list") and len(kinds) > 1 and kinds.count("list") > 1)
            if alone:
                if run:
                    yield *run, False
                    run = None
                yield a, b, True
            else:
                run = (run[0] if run else a, b)
        if run:
            yield *run, False


def _kind(line: str) -> str:
    if _CODE.match(line):
        return "code"
    if _LIST.match(line):
        return "list"
    if _FORM.match(line) and len(line) <= 100 and not rx(r"[!?。।۔]\s*$").search(line) and len(rx(r"\w\.\s+\p{Lu}\p{Ll}+ \p{Ll}").findall(line)) == 0:
        return "form"
    if _LABEL.match(line) and len(line) <= 40:
        return "label"
    return "text"


@dataclass
class Model:
    """What was learned: (lang, type) of abbreviations (True: may end a sentence too), starters, and collocations:
    (lang, word) after numbers, (lang, type, word) after types with a period."""

    abbreviations: dict[tuple[str, str], bool] = field(default_factory=dict)
    starters: set[tuple[str, str]] = field(default_factory=set)
    ordinals: set[tuple[str, str]] = field(default_factory=set)
    collocations: set[tuple[str, str, str]] = field(default_factory=set)


def _before(block: str, at: int) -> str:
    """The type that ends at a mark: the last run of letters, figures and inner periods."""
    return _RUN_ON.split(_LAST.search(block, max(0, at - 60), at).group())[-1].lower()


def _quoted(block: str) -> list[tuple[int, int]]:
    """Start and end of what is quoted or in brackets; a quote that is never closed is none."""
    spans, i = [], 0
    while m := _OPEN.search(block, i):
        i = m.start()
        close = _QUOTES[block[i]]
        j = block.find(close, i + 1)
        if j < 0 and close == "“":
            j = block.find("”", i + 1)
        if block[i] in '("' and j > i + 400:
            j = -1
        if j > 0:
            spans.append((i, j))
            i = j
        i += 1
    return spans


def _is_number(t: str) -> bool:
    return bool(rx(r"[\d.,/-]*\d[\d.,/-]*").fullmatch(t))


def count(text: str | None, lang: str | None, into: Counter) -> None:
    """Adds the counts of a text, keyed (language, kind, word)."""
    for a, b, _ in blocks(text or ""):
        block = text[a:b]
        lg = language(block, lang)
        for t, n in Counter(_TOKEN.findall(block.lower())).items():
            w = t.rstrip(".")
            if "'" in w or "’" in w:
                w = w.replace("’", "'").rpartition("'")[2]
            if w and len(w) <= 40 and (w[0].isalpha() or not _is_number(w)):
                into[lg, "all", w] += n
        into[lg, "blocks", ""] += 1
        quotes = [q for q in _quoted(block) if block[q[0]] != "("]
        at = 0
        for m in _MARK.finditer(block):
            end, mark = m.end(), m.group()
            while at < len(quotes) and quotes[at][1] < end:
                at += 1
            if at < len(quotes) and quotes[at][0] < end:
                continue  # what ends a sentence of quoted speech ends no unit
            rest = block[end : end + 1]
            if mark == "." and not (rest == "" or rest.isspace() or rest in CLOSING or rest == ","):
                continue
            nxt = _NEXT.match(block, end)
            word = nxt.group(1)[:40] if nxt else ""
            if mark == ".":
                t = _before(block, m.start())
                final = not block[end:].strip(CLOSING + " \n")
                if _is_number(t):
                    into[lg, "ordinal", word.lower()] += bool(word)
                    continue
                if not t or len(t) > 40:
                    continue
                into[lg, "dot", t] += 1
                if word and (len(t) <= 6 or "." in t):
                    into[lg, "pair", f"{t} {word.lower()}"] += 1
                into[lg, "dots", ""] += 1
                into[lg, "final", t] += final
                into[lg, "finals", ""] += final
                into[lg, "small", t] += bool(word) and (word[0].islower() or word[0].isdigit()) or rest == ","
                if len(t) >= 6 and word and "." not in t:
                    into[lg, "start", word.lower()] += 1
                    into[lg, "starts", ""] += 1
            elif word and "…" not in mark and ".." not in mark:
                into[lg, "start", word.lower()] += 1
                into[lg, "starts", ""] += 1
        if first := _NEXT.match(block):
            into[lg, "start", first.group(1)[:40].lower()] += 1
            into[lg, "starts", ""] += 1


def _llr(k: float, n: float, p0: float, p1: float) -> float:
    """-2 log of the likelihood of k in n under p0 against p1."""
    p0, p1 = min(max(p0, 1e-9), 1 - 1e-9), min(max(p1, 1e-9), 1 - 1e-9)
    return -2 * (k * math.log(p0) + (n - k) * math.log(1 - p0) - k * math.log(p1) - (n - k) * math.log(1 - p1))


#: The log-likelihood ratio that a collocation must reach: one chance in two hundred.
COLLOCATED = 7.88


def collocation_ratio(k: float, first: float, second: float, n: float) -> float:
    """Dunning's ratio for `second` following `first` k times, over n tokens; negative if it follows less often than chance."""
    if not 0 < first < n or k <= 0:
        return 0.0
    second = max(second, k)
    p, p1, p2 = second / n, k / first, (second - k) / (n - first)
    ratio = _llr(k, first, p, p1) + _llr(second - k, n - first, p, p2)
    return ratio if p1 > p2 else -ratio


def is_abbreviation(t: str, all_: int, dot: int, final: int, small: int, dots: int, finals: int, tokens: int) -> bool | None:
    """None: no abbreviation; else whether it may also end a sentence."""
    if dot < 1 or not rx(r"\p{L}").search(t) or (len(t.replace(".", "")) > 9):
        return None
    letters = rx(r"[.\p{M}]").sub("", t)
    without = max(0, all_ - dot)
    score = _llr(dot, dot + without, dots / max(tokens, 1), 0.99) * math.exp(-len(letters)) * (t.count(".") + 1) * len(letters) ** -without
    expected = finals / max(dots, 1)
    # Sentence-final words end blocks as often as any period does; abbreviations hardly ever do, or small letters follow.
    rare_end = final / dot < 0.25 * expected and _llr(final, dot, expected, max(final / dot, 1e-6)) > 3.84
    if len(letters) <= 6 and (small >= 0.5 * dot and without <= dot or small >= 0.8 * dot and dot >= 3):
        score = max(score, 1.0)
    elif not rare_end and small / dot < 0.1 and "." not in t:
        return None
    elif rare_end and (without <= 0.05 * dot or (final <= 0.02 * dot and len(letters) <= 5)):
        score = max(score, 1.0)
    return None if score < 0.3 else final > 0.02 * dot or (dot < 5 and small < dot)


class Splitter:
    def __init__(self, model: Model):
        self.model = model

    def ends(self, text: str | None, lang: str | None) -> list[int]:
        out: list[int] = []
        for a, b, whole in blocks(text or ""):
            block = text[a:b]
            if not block.strip():
                continue
            if not whole:
                out += [a + e for e in self._inner(block, language(block, lang))]
            last = a + len(block.rstrip())
            if not out or out[-1] < last:
                out.append(last)
        return out

    def _inner(self, block: str, lang: str) -> Iterator[int]:
        spans = _quoted(block)
        at = 0
        marks = [(m.start(), m.end(), m.group()) for m in _MARK.finditer(block)]
        if lang == "th" or rx(r"\p{Thai}").search(block):
            marks = sorted(marks + [(m.start(), m.start(), " ") for m in _THAI.finditer(block)])
        for start, end, mark in marks:
            while at < len(spans) and spans[at][1] < start:
                at += 1
            inside = at < len(spans) and spans[at][0] < start <= spans[at][1]
            if inside:
                close = spans[at][1]
                between = block[end:close]
                if between.strip():
                    continue  # more follows in the quote
                if mark == "." and (lang, _before(block, start)) in self.model.abbreviations:
                    continue
                end = close + 1
                while end < len(block) and block[end] in CLOSING:
                    end += 1
                if self._continues(block, end, lang, speech=True):
                    continue
                yield end
                continue
            while end < len(block) and block[end] in CLOSING and block[end] not in _QUOTES:
                end += 1
            if end < len(block) and block[end : end + 2].strip() and block[end] in '"' and any(b == end for _, b in spans):
                end += 1
            if mark == " " or any(c in ALWAYS for c in mark) or mark == "|":
                yield end
                continue
            if self._splits(block, start, end, mark, lang):
                yield end

    def _continues(self, block: str, end: int, lang: str, speech: bool) -> bool:
        rest = block[end:].lstrip()
        if not rest:
            return False
        c = rest[0]
        if c in ",;:—–-" or c.islower():
            return True
        if c.isupper() or c.isdigit():
            return False
        word = _NEXT.match(block, end)
        return speech and (not word or (lang, word.group(1).lower()) not in self.model.starters)

    def _splits(self, block: str, start: int, end: int, mark: str, lang: str) -> bool:
        rest = block[end : end + 1]
        nxt = _NEXT.match(block, end)
        word = nxt.group(1) if nxt else ""
        starter = (lang, word.lower()) in self.model.starters
        if rest and not rest.isspace():
            if mark == "." and rest.isupper() and rx(r"[\p{Ll}\p{M}\d)]{3}$").search(block[max(0, start - 6) : start]) and rx(r"\p{Lu}\p{Ll}*\.?(?:\s|$)").match(block[end : end + 40]):
                return starter or len(word) > 1
            return mark != "." and mark[-1] in "!?" and rest.isupper()
        if not block[end:].strip():
            return True
        if not word:
            return mark[-1] in "!?."
        if mark[-1] == "…" or ".." in mark:
            return word[0].isupper() and starter
        if mark[-1] in "!?" or mark[0] in "!?":
            return not word[0].islower() or starter
        t = _before(block, start)
        if _is_number(t):
            single = rx(r"\d{1,2}").fullmatch(t)
            return not (single and (word.lower() in MONTHS or ((lang, word.lower()) in self.model.ordinals and not starter)))
        known = self.model.abbreviations.get((lang, t))
        if known is None and rx(r"\p{L}").fullmatch(t):
            return starter and word[0].isupper() and not rx(r"\p{Lu}$").search(block[:start])
        if known is None and rx(r"[ivx]{1,4}").fullmatch(t) and word[0].islower():
            return False
        if known is None:
            return not (word[0].islower() and len(t) <= 3 and not starter and not t.isdigit())
        if not starter and (lang, t, word.lower()) in self.model.collocations:
            return False
        return known and (word[0].isupper() or (starter and not word[0].islower()))


#: What may reach the driver; the statistics themselves stay distributed.
MAX_LEARNED = 300_000


def statistics(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, word, n) over all documents, summed in every worker before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(k[0], k[1], k[2], n) for k, n in counts.items() if n]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.int64())], names=["lang", "kind", "word", "n"])

        for batch in batches:
            for t, lg in zip(batch.column(0), batch.column(1)):
                count(t.as_py(), lg.as_py(), counts)
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    return spread(documents.select(text, lang)).mapInArrow(run, "lang string, kind string, word string, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def _learned(judged: DataFrame, what: str) -> list[Row]:
    """All rows of what passed its test; more than the driver may hold is an error."""
    rows = judged.limit(MAX_LEARNED + 1).collect()
    if len(rows) > MAX_LEARNED:
        raise ValueError(f"too many {what}: the texts are no sentences of known scripts")
    return rows


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all documents."""
    counted = durable(statistics(documents, text, lang))
    wide = counted.groupBy("lang", "word").pivot("kind", ["all", "dot", "final", "small", "start", "ordinal", "dots", "finals", "starts", "blocks"]).sum("n").na.fill(0)
    totals = {r["lang"]: r.asDict() for r in wide.groupBy("lang").agg(F.sum("all").alias("tokens"), F.sum("ordinal").alias("ordinals"), F.max(F.when(F.col("word") == "", F.col("dots"))).alias("dots"), F.max(F.when(F.col("word") == "", F.col("finals"))).alias("finals"), F.max(F.when(F.col("word") == "", F.col("starts"))).alias("starts")).collect()}
    # A starter follows sentence ends more often than chance; a type with a period is worth testing if it has one often.
    kept = wide.where("word <> '' AND ((dot > 0 AND dot >= 0.5 * greatest(`all` - dot, 0) AND length(word) <= 12) OR (start >= 3 AND start >= 0.15 * `all`) OR (ordinal >= 3 AND ordinal >= 0.2 * `all`))")

    # Codes and amounts that end sentences make the candidates as many as the documents: they are judged where they are.
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                lg, w, total = r["lang"], r["word"], totals[r["lang"]]
                if r["dot"]:
                    ends = is_abbreviation(w, r["all"], r["dot"], r["final"], r["small"], total["dots"] or 1, total["finals"] or 0, total["tokens"] or 1)
                    if ends is not None:
                        out.append((lg, "ends" if ends else "goes on", w))
                share = (total["starts"] or 0) / max(total["tokens"] or 1, 1)
                if r["start"] >= 3 and r["start"] > share * r["all"] and _llr(r["start"], max(r["all"], r["start"]), share, r["start"] / max(r["all"], r["start"])) > 30:
                    out.append((lg, "starter", w))
                if r["ordinal"] >= 3 and r["ordinal"] >= 0.2 * r["all"] and collocation_ratio(r["ordinal"], total["ordinals"], r["all"], total["tokens"]) >= COLLOCATED:
                    out.append((lg, "ordinal", w))
            yield pd.DataFrame(out, columns=["lang", "kind", "word"])

    model = Model()
    for lg, kind, w in _learned(kept.mapInPandas(judge, "lang string, kind string, word string"), "sentence types"):
        if kind == "starter":
            model.starters.add((lg, w))
        elif kind == "ordinal":
            model.ordinals.add((lg, w))
        else:
            model.abbreviations[lg, w] = kind == "ends"
    # Words that follow an abbreviation that may end a sentence as well; the pairs of other types decide nothing.
    open_ = [(lg, t) for (lg, t), ends in model.abbreviations.items() if ends]
    if open_:
        types = documents.sparkSession.createDataFrame(open_, "lang string, t string")
        pairs = counted.where("kind = 'pair' AND n >= 3").select("lang", F.substring_index("word", " ", 1).alias("t"), F.substring_index("word", " ", -1).alias("next"), "n").join(F.broadcast(types), ["lang", "t"])
        pairs = pairs.join(wide.select("lang", F.col("word").alias("t"), F.col("dot").alias("first")), ["lang", "t"]).join(wide.select("lang", F.col("word").alias("next"), F.col("all").alias("second"), "start"), ["lang", "next"])

        # It must follow the type more often than chance, and also more often than it follows the ends of sentences.
        def collocated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for r in f.to_dict("records"):
                    total, share = totals[r["lang"]], r["n"] / r["first"]
                    begins = r["start"] / max(total["starts"] or 1, 1)
                    if collocation_ratio(r["n"], r["first"], r["second"], total["tokens"] or 1) >= COLLOCATED and share > begins and _llr(r["n"], r["first"], begins, share) >= COLLOCATED:
                        out.append((r["lang"], r["t"], r["next"]))
                yield pd.DataFrame(out, columns=["lang", "t", "next"])

        model.collocations.update(map(tuple, _learned(pairs.mapInPandas(collocated, "lang string, t string, next string"), "pairs of abbreviations and words")))
    return model


def units(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, end_pos BIGINT): one row per unit; end_pos counts code points to the unit's last character."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).where("t IS NOT NULL")
    rows = spread(rows, None, "k").dropDuplicates(["k"])
    model = learn(rows, "t", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, ends = [], []
                part = batch.slice(at, 256)
                for k, t, g in zip(*part.columns):
                    found = split.ends(t.as_py(), g.as_py())
                    keys += [k.as_py()] * len(found)
                    ends += found
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), pa.array(ends, pa.int64())], names=[key, "end_pos"])

    return rows.mapInArrow(run, f"`{key}` {kind}, end_pos bigint").distinct()
