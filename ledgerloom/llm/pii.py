"""Personal information inside free text.

Method: high-recall generators propose overlapping spans of every type; boosted trees judge each span by its format and
its context (the words before and after, what the span itself looks like, whether it could be longer); thresholds are
calibrated on held-out rows. Accepted spans don't overlap: the more probable one wins, then the longer.

The trees are fitted on the driver on at most SAMPLE spans of generated sentences with invented values. Which words are
ordinary language is counted over all texts.

Defined results: null and empty texts have no spans; running headers and page numbers between the lines of a value are
left out of it, a line break is one space; repeated rows and repeated values give one row.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.durable import durable
from ledgerloom.llm.boost import Boosted, calibrated_threshold
from ledgerloom.llm.repair import furniture_model, furniture_of
from ledgerloom.llm.patterns import rx
from ledgerloom.sources.tables import spread

TYPES = ("email", "phone", "id_number", "address", "person")
SAMPLE = 8000
#: Titles and words of kinship before names, words of organisations, and words that begin an address.
TITLES = frozenset("mr mrs ms miss dr shri sri smt kum kumari master late prof md mbbs".split())
ORGANISATION = frozenset("hospital hospitals clinic diagnostics diagnostic nursing home institute centre center research charitable trust multispeciality dental eye heart children health insurance assurance general mutual life limited ltd pvt desk section department bank".split())
BUILT = frozenset("house plot flat building complex apartments apartment arcade tower towers plaza chambers chamber centre heights road rd street st lane ln path pth marg mg nagar vihar layout colony enclave room ward no".split())
_GAP = r"[ ]?"
GENERATORS = {
    "email": re.compile(r"[\p{L}\p{N}][\w.+-]*" + _GAP + r"(?:@|\[at\]|\(at\)|\{at\})" + _GAP + r"[\p{L}\p{N}-]+(?:" + _GAP + r"(?:\.(?=[\p{L}\p{N}])|\[dot\]|\(dot\)|\{dot\})" + _GAP + r"[\p{L}\p{N}-]+)+", re.I),
    "phone": re.compile(r"(?<![\p{L}\p{N}/,.+-])(?:\+\d{1,3}[ .-]?|00\d{2}[ .-]?)?(?:\(0?\d{2,5}\)[ .-]?)?\d(?:[ .-]?\d){6,13}(?![\p{L}\p{N}/]|[.,]\d|-\d)"),
    "id_number": re.compile(r"(?<![\p{L}\p{N}/.-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}|\p{L}{5}[ -]?\d{4}[ -]?\p{L}|\p{L}{3}[ /-]?\d{7}|\p{L}[ -]?\d{7})(?![\p{L}\p{N}]|-\d)"),
    "address": re.compile(
        r"(?<![\p{L}\p{N}/-])(?:(?:[Hh]ouse|HOUSE|[Hh]\.?|[Pp]lot|PLOT|[Ff]lat|FLAT|[Dd]oor|DOOR|[Uu]nit|UNIT|[Ss]hop|SHOP|[Rr]oom|ROOM|[Gg]ala|GALA|[Oo]ffice|OFFICE)[ ]?(?:[Nn][Oo]\b)?\.?[ ]?[#-]?[ ]?\d[\w/-]*|\d{1,4}(?:/\d{1,4})?[/-]?[A-Za-z]?)"
        r"(?:[ ]?,[ ]?(?:\p{Lu}[\p{L}\p{N}'-]*\.?(?=[ ]?,)|\p{Lu}[\p{L}\p{N}'-]*)(?:[ ](?:\p{Lu}[\p{L}\p{N}'-]*\.?(?=[ ]?,)|\p{Lu}[\p{L}\p{N}'-]*)){0,3}){1,7}(?:[ ]?[,-]?[ ]?(?:PIN[ ]?:?[ ]?)?\d{3}[ ]?\d{3}(?!\d))?"
    ),
}
_AT = re.compile(r"@|\[at\]|\(at\)|\{at\}", re.I)
_NAME = re.compile(r"(?:\p{Lu}\.(?:\s?\p{Lu}\.)*|\p{Lu}[\p{L}'’-]+|\p{Lu}(?=\s\p{Lu}))")
_WORDS = re.compile(r"[\p{L}\p{N}]+(?:[/'’-][\p{L}\p{N}-]+)*|[^\s\p{L}\p{N}]")


def name_spans(text: str, ordinary: frozenset[str]) -> Iterator[tuple[int, int]]:
    """All runs of two to four capitalised words or initials, with every part of them; no run goes over a word of ordinary language."""
    tokens = [(m.start(), m.end()) for m in _NAME.finditer(text) if (w := m.group().lower()) not in ordinary and w not in ORGANISATION and w not in TITLES]
    for i, (a, _) in enumerate(tokens):
        last = a
        for k in range(i, min(i + 4, len(tokens))):
            s, e = tokens[k]
            if k > i and text[last:s] not in (" ", ""):
                break
            last = e
            if k > i and e - a >= 4 and rx(r"\p{L}{3}").search(text[a:e]):
                yield a, e


def candidates(text: str, ordinary: frozenset[str] = frozenset()) -> Iterator[tuple[str, int, int]]:
    end = 0
    for anchor in _AT.finditer(text):  # an address lies within the paragraph of its sign
        if anchor.start() >= end:
            start, end = text.rfind("\n", 0, anchor.start()) + 1, text.find("\n", anchor.end())
            end = end if end >= 0 else len(text)
            for m in GENERATORS["email"].finditer(text, start, end):
                yield "email", m.start(), m.end()
    for kind in ("phone", "id_number", "address"):
        for m in GENERATORS[kind].finditer(text, overlapped=kind in ("phone",)):
            yield kind, m.start(), m.end()
    for a, b in name_spans(text, ordinary):
        yield "person", a, b


#: The context words that the trees may use, each before and after a span.
CUES = (
    "no policy claim receipt order lot utr bill transfer regn registration batch invoice aadhaar uid pan tax id proof card identity voter passport number mobile tel phone call ring contact wtsapp whatsapp mail e-mail email write from to on at of by for and is was in with "
    "dr mr mrs ms smt shri kum sd/- w/o s/o d/o c/o insured patient name nominee witness maid caller prepared checked consultant treating collected belong address resides permanent correspondence goes copy declare i signed gave brought opened confirmed attached file brother after six callback the hospital clinic tariff applies listed during room ward plot house flat h attention driver sister son wife father guardian"
).split()
_CUE = {w: i for i, w in enumerate(CUES)}
_MARKS = {".": 0, ",": 1, ":": 2, "(": 3, ")": 4, ";": 5, "/": 6, "-": 7, "\n": 8}


def features(text: str, kind: str, a: int, b: int, ordinary: frozenset[str]) -> list[float]:
    span = text[a:b]
    before = _WORDS.findall(text[max(0, a - 48) : a])[-4:]
    after = _WORDS.findall(text[b : b + 40])[:3]
    x = [float(kind == t) for t in TYPES]
    digits = rx(r"\D").sub("", span)
    words = rx(r"\p{L}+").findall(span)
    low = [w.lower() for w in words]
    line_start = not text[max(0, a - 1) : a].strip(" ") or text[a - 1] == "\n"
    x += [
        len(digits), span.startswith("+"), span.startswith("00"), span.startswith("0"), "(" in span and span.index("(") < 3, "-" in span, " " in span, "." in span,
        bool(rx(r"\d{4}([ -]?)\d{4}[ -]?\d{4}").fullmatch(span)), bool(rx(r"\d{10}").fullmatch(span)), bool(rx(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[.-]\d{1,2}[.-]\d{2,4}").fullmatch(span)),
        len(rx(r"\d+").findall(span)), len(rx(r"\d+").findall(span)[0]) if digits else 0, len(rx(r"\d+").findall(span)[-1]) if digits else 0,
        len(words), sum(len(w) == 1 for w in words), sum(w in TITLES for w in low), sum(w in ORGANISATION for w in low), sum(w in BUILT for w in low), sum(w in ordinary and len(w) > 1 for w in low), span.isupper(),
        span.count(","), bool(rx(r"\d{3}\s?\d{3}$").search(span)), bool(rx(r"[A-Za-z]{5}").match(span)), bool(rx(r"swp", re.I).match(span)), min(len(span), 120),
        line_start, bool(rx(r"[ ]?\p{Lu}[\p{L}.]").match(text[b : b + 3])), bool(rx(r"\p{Lu}[\p{L}]*\.? ?$").search(text[max(0, a - 14) : a])), bool(rx(r"\p{Lu}\.\s?$").search(text[max(0, a - 4) : a])),
        bool(after and after[0].lower() in ORGANISATION), bool(before and before[-1].lower() in ORGANISATION), bool(before and before[-1].lower() in TITLES or len(before) > 1 and before[-1] == "." and before[-2].lower() in TITLES),
        bool(rx(r"\s?[-,]?\s?\d{3}\s?\d{3}").match(text[b : b + 10])), b - a >= 4 and bool(rx(r"\p{L}").match(text[b : b + 1])), bool(rx(r"(?i)rs\.?\s?$|inr\s?$|₹\s?$").search(text[max(0, a - 5) : a])), bool(rx(r"[\d.,/]").match(text[b : b + 1])),
        bool(rx(r"[\d)][ .-]?$").search(text[max(0, a - 2) : a])), bool(rx(r"[ .-]?\d").match(text[b : b + 2])), bool(rx(r"[ ]?\(").match(text[max(0, a - 8) : a])),
        bool(rx(r"\d{1,8}\.\d{2}").fullmatch(span)), bool(words) and len(words[-1]) == 1, bool(rx(r"\p{L}").match(span[:1])) and len(words) == 1,
    ]
    near = [w.lower() for w in before]
    cue = np.zeros(len(CUES) * 3 + len(_MARKS) * 2)
    plain = [w for w in near if w in _CUE or rx(r"\w").match(w)]
    if plain and plain[-1] in _CUE:
        cue[_CUE[plain[-1]]] = 1
    for w in plain[-3:-1]:
        if w in _CUE:
            cue[len(CUES) + _CUE[w]] = 1
    for w in (w.lower() for w in after[:2]):
        if w in _CUE:
            cue[2 * len(CUES) + _CUE[w]] = 1
    base = 3 * len(CUES)
    if text[max(0, a - 1) : a] == "\n" or a == 0:
        cue[base + _MARKS["\n"]] = 1
    elif before and before[-1] in _MARKS:
        cue[base + _MARKS[before[-1]]] = 1
    if text[b : b + 1] == "\n" or b == len(text):
        cue[base + len(_MARKS) + _MARKS["\n"]] = 1
    elif after and after[0] in _MARKS:
        cue[base + len(_MARKS) + _MARKS[after[0]]] = 1
    return [float(v) for v in x] + cue.tolist()


# --- generated sentences ---------------------------------------------------------------------------------------

#: Sentence forms for training; {N} person, {E} e-mail, {P} phone, {A} address, {Z} 12-figure number, {T} tax id, {V} voter card, {Q} passport.
WITH = (
    "Please get in touch with {N} on {P} about the survey.", "Reach {N} at {P}.", "Phone {P} / {P}", "Phone {P} or {P}", "Call {P}, mail {E}", "Cell {P}, write {E}", "The drawing was approved by Dr. {N}.", "I, {N}, hereby state that this is correct.", "I, {N}, confirm it.",
    "Tenant: {N} Unit {d}", "Member: {N} Seat {d}", "Name of Applicant: {N}", "Name of Student: {N}", "Supervising engineer: Dr. {N}", "Lecturer: Prof. {N}", "Dr. {N} and Dr. {N} wrote the review.", "The guest {N} came with a friend.", "The pupil {N} was driven home by a neighbour.",
    "Sd/- {N}", "Sgd. {N}", "The parcel was picked up by {N} on Friday.", "The keys were taken by {N} at noon.", "Written by {N}, reviewed by {N}.", "Home address of Mrs. {N} is {A}.", "Present address of Mr. {N}: {A}.", "Letters are sent to {N}, {A}.", "Parcels are for {N}, {A}.", "The neighbour {N} of {A} saw the van.", "The tenant {N} of {A} agreed.", "The cook, {N}, answered the bell at {A}.", "The gardener, {N}, works at {A}.",
    "D/o Shri {N}, {A}", "H/o Smt. {N}, {A}", "The owner lives at {A}.", "The singer stays at {A}.", "Address: {A}", "Residence: {A}", "Kindly phone {N} before noon: {P}.", "Try {N} in the evening: {P}.", "The visitor, Mr. {N}, left {P} as number.", "The tailor, Mrs. {N}, dialled from {P} twice.", "In need: {N} (sister) {P}", "Next of kin: {N} (uncle) {P}", "Mobile: {P}", "Cell: {P}", "Landline {P}", "Tel. {P}", "Tel: {P}; {P}", "Tel. {P} or {P}", "Contact {N} for the key.", "Contact: {N}, {P}", "To rent, contact {N} on {P} by noon.", "Nominee: {N}", "Nominee {N} has signed.", "Her nominee {N}, tax no. {T}.",
    "Kindly mail {E} or ring {P}.", "Answer to {E} or dial {P}.", "She replied from {E} and never from {E}.", "It came from {E} and also from {E}.", "E-mail: {E}", "Mail id: {E}", "cc: {N}; {E}", "To: {N}; {E}", "National id {Z} of {N} is enclosed.", "Number {Z} of {N} is on file.", "UID {Z}", "Id: {Z}", "Id: {T}", "Id: {Q}", "Id: {V}", "Document: {Z}", "Document: {T}", "Document: {V}", "The card {Z} was inspected.", "The card {V} was inspected.", "The card {T} was inspected.", "The card {Q} was inspected.", "The paper {Q} is valid.", "The paper {V} is valid.", "The paper {T} is valid.",
    "Tax number {T} is not that of {N}.", "Heir {N}, PAN {T}.", "Guarantor {N}, tax no. {T}.", "Voter id {V} was noted at the gate.", "Elector {V} was noted.", "Passport {Q} was scanned.", "Passport no. {Q} is old.", "Son of {N} of {A}", "S/o {N} from {A}", "For {N}, phone {P}.", "Ask {N}, cell {P}.", "My mother {N} will answer on {P}.", "My cousin {N} has the number {P}.", "The pilot {N} is living at {A}.", "Smt. {N} sang at the fair.", "Approved by {N}.", "Entry was granted by Kum. {N}.", "Shri {N} is my teacher.", "Seen by Dr. {N}, M.D., in the morning.", "Painted by {N}.",
)
WITHOUT = (
    "The photograph of 12.03.2024 did not show any damage.", "Papers worth ₹ {6}.{2} are still awaited.", "It was {5}.{2} in all.", "Sum {6}.{2}", "Grand sum ₹{6}.{2}", "A transfer of ₹{6} is planned.", "The price of ₹ {5}.{2} was agreed.", "Deposit ₹ {6}", "The ticket no. {6}-B was opened.", "Schedule Part B", "Appendix Part C",
    "Contract SWP{7} is valid.", "Contract SWP{8} was renewed in time.", "Ticket CL{8} follows ticket CL{6}.", "Batch {6} of the paint was used up.", "Order {5}-{6} has been shipped.", "Regn. No. {6} of the school lapsed.", "The voucher no. {0} was enclosed.", "UTR {1} has arrived.", "The rates of {H}, {C} are old.", "The house {H} is known.", "The letter was passed to the head of {C} Health.", "The note was sent to the clerk of {I}.",
    "Rent : Rs. {6}", "Total INR {5}.00", "Invoices were sent on 2024-03-1{x} for Rs. {5}.", "The weather stayed within usual limits all week.", "Lodging .... Rs. {5}", "Books and Pens : INR {6}", "Bus Hire Town Rs.{5}", "The Branch Manager of {C} asked for the plan.", "Music lessons were given.", "Our own team has looked at the rates of {H} again.",
    "The contract SWP{8} ran for the whole of the year.", "The theft was reported at the next police post in {C}.", "Bill no. {5} of {H} dated 12.03.2024.", "Account {1} was closed.", "The request was filed under number {6} and sorted.", "The Committee may ask for more papers.", "Roof Repair Work : Rs. {6}", "CCTV Wiring INR {5}", "Concert Hall .... Rs {6}", "Food Costs INR {5}", "Cleaning Costs Rs. {5}", "K-Band Filter PA : Rs {5}", "A look at the garden showed stones.", "Lot {0} of the cement was returned.", "Invoice {1} is settled.", "The leaflet names K80.2 as the first entry.", "The trip to {H} took 3 hours.", "The board sent back the plan on the trip to {H}.", "The second office has handed the whole folder to {I}.", "The auditor liked the rates of {H} very much.", "The house {H} is shut.", "The note was carried to the head clerk of {I}.", "{H} has answered.", "{I} has agreed.", "The search at {C} is over.", "The branch at {C} shut at 5.", "A sum of Rs {5} was taken at the front desk.",
)


def _filled(form: str, draw: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    pick = draw.choice
    word = lambda n: "".join(pick("bdghklmnprstv") + pick("aeiou") for _ in range(n)).title() + pick(("", "", "r", "n", "l"))
    num = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))
    first = "Aarav Aditi Ajay Amrita Anand Asha Bharat Chandra Deepak Divya Farida Ganesh Harish Imran Jyoti Kavita Lalita Mohan Nandini Omkar Padma Rajendra Sadashiv Tarun Usha Vijay Yamuna".split()

    def person() -> str:
        g, m, s = pick(first), pick(first), word(3)
        t = pick((f"{g} {s}", f"{g} {m} {s}", f"{g[0]}. {s}", f"{g[0]}.{m[0]}. {s}", f"{g} {m[0]}. {s}", f"{s} {g} {m}", f"{s} {g}", f"{g} {s}"))
        return t.upper() if draw.random() < 0.25 else t

    def address() -> str:
        n = draw.randrange(1, 400)
        start = pick((f"House No. {n}", f"Plot No. {n}", f"Flat {n % 30 + 1}", f"{n}/{pick('ABCD')}", f"H.No. {n}-{n % 9 + 1}"))
        parts = [start, f"{word(3)} {pick(('House', 'Complex', 'Arcade', 'Tower', 'Centre', 'Heights', 'Chambers', 'Apartments', 'Plaza', 'Building'))}", f"{word(3)} {pick(('Road', 'Rd', 'Street', 'Lane', 'Ln', 'Marg', 'Mg.', 'Path', 'Pth'))}", pick((f"{word(3)} {pick(('Nagar', 'Vihar', 'Layout', 'Colony', 'Enclave'))}", word(3) + pick(("nagar", "puram", "wadi", "peth"))))]
        if draw.random() < 0.35:
            del parts[draw.randrange(1, 3)]
        t = ", ".join(parts) + ", " + word(2) + pick(("gaon", "pur", "abad", "kot", "giri", "palli", "wada", "nagar"))
        t += pick(("", f"-{num(6)}", f" {num(6)}", f" - {num(6)}")) if draw.random() < 0.8 else ""
        return t.upper() if draw.random() < 0.2 else t

    def email() -> str:
        user = pick((f"{pick(first)}.{word(3)}", f"{word(3)}{draw.randrange(99)}", f"{pick(first)}_{word(2)}", f"{word(3)}+claims", f"{word(3)}.{pick('abcdef')}")).lower()
        site = pick(("net.bira.example", "mail.invalid", "inbox.test", "post-box.example", "family.test"))
        style = draw.randrange(5)
        t = user + ("@", " @ ", "[at]", " (at) ", "@")[style] + (site if style != 2 else site.replace(".", "[dot]"))
        return t.upper() if draw.random() < 0.1 else t

    def phone() -> str:
        d = pick("123456") + num(9)
        return pick((d, f"+91 {d}", f"+91{d}", f"0091{d}", f"+91-{d[:5]}-{d[5:]}", f"{d[:5]} {d[5:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:2]}-{d[:8]}", f"(0{d[:3]}) {d[3:6]} {d[6:]}"))

    house = lambda: f"{word(4)} {pick(('Hospital', 'Eye Hospital', 'Dental Clinic', 'Heart Institute', 'Diagnostics', 'Nursing Home', 'Hospital and Research Centre', 'Multispeciality Hospital'))}"
    z = lambda: (lambda d: pick((d, f"{d[:4]} {d[4:8]} {d[8:]}", f"{d[:4]}-{d[4:8]}-{d[8:]}", f"{d[:4]} {d[4:]}")))(num(12))
    letters = lambda n: "".join(pick("ABCDEFGHKLMNPQRSTVXYZ") for _ in range(n))
    tax = lambda: (lambda a, b, c: pick((a + b + c, f"{a} {b} {c}", (a + b + c).lower())))(letters(5), num(4), letters(1))
    voter = lambda: letters(3) + pick(("", " ", "/")) + num(7)
    passport = lambda: letters(1) + pick(("", " ", "-")) + num(7)
    makers = {"N": ("person", person), "E": ("email", email), "P": ("phone", phone), "A": ("address", address), "Z": ("id_number", z), "T": ("id_number", tax), "V": ("id_number", voter), "Q": ("id_number", passport)}
    out, spans = "", []
    for piece in rx(r"(\{\w\})").split(form):
        m = rx(r"\{(\w)\}").fullmatch(piece)
        if not m:
            out += piece
        elif (c := m.group(1)) in makers:
            kind, make = makers[c]
            v = make()
            spans.append((kind, len(out), len(out) + len(v)))
            out += v
        else:
            out += {"H": house, "I": lambda: f"{word(3)} {pick(('Health', 'Assurance', 'General', 'Mutual Health', 'Life & Health', 'Insurance'))}", "C": lambda: word(3), "0": lambda: num(10), "1": lambda: num(11), "d": lambda: str(draw.randrange(30)), "x": lambda: str(draw.randrange(10))}.get(c, lambda c=c: num(int(c)) if c.isdigit() else c)()
    return out, spans


@lru_cache(1)
def span_model(seed: int = 3) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and a threshold for each type, from generated texts: two thirds fit, one third calibrates."""
    draw = random.Random(seed)
    ordinary = frozenset(w.lower() for form in WITH + WITHOUT for w in rx(r"\b[a-z]{2,}\b").findall(form))
    rows: list[list[float]] = []
    label: list[int] = []
    kinds: list[int] = []
    while len(rows) < SAMPLE:
        text, truth = "", set()
        for _ in range(draw.randrange(3, 8)):
            t, spans = _filled(draw.choice(WITH if draw.random() < 0.55 else WITHOUT), draw)
            truth |= {(k, a + len(text), b + len(text)) for k, a, b in spans}
            text += t + (draw.choice((" ", " ", "\n")) if t.endswith(".") else "\n")
        for kind, a, b in candidates(text, ordinary):
            rows.append(features(text, kind, a, b, ordinary))
            label.append((kind, a, b) in truth)
            kinds.append(TYPES.index(kind))
    x, y, k = np.array(rows[:SAMPLE]), np.array(label[:SAMPLE]), np.array(kinds[:SAMPLE])
    cut = SAMPLE * 2 // 3
    model = Boosted(trees=50, depth=4, bins=12).fit(x[:cut], y[:cut])
    p = model.probability(x[cut:])
    limits = tuple(min(0.5, max(0.15, calibrated_threshold(p[k[cut:] == i], y[cut:][k[cut:] == i]))) for i in range(len(TYPES)))
    return model, limits


#: Where a flattened text comes from: (start in it, start in the original, length) of each line, in order.
Pieces = list[tuple[int, int, int]]


def flattened(lines: list[str], off: list[bool]) -> tuple[str, Pieces]:
    """The text without furniture: wrapped lines joined by one space, ends of paragraphs kept as breaks.

    A line ends a paragraph if it is followed by a blank one, or if the next line's first word would have fitted on it.
    """
    width = max((len(t.strip()) for t, o in zip(lines, off) if not o), default=0)
    out: list[str] = []
    pieces: Pieces = []
    size = at = 0
    last, end = "", "\n"  # the line before, and what stands last
    for line, o in zip(lines, off):
        t = line.strip()
        if not o and not t and end != "\n":
            out.append("\n")
            size, end = size + 1, "\n"
        elif not o and t:
            if end != "\n":
                fits = len(last) + 1 + len(t.split()[0]) <= width - 3 and not last.endswith(("-", "‐", "‑", "–", "¬", ","))
                out.append("\n" if fits else " ")
                size += 1
            pieces.append((size, at + len(line) - len(line.lstrip()), len(t)))
            out.append(t)
            size, last, end = size + len(t), t, t[-1]
        at += len(line) + 1
    return "".join(out), pieces


def replaced(text: str, pieces: Pieces, spans: list[tuple[str, int, int]]) -> str:
    """The original text with a placeholder at the place of each span of its flattened form; all other signs stay.

    Of a value over several lines the first part becomes the placeholder and the others go; what lies between the lines
    (breaks, a page's furniture) stays.
    """
    starts = [p[0] for p in pieces]
    cuts = []
    for kind, a, b in spans:
        first = True
        for s, origin, n in pieces[max(0, bisect_right(starts, a) - 1) :]:
            if s >= b:
                break
            if min(b, s + n) > max(a, s):
                cuts.append((origin + max(a, s) - s, origin + min(b, s + n) - s, f"[{kind.upper()}]" if first else ""))
                first = False
    for a, b, put in sorted(cuts, reverse=True):
        text = text[:a] + put + text[b:]
    return text


def _is_organisation(text: str, a: int, b: int) -> bool:
    """An exact check on what the trees accept as a person: hospitals and insurers are not."""
    after = rx(r"\s(\p{L}+)").match(text[b : b + 24])
    return any(w.lower() in ORGANISATION for w in rx(r"\p{L}+").findall(text[a:b])) or bool(after and after.group(1)[0].isupper() and after.group(1).lower() in ORGANISATION)


def spans_of(texts: list[str], model: Boosted, limits: tuple[float, ...], ordinary: frozenset[str]) -> list[list[tuple[str, int, int]]]:
    """The accepted spans of each flattened text, none overlapping another; the trees run over all texts together."""
    found = [(n, *c) for n, text in enumerate(texts) for c in dict.fromkeys(candidates(text, ordinary))]
    p = model.probability(np.array([features(texts[n], k, a, b, ordinary) for n, k, a, b in found])) if found else []
    kept = sorted(((n, -q, a - b, k, a, b) for q, (n, k, a, b) in zip(p, found) if q >= limits[TYPES.index(k)]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for n, _, _, k, a, b in kept:
        if k == "person" and _is_organisation(texts[n], a, b):
            continue
        if all(b <= s or a >= e for _, s, e in out[n]):
            out[n].append((k, a, b))
    return [sorted(x, key=lambda t: t[1]) for x in out]


#: The words of ordinary language that are sent to the workers; more than this isn't language.
MAX_WORDS = 500_000


def ordinary_words(texts: DataFrame) -> frozenset[str]:
    """Words met in small letters at least three times over all texts, and as often as capitalised ones at least a fifth of the time."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9@._+-])([A-Za-z]{2,})(?![A-Za-z0-9@_+\[]|[.-][A-Za-z]| ?[\[(](?:at|dot))"), F.lit(1))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.lower("w")).alias("low"), F.count(F.lit(1)).alias("n")).where("low >= 3 AND low >= 0.2 * n")
    rows = counted.select("word").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError("too many distinct words")
    return frozenset(r[0] for r in rows)


def _scan(scans: DataFrame, output: str, schema: str) -> DataFrame:
    texts = spread(scans.select("scan_id", F.col("raw_text_preview").alias("text")).where("scan_id IS NOT NULL AND text IS NOT NULL AND text <> ''"), None, "scan_id").dropDuplicates(["scan_id"])
    texts = durable(texts)
    ordinary = ordinary_words(texts)
    pages = furniture_model()
    model, limits = span_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 200):
                out = []
                part = f.iloc[at : at + 200]
                lines = [t.split("\n") for t in part["text"]]
                flats = [flattened(x, off) for x, off in zip(lines, furniture_of(lines, pages))]
                for scan, text, (flat, pieces), spans in zip(part["scan_id"], part["text"], flats, spans_of([f for f, _ in flats], model, limits, ordinary)):
                    if output == "spans":
                        out += [(scan, k, rx(r"\s*\n\s*").sub(" ", flat[a:b])) for k, a, b in spans]
                    else:
                        out.append((scan, replaced(text, pieces, spans)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return texts.mapInPandas(run, schema)


def personal(scans: DataFrame) -> DataFrame:
    """(scan_id, pii_type, pii_text)."""
    return _scan(scans, "spans", "scan_id bigint, pii_type string, pii_text string").distinct()


def redacted(scans: DataFrame) -> DataFrame:
    """(scan_id, text): the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [PERSON] in place of the values, else unchanged."""
    return _scan(scans, "text", "scan_id bigint, text string")
