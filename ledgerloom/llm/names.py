"""Variant spellings of persons and organisations.

Method: MinHash banding over padded q-grams, with the number of bands read off the collision curve for the wanted
recall; Monge-Elkan similarity verifies candidates; star clustering groups them.

Two mentions can be one only if something besides the name agrees (date of birth or policy of persons, city or PIN of
organisations), so a band key is formed together with such evidence and a bucket holds candidates that share both.
Mentions alike in every compared part are one node, whatever their number.

Defined results: null, empty or letterless names link to nothing; a mention without evidence links to nothing; repeated
mentions count once; ties go to the lesser mention_id; two names that are both common are never spellings of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.durable import durable
from ledgerloom.llm.lsh import MinHasher, bands_for, components, least_slice, links, matched, qgrams, slice_of, slices_for, star_clusters
from ledgerloom.llm.patterns import rx
from ledgerloom.sources.tables import spread

#: The least Jaccard similarity of q-grams at which a pair should still meet, and with what chance.
MEET_AT, RECALL, ROWS = 0.2, 0.985, 1
#: Titles before or after names, legal forms, and short forms of kinds of houses.
TITLES = frozenset("mr mrs ms miss dr shri sri smt kum kumari master mstr prof late md mbbs ms. mast er the m/s messrs".split())
LEGAL = frozenset("pvt private ltd limited llp inc co company".split())
KINDS = {
    "hospital": "hospital hosp hospitals hospita",
    "multispeciality": "multispeciality multispecialty multispl superspeciality",
    "eye": "eye netralaya ophthalmic",
    "children": "children childrens child pediatric paediatric",
    "dental": "dental dent",
    "clinic": "clinic cl clnc clinics polyclinic",
    "heart": "heart cardiac",
    "institute": "institute inst instt",
    "diagnostics": "diagnostics diagnostic diag diagn laboratory lab labs pathology",
    "centre": "centre center ctr cntr cent",
    "nursing": "nursing nurs nsg",
    "home": "home hm",
    "charitable": "charitable ch char charit",
    "trust": "trust tr",
    "research": "research res rsch",
    "implant": "implant",
    "and": "and",
    "speciality": "speciality specialty",
    "multi": "multi",
}
_KIND = {w: k for k, v in KINDS.items() for w in v.split()}
#: Kinds that tell houses of one name apart.
_FIELDS = ("eye", "children", "dental", "heart", "diagnostics", "nursing", "charitable", "multispeciality", "research")
_LOOKS = str.maketrans("015", "ols")
#: By how much a name may be longer than what it begins with and be short for; a longer one is two names run together.
LONGER = 5


def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is more; all cells of a column are worked as the bits of one number."""
    if a == b:
        return 0
    n = len(a)
    if abs(n - len(b)) > most:
        return most + 1
    if not n or not b:
        return max(n, len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, diagonal, before, d = full, 0, 0, 0, n
    for c in b:
        here = at.get(c, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        d += bool(right & last) - bool(left & last)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down, before = (left | ~(diagonal | right)) & full, right & diagonal, here
    return d if d <= most else most + 1


#: What scanners take for what.
_MISREAD = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("c", "e"), ("f", "t"), ("i", "l"))


@lru_cache(300_000)
def similarity(a: str, b: str) -> float:
    """1 less the edit distance over the longer length; misread letters (rn for m, cl for d, ii for u) cost nothing. Words recur, so answers are kept."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if n - min(len(a), len(b)) > 5 or len(set(a) & set(b)) * 2 < min(len(set(a)), len(set(b))) - 1:
        return 0.0
    # Most pairs of words differ in more places than misread letters could explain: they end here.
    d = distance(a, b, 5)
    for long, short in _MISREAD if 0 < d <= 5 else ():
        if long in a or long in b:
            d = min(d, distance(a.replace(long, short), b.replace(long, short)))
    return max(0.0, 1 - d / n) if d <= 3 else 0.0


_SOFT = str.maketrans("cfi", "etl")


@lru_cache(200_000)
def _letters(w: str) -> tuple[int, int]:
    """The letters of a word as bits, those misread for each other as one, and how many pairs of letters in it may be one misread."""
    bits = 0
    for c in w.translate(_SOFT):
        bits |= 1 << (ord(c) & 63)
    return bits, sum(w.count(long) for long, _ in _MISREAD[:4])


def alike(a: str, b: str, least: float) -> float:
    """similarity(a, b) if it is at least so much, else 0.

    Each edit changes the set of letters by two at most, a pair of letters read as one by three and the length by one, so
    most words are told apart by their letters alone.
    """
    if a == b:
        return 1.0
    (bits_a, pairs_a), (bits_b, pairs_b) = _letters(a), _letters(b)
    most = min(3, int((1 - least) * max(len(a), len(b)) + 1e-9))
    pairs = pairs_a + pairs_b
    if (bits_a ^ bits_b).bit_count() > 2 * most + 3 * pairs or abs(len(a) - len(b)) > most + pairs:
        return 0.0
    s = similarity(a, b)
    return s if s >= least else 0.0


def words(name: str | None) -> list[str]:
    """Lower-case words without titles; joined capitals are parted and figures inside words read as letters."""
    text = rx(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll}{2})").sub(" ", name or "")
    out = []
    for w in rx(r"[\p{L}\p{M}\p{N}]+").findall(rx(r"['’]s\b").sub("s", text.lower()).replace("m/s", " ")):
        if rx(r"\p{L}").search(w):
            w = w.translate(_LOOKS)
            if w not in TITLES:
                out.append(w)
    return out


def iso(date: str | None) -> str:
    """yyyy-mm-dd of a day-first date or one that begins with the year; '' if it is none."""
    parts = rx(r"\p{L}+|\d+").findall((date or "").lower())
    if len(parts) != 3:
        return ""
    months = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    if parts[1][:3] in months:
        parts[1] = str(months.index(parts[1][:3]) + 1)
    if not all(p.isdigit() for p in parts):
        return ""
    y, m, d = (parts if len(parts[0]) == 4 else parts[::-1])
    if len(y) != 4 or not 1 <= int(m) <= 12 or not 1 <= int(d) <= 31:
        return ""
    return f"{y}-{int(m):02d}-{int(d):02d}"


def policy(number: str | None) -> str:
    """A policy number's letters and figures, read alike however it is written; '' if it has no four figures."""
    text = rx(r"[^A-Z0-9]").sub("", (number or "").upper())
    digits = text[3:].replace("O", "0").replace("I", "1").replace("L", "1").replace("S", "5").replace("B", "8")
    head = text[:3].replace("5", "S").replace("0", "O")
    return head + digits if sum(c.isdigit() for c in digits) >= 4 else ""


@lru_cache(100_000)
def _kind_of(w: str) -> str | None:
    """The kind of house a word names, misspelt or not."""
    if w in _KIND or len(w) < 4:
        return _KIND.get(w)
    near = [(distance(w, k, 2), k) for k in _KIND if len(k) >= 4 and abs(len(k) - len(w)) <= 2]
    d, k = min(near, default=(9, ""))
    return _KIND[k] if d <= (2 if len(k) >= 7 else 1) else None


def house(name: str | None) -> tuple[str, list[str]]:
    """An organisation's own name, run together, and the kinds it names."""
    own, kinds = [], []
    tokens = [w for w in words(name) if w not in LEGAL and w not in ("of", "for")]
    for w in tokens:
        kind = _kind_of(w)
        if kind:
            kinds.append(kind)
        else:
            own.append(w)
    if "multi" in kinds and "speciality" in kinds:
        kinds.append("multispeciality")
    return "".join(own), sorted(set(kinds) - {"and", "multi", "speciality"})


def monge_elkan(a: list[str], b: list[str], inner) -> float:
    """The mean over the shorter list of each word's best likeness in the other."""
    if len(a) > len(b):
        a, b = b, a
    return sum(max(inner(x, y) for y in b) for x in a) / len(a) if a and b else 0.0


@lru_cache(100_000)
def _stem(w: str) -> str:
    """The first three letters, with c and k alike and doubles single: what pet forms keep of a name."""
    return rx(r"(.)\1").sub(r"\1", rx("ck?").sub("k", w))[:3]


def _inner(common: dict[str, int]):
    def like(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if len(x) == 1 or len(y) == 1:
            return 0.9 if x[0] == y[0] else 0.0
        short, long = sorted((x, y), key=len)
        if len(short) >= 3 and len(long) - len(short) <= LONGER and long.startswith(short):
            return 0.95
        fx, fy = common.get(x, 1), common.get(y, 1)
        if min(fx, fy) >= 10 and min(fx, fy) >= 0.1 * max(fx, fy) and not (len(short) <= 5 and short[:3] == long[:3]):
            return 0.0
        s = alike(x, y, 0.7)
        if s < 0.75 and len(short) <= 6 and len(long) > len(short) and _stem(short) == _stem(long) and short[-1] in "aeiouy":
            return 0.85  # a pet form
        return s

    return like


@lru_cache(100_000)
def _profile(name: str) -> tuple:
    """What possible() compares of a name: its words, and its letters as a whole."""
    ws = name.split()
    parts = [("k" if w[0] == "c" else w[0], len(w), *_letters(w)) for w in ws]
    joined = "".join(ws)
    pairs = max(_letters(j)[1] for j in (joined, "".join(sorted(ws)), "".join(reversed(ws))))
    cuts = {e for w in ws if len(w) >= 3 for e in ("<" + w[:2], w[-2:] + ">")}
    long_cuts = {e for w in ws if len(w) >= 8 for e in ("<" + w[:2], w[-2:] + ">")}
    return parts, len(joined), _letters(joined)[0], pairs, cuts, long_cuts


def possible(a: str, b: str) -> bool:
    """False only where same_person gives 0: the letters of the words, and of the names as a whole, are too different.

    Words can be alike only if they begin alike (c and k are one) or their letters differ by what their edits allow.
    """
    one, two = _profile(a), _profile(b)
    if len(one[0]) > len(two[0]):
        one, two = two, one
    (parts, n, bits, pairs, cuts, long_cuts), (others, m, bits_2, pairs_2, cuts_2, long_2) = one, two
    lone = None
    for c, k, x, p in parts:
        for d, j, y, q in others:
            if c == d:
                break
            most = min(3, int(0.3 * (k if k > j else j) + 1e-9))
            if (x ^ y).bit_count() <= 2 * most + 3 * (p + q) and -most - p - q <= k - j <= most + p + q:
                break
        else:
            lone = k + 3 + p
            break
    else:
        return True
    if (bits ^ bits_2).bit_count() <= 6 + 3 * (pairs + pairs_2) and abs(n - m) <= 3 + pairs + pairs_2:
        return True  # run together as a whole
    if not (long_cuts.isdisjoint(cuts_2) and long_2.isdisjoint(cuts)):
        return True  # one word may be two
    sizes = sorted(j for _, j, _, _ in others if j > 1)
    return len(sizes) > 1 and sizes[0] + sizes[1] <= lone + pairs_2  # a word may be two of the other's


def same_person(a: list[str], b: list[str], common: dict[str, int]) -> tuple[float, bool]:
    """Likeness in 0..1 (0: can't be variants of one name) and whether the given names agree by more than initials."""
    best = _aligned(a, b, common)
    if not best[0]:  # one long word may be two that were run together, where a word of the other name begins or ends it
        for x, y in ((a, b), (b, a)):
            for i, w in enumerate(x):
                if len(w) < 8 or w in common or w in y:
                    continue
                cuts = {len(v) + e for v in y if len(v) >= 3 and w[:2] == v[:2] for e in (-1, 0, 1)} | {len(w) - len(v) + e for v in y if len(v) >= 3 and w[-2:] == v[-2:] for e in (-1, 0, 1)}
                best = max([best, *(_aligned(x[:i] + [w[:k], w[k:]] + x[i + 1 :], y, common) for k in sorted(cuts) if 3 <= k <= len(w) - 3)])
    return best


def _aligned(a: list[str], b: list[str], common: dict[str, int]) -> tuple[float, bool]:
    like = _inner(common)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0, False
    scores = sorted(((like(x, y), -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a: set[int] = set()
    used_b: set[int] = set()
    matched = []
    at: set[tuple[int, int]] = set()
    for s, _, i, j in scores:
        if s >= 0.7 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            matched.append((s, a[i], b[j]))
            at.add((i, j))
    left_a = [x for i, x in enumerate(a) if i not in used_a]
    left_b = [x for i, x in enumerate(b) if i not in used_b]
    parted = False
    for x in list(left_a):  # words run together
        for p, q in ((p, q) for p in b for q in b if p != q and len(p) > 1 and len(q) > 1):
            if alike(x, p + q, 0.85):
                left_a.remove(x)
                left_b = [w for w in left_b if w not in (p, q)]
                matched += [(similarity(x, p + q), p, p), (1.0, q, q)]
                parted = True
                break
    full = [m for m in matched if len(m[1]) > 1 and len(m[2]) > 1]
    if left_a or not full or max(len(m[1]) for m in full) < 3:
        joined = "".join(sorted(a)), "".join(sorted(b))
        straight = "".join(a), "".join(b)
        if min(len(straight[0]), len(straight[1])) < 6:
            return 0.0, False
        s = max(alike(*joined, 0.85), alike(*straight, 0.85), alike(straight[0], "".join(reversed(b)), 0.85))
        return (s, True) if s else (0.0, False)
    if not parted and len(a) > 1 and not _given_names_agree(a, b, at):
        return 0.0, False
    # A word that is two of the other's has no single counterpart: then the mean is over what was matched.
    score = sum(m[0] for m in matched) / len(matched) if parted else monge_elkan(a, b, like)
    return score, len(full) >= 2 or (len(a) == 1 and len(b) == 1)


def _given_names_agree(a: list[str], b: list[str], at: set[tuple[int, int]]) -> bool:
    """With the surname, which stands first or last, taken away, the first words left must be the ones that match.

    Else a relative whose given name is the other's middle name would be a variant.
    """
    for i, j in at:
        if len(a[i]) > 1 and len(b[j]) > 1 and i in (0, len(a) - 1) and j in (0, len(b) - 1):
            x, y = [k for k in range(len(a)) if k != i], [k for k in range(len(b)) if k != j]
            if not x or not y or (x[0], y[0]) in at:
                return True
    return False


#: Ways of writing one sound.
_SOUNDS = (("ee", "i"), ("oo", "u"), ("aa", "a"), ("w", "v"), ("ck", "k"), ("c", "k"))


@lru_cache(100_000)
def _sound(name: str) -> str:
    for a, b in _SOUNDS:
        name = name.replace(a, b)
    return rx(r"(.)\1").sub(r"\1", name)


def likeness(own_a: str, own_b: str) -> float:
    """How alike two names of houses are as written or as spoken."""
    return max(similarity(own_a, own_b), similarity(_sound(own_a), _sound(own_b)))


def same_house(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> float:
    own_a, kinds_a = a
    own_b, kinds_b = b
    if not own_a or not own_b:
        return 0.0
    s = likeness(own_a, own_b)
    n = min(len(own_a), len(own_b))
    if s < (0.7 if n >= 6 else 0.75):
        return 0.0
    fields = [set(k) & set(_FIELDS) for k in (kinds_a, kinds_b)]
    if fields[0] and fields[1] and fields[0] != fields[1] and not (fields[0] & fields[1]):
        return 0.0
    one_sided = fields[0] ^ fields[1]
    if one_sided and kinds_a and kinds_b and not (fields[0] & fields[1]) and one_sided & {"dental", "diagnostics", "eye", "children", "heart", "nursing", "multispeciality", "charitable"}:
        return 0.0  # a plain hospital isn't the eye hospital of the same name
    return s


def nodes(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, name, kinds, k1, k2, keys), mentions alike in all compared parts being one row, and (id, mention_id)."""
    hasher = (ROWS, bands_for(MEET_AT, RECALL, ROWS))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for m, kind, name, dob, pol, city, pin in f.itertuples(index=False):
                if kind == "person":
                    w = words(name)
                    out.append((m, "p", " ".join(w), "", iso(dob), policy(pol)))
                else:
                    own, kinds = house(name)
                    place = rx(r"\P{L}").sub("", (city or "").lower())
                    out.append((m, "o", own, " ".join(kinds), place, rx(r"\D").sub("", pin or "")))
            yield pd.DataFrame(out, columns=["mention_id", "kind", "name", "kinds", "k1", "k2"])

    rows = mentions.select("mention_id", "entity_kind", "full_name", F.col("dob").cast("string"), F.col("policy_number").cast("string"), F.col("city").cast("string"), F.col("pin").cast("string")).where("mention_id IS NOT NULL AND full_name IS NOT NULL").distinct()
    parsed = spread(rows).mapInPandas(parse, "mention_id bigint, kind string, name string, kinds string, k1 string, k2 string").where("name <> '' AND (k1 <> '' OR k2 <> '')")
    # One row per way of writing; the mentions of one stay apart, as there may be any number of them.
    parsed = durable(parsed)
    alike = parsed.groupBy("kind", "name", "kinds", "k1", "k2").agg(F.min("mention_id").alias("id"))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHasher(*hasher)
        for f in frames:
            f["keys"] = [minhash.keys(g for w in (name.split() if kind == "p" else [name]) for g in qgrams(w)) for kind, name in zip(f["kind"], f["name"])]
            yield f

    signed = alike.select("id", "kind", "name", "kinds", "k1", "k2").mapInPandas(sign, "id bigint, kind string, name string, kinds string, k1 string, k2 string, keys array<bigint>")
    return durable(signed), parsed.join(alike, ["kind", "name", "kinds", "k1", "k2"]).select("id", "mention_id")


@lru_cache(100_000)
def _counts(common: str) -> dict[str, int]:
    """word=count pairs as a dictionary."""
    return {k: int(v) for k, _, v in (x.partition("=") for x in common.split())}


def variant_links(signed: DataFrame) -> DataFrame:
    """(a, b, weight, sure): verified links between nodes."""
    frequency = signed.where("kind = 'p'").select("id", F.explode(F.split("name", " ")).alias("w"))
    counts = frequency.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    common = frequency.join(counts, "w").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "w", F.col("n").cast("string")))), " ").alias("common"))
    features = durable(signed.drop("keys").join(common, "id", "left").na.fill({"common": ""}))
    evidence = F.when(F.col("kind") == "p", F.array(F.concat(F.lit("d"), "k1"), F.concat(F.lit("p"), "k2"))).otherwise(
        F.array(F.concat(F.lit("c"), F.substring("k1", 1, 3)), F.concat(F.lit("e"), F.substring("k1", 4, 3)), F.concat(F.lit("z"), "k2"))
    )
    evidence = F.filter(evidence, lambda e: F.length(e) > 1)
    slices = slices_for(signed.agg(F.sum(F.size("keys") * F.size(evidence))).first()[0] or 0)
    members = (
        signed.select("id", "keys", "kind", "name", F.explode(evidence).alias("e"))
        .withColumn("slice", slice_of(F.col("e"), slices))
        .select("id", F.explode("keys").alias("key"), "e", "kind", "name", "slice")
        .select(F.xxhash64("key", "e").alias("bucket"), "id", "kind", "name", "slice")
    )

    def early(pairs: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                near = [possible(x, y) if kind == "p" else likeness(x, y) >= 0.7 for kind, x, y in zip(f["kind_a"], f["name_a"], f["name_b"])]
                yield f.loc[near, ["a", "b"]]

        return pairs.where("kind_a = kind_b").select("a", "b", "kind_a", "name_a", "name_b").mapInPandas(run, "a bigint, b bigint")

    def verify(pairs: DataFrame) -> DataFrame:
        if slices > 1:
            both = matched(pairs, features.withColumn("evidence", evidence), F.col("slice") == least_slice(F.col("evidence_a"), F.col("evidence_b"), slices)).drop("evidence_a", "evidence_b", "slice")
        else:
            both = matched(pairs, features)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    if r.kind_a != r.kind_b:
                        continue
                    if r.kind_a == "p":
                        one, two = r.k1_a != "" and r.k1_a == r.k1_b, r.k2_a != "" and r.k2_a == r.k2_b
                        if not (one or two):
                            continue
                        common = _counts(r.common_a) | _counts(r.common_b)
                        s, full = same_person(r.name_a.split(), r.name_b.split(), common)
                        # Another birth date, or another policy by more than a slip, speaks against: then the whole names must agree.
                        apart = (r.k1_a != "" and r.k1_b != "" and not one) or (r.k2_a != "" and r.k2_b != "" and not two and distance(r.k2_a, r.k2_b, 1) > 1)
                        if s >= 0.7 and (not apart or (full and s >= 0.9)):
                            out.append((r.a, r.b, s + 0.5 * (one + two), bool(full and not apart)))
                    else:
                        if not (similarity(r.k1_a, r.k1_b) >= 0.7 or (r.k2_a != "" and r.k2_a == r.k2_b and (similarity(r.k1_a, r.k1_b) >= 0.5 or not r.k1_a or not r.k1_b))):
                            continue
                        if r.k2_a and r.k2_b and r.k2_a != r.k2_b and distance(r.k2_a, r.k2_b) > 2 and r.k1_a != r.k1_b:
                            continue
                        if r.k2_a and r.k2_b and distance(r.k2_a, r.k2_b, 1) > 1 and likeness(r.name_a, r.name_b) < 0.8:
                            continue  # another PIN: only the very same name
                        s = same_house((r.name_a, r.kinds_a.split()), (r.name_b, r.kinds_b.split()))
                        if s:
                            fields = [set(k.split()) & set(_FIELDS) for k in (r.kinds_a, r.kinds_b)]
                            out.append((r.a, r.b, s + 0.3 * (fields[0] == fields[1]), bool(fields[0] == fields[1])))
                yield pd.DataFrame(out, columns=["a", "b", "weight", "sure"])

        return both.mapInPandas(run, "a bigint, b bigint, weight double, sure boolean")

    return links(members, verify, early=early, slices=slices)


def entities(mentions: DataFrame) -> DataFrame:
    """(mention_id, entity_id): every mention with a name and evidence; entity_id is the least mention_id of its group.

    Stars that a sure link joins (full names agree) are one entity: a mention with only the birth date and one with
    only the policy number meet through one that has both. Links by initials alone join a mention to one star only.
    """
    signed, members = nodes(mentions)
    edges = variant_links(signed)
    stars = durable(star_clusters(edges))
    center = lambda s: stars.select(F.col("id").alias(s), F.col("center").alias(f"c{s}"))
    between = edges.where("sure").join(center("a"), "a").join(center("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(between)
    grouped = stars.join(roots.withColumnRenamed("id", "center"), "center", "left").select("id", F.coalesce("root", "center").alias("group"))
    placed = members.join(grouped, "id", "left").select("mention_id", F.coalesce("group", "id").alias("group"))
    return placed.join(placed.groupBy("group").agg(F.min("mention_id").alias("entity_id")), "group").select("mention_id", "entity_id")


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(mention_a, mention_b), mention_a < mention_b: the pairs that the stated result consists of."""
    a = groups.select("entity_id", F.col("mention_id").alias("mention_a"))
    b = groups.select("entity_id", F.col("mention_id").alias("mention_b"))
    return a.join(b.hint("merge"), "entity_id").where("mention_a < mention_b").select("mention_a", "mention_b")
