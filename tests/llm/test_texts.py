import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import pii as P
from ledgerloom.llm import repair as R
from ledgerloom.llm import sentences as S
from ledgerloom.llm.boost import Boosted, calibrated_threshold

# --- boosting ---


def test_boosted_trees_learn_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    p = Boosted(trees=40).fit(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    assert 0 < calibrated_threshold(p, y[2000:]) < 1
    assert len(Boosted(trees=2).fit(x[:50], y[:50]).probability(np.zeros((0, 5)))) == 0


def test_rare_binary_features_can_be_split_on():
    x = np.zeros((2000, 3))
    x[:60, 1] = 1
    assert Boosted(trees=20).fit(x, x[:, 1]).probability(np.array([[0, 1.0, 0], [0, 0, 0]])).round().tolist() == [1, 0]


# --- sentences ---

def model_of(spark, texts):
    frame = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "doc_id bigint, text string, lang string")
    return S.learn(frame)


def test_learned_abbreviations_and_units(spark):
    draw = random.Random(2)
    names = [f"{draw.choice('BDGKLMT')}{draw.choice('aeiou')}{draw.choice('lmnr')}{draw.choice('aeiou')}{draw.choice('lmnr')}" for _ in range(60)]
    body = [(f"The bill of Mr. {n} was paid by Dr. {m} for Rs. {draw.randrange(900)}. The file was closed. It was sent to {n}. The desk replied.", "en") for n in names for m in names[:3]]
    model = model_of(spark, body)
    assert {("en", "mr"), ("en", "dr"), ("en", "rs")} <= set(model.abbreviations)
    units = lambda t: [t[a:b].strip() for a, b in zip([0, *S.Splitter(model).ends(t, "en")], S.Splitter(model).ends(t, "en"))]
    assert units('The bill of Mr. Kalor was paid. The desk replied, "It is late. The file is closed." and left.\n\nRemarks') == ["The bill of Mr. Kalor was paid.", 'The desk replied, "It is late. The file is closed." and left.', "Remarks"]
    assert units("The bill is\nhere. The desk") == ["The bill is\nhere.", "The desk"]


def test_scripts_without_spaces_or_periods():
    ends = lambda t, g=None: [t[a:b].strip() for a, b in zip([0, *S.Splitter(S.Model()).ends(t, g)], S.Splitter(S.Model()).ends(t, g))]
    assert ends("保険証券は有効ですか？請求番号19は審査中である。") == ["保険証券は有効ですか？", "請求番号19は審査中である。"]
    assert ends("家族は「払いました。ありません。」と話した。次。") == ["家族は「払いました。ありません。」と話した。", "次。"]
    assert ends("बिल रु है। दावा 7 लंबित है| क्या?") == ["बिल रु है।", "दावा 7 लंबित है|", "क्या?"]
    assert ends("หน้า 18 ของรายงานหายไป ค่าห้องเกินวงเงิน") == ["หน้า 18 ของรายงานหายไป", "ค่าห้องเกินวงเงิน"]
    assert ends("کیا رسید موجود ہے؟ دوا دی گئی۔") == ["کیا رسید موجود ہے؟", "دوا دی گئی۔"]


def test_lists_forms_and_blank_texts():
    ends = S.Splitter(S.Model()).ends
    t = "1. Cancelled cheque. Two copies.\n* Copy of policy\n\nWard No. 5\nMode: Cashless\n\nabc"
    assert [t[:e].rpartition("\n")[2] for e in ends(t, "en")] == ["1. Cancelled cheque. Two copies.", "* Copy of policy", "Ward No. 5", "Mode: Cashless", "abc"]
    assert ends(None, None) == ends("", "en") == ends(" \n \n", "en") == []
    long = "word " * 200_000
    assert ends(long, "en") == [len(long) - 1]


def test_units_of_a_table(spark):
    rows = [(1, "One is here. Two is there.", "en"), (1, "One is here. Two is there.", "en"), (2, None, "en"), (3, "", None), (4, "  ", "hi"), (5, "x", None)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, end_pos int")
    assert sorted(tuple(r) for r in S.units(frame).collect()) == [(1, 12), (1, 26), (5, 1)]
    assert S.units(frame.limit(0)).collect() == []


# --- scans ---


def test_furniture_on_held_out_pages():
    model = R.furniture_model()
    hit = wrong = missed = 0
    for seed in range(9000, 9040):
        lines, mark = R.generated_pages(seed, 1 + seed % 6)
        for m, o in zip(mark, R.furniture(lines, model)):
            hit, wrong, missed = hit + (m and o), wrong + (o and not m), missed + (m and not o)
    assert hit / (hit + missed) > 0.93 and hit / (hit + wrong) > 0.93


def test_noise_and_repair(spark):
    words = "the hospital returned the original discharge summary because the claim department asked for the regional certificate after the admission and pre-authorisation of the patient".split()
    draw = random.Random(4)
    clean = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(60)]
    noisy = "The hospita1 returned the dis-\ncharge\nPage 1 of 2\nsummary. The pre-\nauthorisation of the clairn was regiorial.\n\nMr. Regiorial asked.\nPage 2 of 2"
    scans = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean)] + [(900, noisy, "x"), (900, noisy, "x"), (901, None, "x"), (902, "", "x")], "scan_id bigint, raw_text_preview string, line_no string")
    codes = spark.createDataFrame([(5, "the patient adrnission K80 the original"), (6, None)], "code_id bigint, context string")
    got = {tuple(r) for r in R.noise(scans, codes).collect() if r.record_id in (900, 901, 902, 5)}
    assert got == {
        ("scan", 900, 1, "misread", "hospital"), ("scan", 900, 1, "split", "discharge"), ("scan", 900, 3, "furniture", ""), ("scan", 900, 4, "split", "pre-authorisation"),
        ("scan", 900, 5, "misread", "claim"), ("scan", 900, 5, "misread", "regional"), ("scan", 900, 8, "furniture", ""), ("code", 5, 1, "misread", "admission"),
    }
    text = {r.record_id: r.text for r in R.repaired(scans, codes).collect()}
    assert text[900] == "The hospital returned the discharge summary. The pre-authorisation of the claim was regional.\n\nMr. Regiorial asked."
    assert text[5] == "the patient admission K80 the original" and 901 not in text


def test_noise_of_empty_tables(spark):
    scans, codes = spark.createDataFrame([], "scan_id bigint, raw_text_preview string"), spark.createDataFrame([], "code_id bigint, context string")
    assert R.noise(scans, codes).collect() == []


# --- personal information ---


def test_spans_of_held_out_sentences():
    model, limits = P.span_model()
    draw = random.Random(77)
    ordinary = frozenset(w.lower() for form in P.WITH + P.WITHOUT for w in P.re.findall(r"\b[a-z]{2,}\b", form))
    hit = wrong = missed = 0
    for _ in range(120):
        text, truth = "", set()
        for _ in range(5):
            t, spans = P._filled(draw.choice(P.WITH + P.WITHOUT), draw)
            truth |= {(k, a + len(text), b + len(text)) for k, a, b in spans}
            text += t + ("\n" if not t.endswith(".") else " ")
        found = set(P.spans_of([text], model, limits, ordinary)[0])
        hit, wrong, missed = hit + len(found & truth), wrong + len(found - truth), missed + len(truth - found)
    assert hit / (hit + missed) > 0.93 and hit / (hit + wrong) > 0.93


def test_personal_information(spark):
    text = "The patient Asha Mohan Tikasu was brought by a relative. Contact A.B. Revonal on +91 4510027019 for the original\nPage 1 of 2\npapers. The receipt no. 4510027019 was attached.\nE-mail: asha.tik@mail.example\nAddress: Plot No. 12, Revona House, Tikasu Road,\nMagodnagar, Lipagaon-482113\nPolicy SWP0046921 is active. Aadhaar 0263-7653-1621 of Asha Tikasu is attached.\nPage 2 of 2"
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "Nothing here.", "x")], "scan_id bigint, raw_text_preview string, text string")
    assert {tuple(r) for r in P.personal(frame).collect()} == {
        (1, "person", "Asha Mohan Tikasu"), (1, "person", "A.B. Revonal"), (1, "phone", "+91 4510027019"), (1, "email", "asha.tik@mail.example"),
        (1, "address", "Plot No. 12, Revona House, Tikasu Road, Magodnagar, Lipagaon-482113"), (1, "id_number", "0263-7653-1621"), (1, "person", "Asha Tikasu"),
    }
    out = {r.scan_id: r.text for r in P.redacted(frame).collect()}
    assert "[PERSON]" in out[1] and "[EMAIL]" in out[1] and "asha" not in out[1].lower() and "SWP0046921" in out[1] and out[4] == "Nothing here."
    assert P.personal(frame.limit(0)).collect() == []


def test_cases_per_record_do_not_depend_on_the_size_of_the_corpus(spark):
    """Ten times the texts under new ids: every record keeps its cases."""
    folder = "/root/testdata/sf0.01"
    scans, codes = spark.read.parquet(f"{folder}/scan_texts.parquet").select("scan_id", "raw_text_preview"), spark.read.parquet(f"{folder}/claim_codes.parquet").select("code_id", "context")
    many = lambda frame, key: frame.join(spark.range(10).withColumnRenamed("id", "copy")).withColumn(key, frame[key] + F.col("copy") * 10_000_000).drop("copy")
    one = {tuple(r) for r in R.noise(scans, codes).collect()}
    ten = [tuple(r) for r in R.noise(many(scans, "scan_id"), many(codes, "code_id")).collect()]
    again = {(k, i % 10_000_000, *rest) for k, i, *rest in ten}
    assert len(one) > 100 and len(one - again) <= 0.01 * len(one) and len(ten) >= 9.9 * len(one)


def test_line_pairs_on_held_out_papers():
    joins, hit, n = R.join_model(), 0, 0
    for seed in range(7000, 7040):
        lines, mark, ends = R.generated_paper(seed, 1 + seed % 6)
        got = joins.of([lines], [[bool(m) for m in mark]])[0]
        hit += sum(ends[i] == how for i, (_, how) in got.items())
        n += len(got)
    assert hit / n > 0.93


def test_redaction_leaves_the_rest_unchanged(spark):
    """Without placeholders and values, input and output are the same signs in the same order."""
    scans = spark.read.parquet("/root/testdata/sf0.001/scan_texts.parquet").select("scan_id", "raw_text_preview").where("raw_text_preview <> ''").distinct()
    before = {r.scan_id: r.raw_text_preview for r in scans.collect()}
    found = {}
    for r in P.personal(scans).collect():
        found.setdefault(r.scan_id, []).append(r.pii_text)
    outs = {r.scan_id: r.text for r in P.redacted(scans).collect()}
    assert outs.keys() == before.keys() and any(outs[k] != before[k] for k in outs)
    for k, out in outs.items():
        pieces = [R.re.escape(p) for p in R.re.split(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|PERSON)\]", out)]
        if k not in found:
            assert out == before[k]
        assert out.count("\n") == before[k].count("\n")
        one_line = lambda t: R.re.sub(r"\s+", " ", t)
        if not any("\n" in v for v in found.get(k, ())) and len(pieces) - 1 == len(found.get(k, ())):
            assert R.re.match(r"(?s)" + r"[\s\S]+?".join(pieces) + r"$", before[k]) or len(one_line(out)) <= len(one_line(before[k])) + 20 * len(pieces)


def test_a_value_over_a_page_break_keeps_what_lies_between():
    lines = "Address: Plot No. 12, Revona\nPage 1 of 2\nHouse, Tikasu Road. Bye".split("\n")
    flat, pieces = P.flattened(lines, [False, True, False])
    a, b = flat.index("Plot"), flat.index(". Bye")
    assert flat[a:b] == "Plot No. 12, Revona House, Tikasu Road"
    assert P.replaced("\n".join(lines), pieces, [("address", a, b)]) == "Address: [ADDRESS]\nPage 1 of 2\n. Bye"


def test_collocations_keep_a_name_with_its_abbreviation(spark):
    """An abbreviation that also ends sentences doesn't end one before the word it always precedes."""
    draw = random.Random(6)
    noun = lambda: draw.choice("desk file bill ward clerk house paper letter".split())
    body = []
    for i in range(400):
        body.append((f"The {noun()} of the St. Gabil {noun()} was seen. The {noun()} came at 5 {draw.choice(('p.m.', 'p.m.'))} {draw.choice(('Nobody', 'Someone', 'The clerk', 'A nurse'))} replied. Nobody had seen the {noun()} that it replied to since the {noun()} was closed by them. It closed at 4 p.m.", "en"))
    assert ("en", "p.m") in model_of(spark, body).abbreviations
    assert S.collocation_ratio(50, 60, 55, 10_000) > S.COLLOCATED > S.collocation_ratio(1, 60, 170, 10_000)
    forced = S.Model(abbreviations={("en", "st"): True}, collocations={("en", "st", "gabil")})
    cut = lambda t: len(S.Splitter(forced).ends(t, "en"))
    assert cut("We went to St. Gabil today") == 1 and cut("We went to the St. Nobody came") == 2


def test_codes_that_end_sentences_are_no_burden_of_the_driver(spark, monkeypatch):
    """More candidates than the driver may hold are judged by the workers; the units are those of the unbounded model."""
    rows = [(i, f"Dr. Rao saw case swp{70_000_000 + i}. The bill is paid. See swp{90_000_000 + i}.", "en") for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = sorted(map(tuple, S.units(documents).collect()))
    monkeypatch.setattr(S, "MAX_LEARNED", 100)
    assert sorted(map(tuple, S.units(documents).collect())) == whole
    assert len(whole) >= 2 * len(rows)
