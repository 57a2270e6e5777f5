"""License scans, resampling and the filter audit against plain models; odd rows, ties, empty tables and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.llm import interaction, licenses, resampling
from flowloom.llm.common import table

DOC = "doc_id long, text string, lang string, gram string, row int, part string, found int, template int"
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(0, "plain words here, and there"), (1, None), (2, ""), (3, "one"), (None, "no id at all"), (None, "no id at all"), (5, "repeated row"), (5, "repeated row"), (5, "same id, other text"), (6, "é ñ 世界 𝄞\n\t  spaced   out "), (7, "w " * 4000), (8, "\x00 zero\x00byte"), (9, "X" * 50000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, (None, "en", "de")[k % 3], "clash", 1, "clash", 2, 3) for k, (i, t) in enumerate(rows)], DOC)


def words_of(text):
    return [w.decode() for w in LETTERS.findall((text or "").encode().lower())]


# ---------------------------------------------------------------- 11 licenses


def base_of(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for n in [len(phrase.split())] for i in range(len(words)) if words[i : i + n] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def scanned(df):
    return sorted(map(tuple, licenses.digests(licenses.scan(df)).collect()), key=repr)


def test_phrases_as_a_plain_search_finds_them(spark):
    r = random.Random(5)
    vocabulary = ["mit", "License", "MIT", "apache", "general", "public", "license,", "x"]
    rows = [*ODD, *((100 + k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for k in range(120)), (300, "MIT License " * 3000), (301, "general public " * 2000 + "license")]
    rows += [(302, "mit\x00license"), (302, "the MIT-License"), (None, "mit license"), (None, "mit license"), (None, "apache license")]
    got = scanned(frame(spark, rows).repartition(3))
    assert sorted(((x[0], *x[1:6]) for x in got), key=repr) == sorted(((i, *base_of(t)) for i, t in rows), key=repr)
    assert all(set(filter(None, x[5].split(","))) <= set(x[6].split(",")) and (x[7] == 1.0 or not x[2]) for x in got)


def test_edited_templates_are_found_and_clean_texts_are_not(spark):
    r = random.Random(8)
    filler = [f"word{i}" for i in range(400)]
    some = lambda n: [r.choice(filler) for _ in range(n)]
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.NOTICES):
        words = text.split()
        for share in (0.0, 0.15):
            edited = []
            for w in words:
                x = r.random()
                edited += [r.choice(filler)] if x < share / 2 else [] if x < share * 0.75 else [w, r.choice(filler)] if x < share else [w]
            at = 10 * k + (share > 0)
            rows.append((at, " ".join(some(r.randint(0, 300)) + (edited if len(words) >= 12 else words) + some(r.randint(0, 300)))))
            now, template = [w.encode() for w in words_of(" ".join(edited))], tuple(w.encode() for w in words_of(text))
            if len(words) < 12 or licenses.aligned(now, template) >= licenses.SHARE * len(template) and len(now) <= 1.1 * len(template):
                want[at] = label
    rows += [(1000 + k, " ".join(some(500))) for k in range(20)] + [(1100, "permission is hereby granted to use the software without restriction")]
    got = {x[0]: x for x in scanned(frame(spark, rows))}
    assert len(want) > 22
    assert all(label in got[at][6].split(",") for at, label in want.items()), [(at, want[at], got[at]) for at in want if want[at] not in got[at][6].split(",")]
    assert all(got[i][6] == "" for i in got if i >= 1000) and all(0 <= x[7] <= 1 for x in got.values())
    spans = licenses.scan(frame(spark, [(0, " ".join([*some(37), licenses.NOTICES[2][1], *some(5)]))])).first().spans
    assert [(x.start, x.stop, x.share) for x in spans if x.template == len(licenses.PHRASES) + 2] == [(37, 37 + len(words_of(licenses.NOTICES[2][1])), 1.0)]


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(300):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(1, 12))] for _ in range(2))
        assert licenses.aligned(a, tuple(b)) == plain(a, b)


def test_shuffled_diagonals_give_the_same_rows(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    want = scanned(docs)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", -1)
    assert scanned(docs.repartition(5)) == want
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert all(x[1:6] == base_of(texts[x[0]]) for x in want)
    assert all(("cc-by-nc" in x[6]) == ("CC BY-NC 4.0" in (texts[x[0]] or "")) for x in want)
    assert licenses.scan(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.templates({" ": "none"})


# ---------------------------------------------------------------- 12 resampling


def resampled(docs, target, longest, least, percent, buckets):
    runs = lambda text: [" ".join(w[i : i + n]) for w in [words_of(text)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for _, x in rows for f in runs(x)) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        mine = runs(x)
        weight = sum(gain[bucket(f)] for f in mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("longest,head", [(1, 1), (1, 40), (3, 65536)])
def test_resampling_as_a_plain_model(spark, longest, head, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 50)
    r = random.Random(longest)
    vocabulary = [*(f"w{i}" for i in range(60)), "Épée", "世界"]
    text = lambda: " ".join(vocabulary[int(len(vocabulary) * r.random() ** 3)] for _ in range(r.randint(0, 90)))
    docs = [*ODD, *((10 + k, text()) for k in range(150)), *[(400, "the same text " * 9)] * 5, *[(None, "without an id " * 8)] * 4]
    target = [(k, " ".join(r.choice(vocabulary[40:]) for _ in range(30))) for k in range(12)] + [(99, None)]
    got = resampling.resample(frame(spark, docs).repartition(3), frame(spark, target), buckets=97, longest=longest, least_words=3, percent=40, head=head)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(docs, target, longest, 3, 40, 97)


def test_resampling_of_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert resampling.resample(none, frame(spark, ODD)).count() == 0
    rows = sorted(map(tuple, resampling.resample(frame(spark, ODD), none).collect()), key=repr)
    assert rows == resampled(ODD, [], 1, 20, 10, 10_000)


# ---------------------------------------------------------------- 13 filter interaction


def audited(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for k, (i, x) in enumerate(docs):
        x = x or ""
        w = re.findall("[^\x20\x09-\x0d]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x), "D": bool(set(x) & set("#$%&*|")), "E": i is not None and any(j is not None and j < i and (y or "") == x for j, y in docs)}
        rows.append(((None, "en", "de")[k % 3] or "", i, {f for f in fails if fails[f]}))
    out = []
    for part in sorted({p for p, _, _ in rows}):
        mine, total = [(i, f) for p, i, f in rows if p == part], collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                steps.append((part, "".join(order), k + 1, len(kept), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
                total[f] += len(gone)
                left = kept
        out += [(*x[:-1], total[x[-1]]) for x in steps]
    return sorted(out)


def test_audit_as_filters_applied_one_by_one(spark):
    r = random.Random(4)
    texts = ["Good Words # here", "plenty of words " * 80, " ".join(f"w{k}" for k in range(300)), "ABC " * 300, "", None, " ".join(f"v{k}" for k in range(200)) + " & more"]
    docs = [*ODD, *((20 + k, r.choice(texts)) for k in range(80)), *[(200, texts[2])] * 3]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 90, 2), 5, 5, None, 999]]
    label = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    failed = interaction.failures(frame(spark, docs).repartition(3))
    got = sorted(map(tuple, interaction.audit(failed, label).collect()))
    assert got == audited(docs, labels) and len(got) == 3 * 600
    assert interaction.audit(interaction.failures(frame(spark, []).limit(0)), label).count() == 0
    assert {x[7:9] for x in map(tuple, interaction.audit(failed, label.limit(0)).collect())} == {(0, 0)}


def test_audit_of_other_filters(spark):
    docs = frame(spark, [(k, "x" * k) for k in range(12)])
    own = interaction.failures(docs, {"S": F.length("text") < 6, "L": F.length("text") > 8})
    got = {(x.filter_order, x.step): x.removed for x in interaction.audit(own, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "SLE").groupBy("filter_order", "step").agg(F.sum("removed").alias("removed")).collect()}
    assert got["SLE", 1] == 6 and got["SLE", 2] == 3 and got["LSE", 1] == 3 and got["ELS", 1] == 0 and len(got) == 18
    assert len(interaction.edges(5)) == 80 and sum(p for _, _, p in interaction.edges(5)) == 600
