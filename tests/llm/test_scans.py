"""Quality rules (1), license scan (4)."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from sparsemill.llm import license_scan, quality_rules

from .helpers import frame, prose, same_rows, simple, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for k in range(len(words) - 2):
        if grams[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_counts(spark):
    extra = [(1000, "a b c a b c a b"), (1001, "x\nx\n\n \nx y\nx"), (1002, "a a a a"), (1003, "é* ß# |<>|")]
    got = quality_rules.judge(simple(spark, texts() + extra), spark.createDataFrame([], "doc_id long, quality int"))
    want = []
    for i, t in texts() + extra:
        c = counted(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, failed, not failed))
    same_rows([tuple(r)[:8] for r in got.collect()], want)


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (200, 0.01), (997, 0.05), (3, 0.9)):
        for k in (0, 1, 2, n // 20, n // 2, n - 1, n):
            want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(min(want, 1.0), rel=1e-9)


def test_certified_stops_at_the_first_failure():
    assert quality_rules.certified(np.array([0, 4, 40, 40]), 1000, 0.02, 0.01) == 2
    assert quality_rules.certified(np.array([0, 0]), 59, 0.05, 0.05) == 2 and quality_rules.certified(np.array([0, 0]), 58, 0.05, 0.05) == 0
    assert quality_rules.certified(np.array([0]), 0, 0.05, 0.05) == 0 and quality_rules.certified(np.array([], int), 100, 0.05, 0.05) == 0


def test_bound_holds_over_many_draws():
    """Steps of growing true risk, five strata: how often any of them is certified beyond its risk."""
    rng = np.random.default_rng(12)
    risks, n, over = np.cumsum([0.01, 0.02, 0.025, 0.1]), 400, 0
    draws = 4000
    for _ in range(draws):
        each = rng.multinomial(n, [*np.diff(np.append(0, risks)), 1 - risks[-1]], size=5)
        taken = [quality_rules.certified(np.cumsum(x[:-1]), n, 0.05, 0.05 / 5) for x in each]
        over += any(k and risks[k - 1] > 0.05 for k in taken)
    assert over / draws <= 0.05
    assert over / draws > 0.001, "the third step's risk is close to the limit: it has to be certified now and then"


def test_risk_is_kept(spark):
    """Bad documents have many symbols: a cutoff is certified that rejects them, and hardly any good one."""
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        text = " ".join(f"w{i}x{k}" + ("***" if bad else "") for k in range(60))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    # Two labels of a document: bad if any is.
    labels += [(0, 1), (None, 0), (3, None)]
    got = quality_rules.judge(simple(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(6000))
    copies = [(10_000 + k, rows[1][1]) for k in range(400)]
    few = quality_rules.judge(simple(spark, rows[:100] + copies), spark.createDataFrame(labels[:100] + [(i, 1) for i, _ in copies], "doc_id long, quality int"))
    assert all(r.kept for r in few.collect()), "copies of a text are one trial"
    few = quality_rules.judge(simple(spark, rows[:100]), spark.createDataFrame(labels[:100], "doc_id long, quality int"))
    assert all(r.kept for r in few.collect()), "too few labels to certify anything"


def test_rules_on_an_empty_table(spark):
    assert quality_rules.judge(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def places(text):
    words = LICENSE_WORD.findall(text.translate(LOWER))
    return len(words), sorted((k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())


EXTRA = [
    (2000, "The MIT License, mit-license MIT license mit license MIT"),
    (2001, "Apache\nLicense; apache apache license GENERAL public license general public public license"),
    (2002, "mitlicense mit Ülicense mit licenses"),
    (2003, "general general public license public license"),
    (2004, "mit license " * 3000),
    (2005, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"),
    (2006, "Licensed under CC BY-NC 4.0. All rights reserved."),
    (2007, "Permission is granted by the owner of this land to any walker who keeps to the paths"),
]


def test_places(spark):
    got = license_scan.scan(simple(spark, texts() + EXTRA)).collect()
    want = []
    for i, t in texts() + EXTRA:
        n, found = places(t)
        want.append((i, n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    same_rows([tuple(r)[:6] for r in got], want)
    by = {r.doc_id: r for r in got}
    assert "mit" in by[2005].labels and by[2005].base_labels == "" and 0.8 <= by[2005].score < 1
    assert set(by[2006].labels.split(",")) == {"cc", "reserved"}
    assert by[2007].labels == "" and by[2007].score == 0
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def closest(words, template):
    """The best similarity of any stretch of words with the template."""
    n = len(template)
    return max((SequenceMatcher(None, words[a : a + m], template, autojunk=False).ratio() for a in range(len(words)) for m in range(n * 2 // 3, n * 3 // 2 + 1) if a + m <= len(words)), default=0.0)


def test_own_labels_against_all_stretches(spark, monkeypatch):
    """Notices with words left out, put in and changed, among prose; whether they come to the texts or texts to them."""
    rng = random.Random(17)
    notices = [t for t in license_scan.TEMPLATES if len(t.words) > license_scan.SHORT]
    phrases = [t for t in license_scan.TEMPLATES if len(t.words) <= license_scan.SHORT]
    docs = []
    for k in range(60):
        words = list(notices[k % len(notices)].words)
        at = rng.randrange(1, len(words))
        kind, much = k % 3, rng.randint(0, len(words) // 3)
        if kind == 0:
            words[at:at] = prose(rng, much).split() if much else []
        elif kind == 1:
            del words[at : at + much]
        else:
            for _ in range(much):
                words[rng.randrange(len(words))] = "other"
        docs.append((k, f"{prose(rng, 8)} {' '.join(words)} {prose(rng, 8)}"))
    docs.append((100, " ".join("Permission is hereby granted free of charge to any person or body here and now obtaining a copy of this software and associated documentation files".split())))
    for limit in (license_scan.FEW_SPANS, 0):
        monkeypatch.setattr(license_scan, "FEW_SPANS", limit)
        got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan.scan(simple(spark, docs)).collect()}
        sure = 0
        for i, text in docs:
            words = LICENSE_WORD.findall(text.translate(LOWER))
            exact = {t.label for t in phrases if any(words[k : k + len(t.words)] == t.words for k in range(len(words)))}
            near = {t.label: closest(words, t.words) for t in notices}
            assert exact <= got[i] <= exact | {x for x, s in near.items() if s >= 0.8}, text
            if i % 3 == 0 or i == 100:  # left whole but for one gap: to be found wherever it is
                assert {x for x, s in near.items() if s >= 0.86} <= got[i], text
            sure += bool({x for x, s in near.items() if s >= 0.8} & got[i])
        assert sure > 25 and "mit" in got[100]


def test_scan_of_an_empty_table(spark):
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_gram_hashes_are_of_words_wherever_they_stand():
    a = license_scan._hash_words("one two three".split())
    b = license_scan._hash_words("zero one two three four".split())
    assert a.tolist() == b[1:4].tolist() and len(set(b.tolist())) == 5
