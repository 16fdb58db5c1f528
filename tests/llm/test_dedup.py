"""Substring dedup (2), line dedup (3)."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparsemill.llm import line_dedup, substring_dedup

from .helpers import corpus, frame, prose, same_rows, simple, texts


def slow_chunks(text):
    """Chunks by the rules, byte by byte: (start, end, words)."""
    m, data, out = substring_dedup, text.encode(), []
    h, start, since, weight, blanks = 0, 0, -1, [], b" \t\n\v\f\r"
    for word in re.finditer(rb"[^ \t\n\v\f\r]+", data):
        a, b = word.span()
        weight += [(x, 1) for x in range(a, b)] if b - a >= m.LONG_WORD else [(a, m.WORD_BYTES)]

    def close(end):
        nonlocal start
        while end - start > m.LONGEST:
            to = start + m.LONGEST
            while data[to] & 0xC0 == 0x80:
                to -= 1
            out.append((start, to))
            start = to
        if end - start >= m.SHORTEST or end == len(data) and end > start:
            out.append((start, end))
            start = end

    for k, c in enumerate(data):
        h = (2 * h + int(m.GEAR[c])) % (1 << 32)
        following = data[k + 1] if k + 1 < len(data) else None
        if c in blanks:
            since = k
            cut = c == 10 or h >> (32 - m.CUT_BITS) == 0 and (following is None or following not in blanks)
        else:
            cut = k - since >= m.UNSPACED and h >> (32 - m.BARE_BITS) == 0 and (following is None or following & 0xC0 != 0x80)
        if cut:
            close(k + 1)
    close(len(data))
    weight = dict(weight)
    return [(a, b, -(-sum(weight.get(x, 0) for x in range(a, b)) // m.WORD_BYTES)) for a, b in out]


def chunk_list(text):
    """(start, end, text without blanks at the end, words) of each chunk with a word."""
    data = text.encode()
    return [(a, b, data[a:b].rstrip(b" \t\n\v\f\r"), w) for a, b, w in slow_chunks(text) if w]


def wanted_passages(rows, min_words=16):
    """By dictionaries: the first place of each chunk, runs, and what goes. Texts under one id are told apart; which of them comes first, by the hash of the text, is given."""
    low = substring_dedup.NO_ID
    first, seen = {}, {}
    rows = {(low if i is None else i, r, t) for i, r, t in rows}
    for i, r, t in rows:
        for a, _, c, _ in chunk_list(t):
            first[c] = min(first.get(c, (i, r, a)), (i, r, a))
            seen.setdefault(c, set()).add((i, r, a))
    out = []
    for i, r, t in rows:
        run = []
        found = [(a, b, w, first[c] != (i, r, a), first[c][0]) for a, b, c, w in chunk_list(t) if len(seen[c]) > 1]
        for x in [*found, None]:
            if run and (x is None or run[-1][1] != x[0] or run[-1][3] != x[3]):
                if sum(y[2] for y in run) >= min_words:
                    source = min(y[4] for y in run)
                    out.append((None if i == low else i, run[0][0], run[-1][1], sum(y[2] for y in run), None if source == low else source, run[0][3]))
                run = []
            if x is not None:
                run.append(x)
    return out


def keyed(spark, rows):
    """(doc_id, hash of the text, text) of all rows."""
    docs = simple(spark, rows).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    return [tuple(r) for r in docs.collect()]


def test_passages(spark):
    rng = random.Random(21)
    kana = "".join(rng.choice("あいうえおかきくけこさしすせそたちつてと") for _ in range(400))
    passage = prose(rng, 120)
    extra = [(2000, kana), (2001, "x" + kana[:200] + "を" + kana[200:]), (None, f"{prose(rng, 30)} {passage} end"), (None, f"{passage} {prose(rng, 40)}"), (2002, passage), (2002, f"{prose(rng, 9)} {passage}"), (2003, "ab" * 900 + "\n" + "ab" * 900)]
    rows = [(r[0], r[1]) for r in corpus()] + extra
    got = substring_dedup.repeated_passages(simple(spark, rows)).select("doc_id", "start", "stop", "n_words", "source_id", "removed").collect()
    want = wanted_passages(keyed(spark, rows))
    assert len(want) > 30 and {2000, 2001, 2002, None} <= {x[0] for x in want}
    same_rows(got, want)


@pytest.mark.parametrize("ids", [(1, 2), (None, None), (7, 7)])
def test_a_long_passage_is_cut_whatever_the_ids(spark, ids):
    rng = random.Random(5)
    passage = prose(rng, 120)
    docs = [(ids[0], f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), (ids[1], f"{prose(rng, 50)} {passage} {prose(rng, 20)}")]
    out = substring_dedup.deduplicate(simple(spark, docs)).collect()
    gone = sorted(len(r.text.split()) - len(r.deduplicated.split()) for r in out)
    assert gone[0] == 0 and gone[1] >= 100


def test_text_without_blanks(spark):
    """An inserted character moves cuts only near itself, and copies are found."""
    rng = random.Random(4)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(1500))
    other = text[:700] + "新" + text[700:]
    a, b = ({c for _, _, c, _ in chunk_list(t)} for t in (text, other))
    assert len(a) > 30 and len(a - b) <= 4
    out = {r.doc_id: r.deduplicated for r in substring_dedup.deduplicate(simple(spark, [(1, text), (2, other)])).collect()}
    assert out[1] == text and len(out[2]) < 200


def test_shared_passages_are_cut_but_for_the_first(spark):
    rng = random.Random(11)
    passage, docs = prose(rng, 60), []
    for i in range(30):
        own = prose(rng, 80).split()
        at = rng.randrange(80)
        docs.append((i, " ".join(own[:at] + (passage.split() if i % 3 == 0 else []) + own[at:])))
    out = substring_dedup.deduplicate(simple(spark, docs))
    by = {r.doc_id: (r.text, r.deduplicated, r.deduplicated_chunks) for r in out.collect()}
    middle = " ".join(passage.split()[22:38])
    for i, _ in docs:
        before, after, n = by[i]
        if i % 3 or i == 0:
            assert after == before and n == 0
        else:
            assert middle not in after and n > 0 and len(after) > 300


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_under_one_id_have_runs_of_their_own(spark, doc_id):
    rng = random.Random(12)
    passage, docs = prose(rng, 60), []
    for _ in range(12):
        own = prose(rng, 80).split()
        at = rng.randrange(80)
        docs.append((doc_id, " ".join(own[:at] + passage.split() + own[at:])))
    out = substring_dedup.deduplicate(simple(spark, docs)).collect()
    middle = " ".join(passage.split()[22:38])
    assert sorted(r.text for r in out) == sorted(t for _, t in docs)
    assert sorted(middle in r.deduplicated for r in out) == [False] * 11 + [True]
    assert all(r.deduplicated == r.text and r.deduplicated_chunks == 0 for r in out if middle in r.deduplicated)
    found = substring_dedup.repeated_passages(simple(spark, docs)).collect()
    assert sum(r.removed for r in found) >= 11 and sum(not r.removed for r in found) >= 1


def test_all_rows_come_back(spark):
    out = substring_dedup.deduplicate(frame(spark))
    assert set(frame(spark).columns) < set(out.columns)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in corpus())
    for r in out.where("text is null").collect():
        assert r.deduplicated is None
    assert substring_dedup.deduplicate(frame(spark, [])).count() == 0 and substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_cuts_resist_insertions():
    rng = random.Random(2)
    text = prose(rng, 3000)
    other = text[:7000] + " inserted words here " + text[7000:]
    a, b = ({x[2] for x in chunk_list(t)} for t in (text, other))
    assert len(a - b) <= 4 and len(b - a) <= 6
    for t in (text, "", "x" * 5000, "é" * 3000, "\n\n\n", " a"):
        ends = substring_dedup.cuts(t.encode())
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(t.encode())] if t else ends == [])
        pieces = [t.encode()[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        assert "".join(p.decode() for p in pieces) == t and all(len(p) <= substring_dedup.LONGEST for p in pieces)


def line_result(spark, rows):
    out = line_dedup.drop_lines(frame(spark, rows))
    return out.select("doc_id", F.col("kept_text_lines").alias("n_lines"), F.col("kept_text_dropped").alias("n_dropped"), F.md5(F.col("kept_text").cast("binary")).alias("text_md5")).collect()


def test_lines_against_sql(spark):
    """The oracle numbers templates by text where the engine has hashes."""
    rows = [r for r in corpus(120) if r[0] != 908]  # a NUL isn't text to all engines
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.array([r[1] for r in rows], dtype="string")})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(line_dedup.oracle()).fetchall()
    got = line_result(spark, rows)
    assert sum(r.n_dropped for r in got) > 5
    same_rows(got, want)


def test_templates(spark):
    rng = random.Random(8)
    names = [w for w in prose(rng, 40).split()]
    rows = []
    for i in range(40):
        rows.append((i, f"{prose(rng, 12)}\nUser session opened for {names[i]} from host number {i * 7}\n{prose(rng, 9)}"))
    by = {r.doc_id: (r.text, r.kept_text) for r in line_dedup.drop_lines(simple(spark, rows)).collect()}
    assert "User session" in by[0][1] and by[0][0] == by[0][1]
    assert all("User session" not in by[i][1] and by[i][1].count("\n") == 1 for i in range(1, 40))


@pytest.mark.parametrize(("n", "m"), [(60, 40), (40, 40), (90, 5)])
def test_templates_that_share_a_leaf(spark, n, m):
    """Both are found, and the lines of neither hide those of the other."""
    rng = random.Random(9)
    name = lambda: prose(rng, 1)
    rows = [(i, f"{prose(rng, 12)}\nthank you for visiting our shop dear {name()} please come again") for i in range(n)]
    rows += [(1000 + i, f"{prose(rng, 12)}\nthank you for reading this blog kindly {name()} subscribe below today") for i in range(m)]
    rows += [(2000, "a line of its own\nthank you for nothing at all and never ever write again")]
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.array([r[1] for r in rows], dtype="string")})
    con = duckdb.connect()
    con.register("documents", documents)
    out = line_dedup.drop_lines(simple(spark, rows))
    got = out.select("doc_id", F.col("kept_text_lines").alias("n_lines"), F.col("kept_text_dropped").alias("n_dropped"), F.md5(F.col("kept_text").cast("binary")).alias("text_md5")).collect()
    same_rows(got, con.sql(line_dedup.oracle()).fetchall())
    assert {r.doc_id for r in got if not r.n_dropped} == {0, 1000, 2000} and len(got) == n + m + 1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a b c d")]])
def test_nothing_to_drop(spark, rows):
    out = line_dedup.drop_lines(simple(spark, rows)).collect()
    assert Counter((r.doc_id, r.kept_text, r.kept_text_dropped) for r in out) == Counter((i, t, 0) for i, t in rows)


def test_native(spark):
    plan = line_dedup.drop_lines(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masks(spark):
    lines = ["a  b\tc9 d", " x 1 2y ", "no digits here", "é5 ü", "9", "a\r"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").orderBy("k").select(line_dedup.masked(F.col("x"))).collect()]
    assert got == ["a b <*> d", "x <*> <*>", "no digits here", "<*> ü", "<*>", "a"]
