"""A small corpus with copies, near copies, shared passages and lines, junk, hard rows, and columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, d long, i int, text_key long, _gone string, vec string, counts long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "tu", "vo", "ze", "été", "ß") for b in ("ban", "cor", "dis", "fel", "gor", "hin", "jam", "kle", "mor", "nep")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows():
    """Rows that must not break anything."""
    long = "lang wort " * 20_000 + "x" * 50_000
    return [
        (900, None),
        (901, ""),
        (902, " \n\t \n"),
        (903, long),
        (904, "y" * 30_000),
        (905, "mit License.\n\nMIT  license! \n"),
        (906, "only two"),
        (906, "only two"),
        (907, "one id\nbut two texts of it here"),
        (907, "another text under the same id as before"),
        (None, "a row without an id, and a few more words"),
        (None, None),
        (908, "日本語のテキスト " * 10 + "\r\nline\u0085separator here\x00nul"),
        (909, "<|endoftext|> <s> ​ zero width 👍🏽 emoji"),
    ]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "This notice number 17 is repeated by us"
    rows = []
    for k in range(n):
        text = "\n".join(prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 4)))
        if k % 10 == 1:
            text = rows[-1][1]  # a copy
        elif k % 10 == 3:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif k % 10 == 5:
            text = f"{text} {passage} {prose(rng, 30)}"
        elif k % 10 == 7:
            text = f"{text}\n{line.replace('17', str(k))}\n{prose(rng, 20)}"
        elif k % 10 == 9:
            text = " ".join(f"{w}***" for w in text.split())
        rows.append((k, text))
    rows += hard_rows()
    return [(i, t, ("en", "de", "fr", "es", None, "xx")[k % 6], f"src{k % 3}", None if t is None else len(t), 1, 2, 3, 4, "g", "v", 5) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def simple(spark, rows):
    """doc_id, text rows under the full schema."""
    return frame(spark, [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, "g", "v", 5) for i, t in rows])


def texts(rows=None):
    """(doc_id, text with null as empty) of all rows."""
    return [(r[0], r[1] or "") for r in (corpus() if rows is None else rows)]


def same_rows(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
