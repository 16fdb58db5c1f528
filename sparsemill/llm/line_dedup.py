"""Lines of recurring templates, by a fixed-depth tree, in DataFrame functions alone.

A line's words are parted by white space, and words that hold a digit become <*>.
The tree parts lines by how many words they have, then by their first LEAD words.
A leaf that lines of min_docs documents reach gets a template: at each place the
word that more than half of its lines have, else a variable field. If enough of it
is fixed, the leaf's lines that agree with it on enough fixed words belong to it, and
the others are a leaf of their own; if not, the leaf is parted by its first open
place: lines with the most frequent word there, and the others. That is done LEVELS
times, while enough lines are left;
any other line is a template of its own. Where lines of min_docs documents belong
to a template, its first line by (doc_id, place) stays and all others are dropped.

Lines are counted by their masked text before words are, and every join is one of
two plain shuffles, so that neither a very common line nor a full leaf is gathered.

Defined results: a null text stays null and has no lines; lines of fewer than
min_words words stay; rows that repeat an id and a text are one document; rows of
one id but different texts count as one document but keep lines of their own; rows
of null id count as one smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

LEAD = 3
#: How often a leaf is looked at: what doesn't belong to its template, or has none, parts further below.
LEVELS = 4
MASK = "<*>"
#: A word that holds a digit, in words parted by single spaces. Possessive, and only from a word's start: linear for any text.
WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
NO_ID = -(1 << 63)


def masked(line: Column) -> Column:
    """The line's words, parted by single spaces, words that hold a digit as <*>. Replacing is slow, so lines without anything to replace are only searched."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[\x09-\x0D]")
    spaced = F.when(odd, F.trim(F.regexp_replace(line, r"[\x09-\x0D\x20]+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, WITH_DIGIT, MASK)).otherwise(spaced)


def _lines(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """d, r (hash of the text), i, masked, leaf of each line of min_words words or more."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("r"), F.posexplode(F.transform(F.split(text, "\n"), masked)).alias("i", "masked"))  # masked before they are rows: what reads it later doesn't compute it again
    # Blanks are single by now, so that words are blanks and one.
    rows = rows.withColumn("n", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_words)
    # A leaf's number may, by chance, stand for two leaves: that only spoils a template. Lines are told apart by an MD5 of their own.
    return rows.withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", LEAD)))


def templates(kinds: DataFrame) -> DataFrame:
    """leaf, fixed, n, template (words; null for a variable field), open (the first variable field's place and most frequent word). kinds: leaf, masked, times."""
    words = kinds.select("leaf", "times", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    counted = words.groupBy("leaf", "at", "word").agg(F.sum("times").alias("c"))
    best = counted.groupBy("leaf", "at").agg(F.max(F.struct("c", "word")).alias("top"), F.sum("c").alias("all"))
    sure = 2 * F.col("top.c") > F.col("all")
    fixed = best.select("leaf", F.struct("at", F.when(sure, F.col("top.word")).alias("word")).alias("x"), F.when(~sure, F.struct("at", "top.word")).alias("open"))
    return fixed.groupBy("leaf").agg(F.count("x.word").alias("fixed"), F.count("*").alias("n"), F.array_sort(F.collect_list("x")).getField("word").alias("template"), F.min("open").alias("open"))


def members(kinds: DataFrame, min_docs: int, min_fixed: float, similarity: float) -> DataFrame:
    """own, of (the template) of the kinds of lines (leaf, own, masked, times) that belong to a leaf's template."""
    found = []
    for level in range(LEVELS):
        words = F.split("masked", " ")
        agree = F.aggregate(F.zip_with(words, "template", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        good = F.col("fixed") >= min_fixed * F.col("n")
        below = F.when(good, F.xxhash64("leaf", F.lit(level))).otherwise(F.xxhash64("leaf", F.lit(level), F.get(words, F.col("open.at")) == F.col("open.word")))
        looked = kinds.join(templates(kinds), "leaf").select("leaf", "own", "masked", "times", (good & (agree >= similarity * F.col("fixed"))).alias("belongs"), below.alias("below"))
        looked = stored(looked, "looked")
        found.append(looked.where("belongs").select("own", F.col("leaf").alias("of")))
        if level + 1 == LEVELS:
            break
        rest = looked.where("not belongs").select(F.col("below").alias("leaf"), "own", "masked", "times")
        enough = stored(rest.groupBy("leaf").agg(F.sum("times").alias("lines")).where(F.col("lines") >= min_docs).select("leaf"), "enough")
        kinds = stored(rest.join(enough, "leaf"), "rest")
    return functools.reduce(DataFrame.union, found)


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_words: int = 3, min_fixed: float = 0.6, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, r, i of each line that is dropped."""
    lines = _lines(docs, min_words, id_col, text_col)
    leaves = stored(lines.groupBy("leaf").agg(F.count_distinct("d").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    cand = stored(lines.join(leaves, "leaf").select("leaf", "d", "r", "i", "masked", F.unhex(F.md5(F.col("masked").cast("binary"))).alias("own")), "candidates")
    kinds = stored(cand.groupBy("leaf", "own").agg(F.count("*").alias("times"), F.min("masked").alias("masked")), "kinds")
    member = stored(members(kinds, min_docs, min_fixed, similarity), "members")
    named = stored(cand.select("d", "r", "i", "own").join(member, "own", "left").select("d", "r", "i", F.coalesce(F.unhex(F.hex("of")), "own").alias("template")), "named")
    recurring = named.groupBy("template").agg(F.count_distinct("d").alias("docs"), F.min(F.struct("d", "i", "r")).alias("first"))
    recurring = stored(recurring.where(F.col("docs") >= min_docs).select("template", "first"), "recurring")
    return named.join(recurring, "template").where(F.struct("d", "i", "r") != F.col("first")).select("d", "r", "i")


def drop_lines(docs: DataFrame, min_docs: int = 3, min_words: int = 3, min_fixed: float = 0.6, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text") -> DataFrame:
    """docs with out_col (the text without dropped lines), out_col + '_lines' (lines before) and out_col + '_dropped'."""
    own_d, own_r, d, r, dropped = fresh(docs, "own_d", "own_r", "d", "r", "gone")
    gone = dropped_lines(docs, min_docs, min_words, min_fixed, similarity, id_col, text_col)
    gone = gone.groupBy(F.col("d").alias(d), F.col("r").alias(r)).agg(F.array_sort(F.collect_set("i")).alias(dropped))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({own_d: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), own_r: F.xxhash64(text)})
    both = keyed.join(gone, (F.col(own_d) == F.col(d)) & (F.col(own_r) == F.col(r)), "left")

    def without(lines: Column) -> Column:
        """Stretches between dropped lines, joined: linear in lines."""
        ends = F.concat(F.col(dropped), F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda x: x + 1))
        kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"]))
        return F.array_join(F.flatten(kept), "\n")

    # The text is split once, as the only element of an outer list.
    cut = F.element_at(F.transform(F.array(F.split(text, "\n")), without), 1)
    kept_text = F.when(F.col(dropped).isNull(), text).otherwise(cut)
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.greatest(F.size(dropped), F.lit(0)).cast("long")
    return both.select(*docs.columns, kept_text.alias(out_col), F.coalesce(n, F.lit(0)).cast("long").alias(f"{out_col}_lines"), n_dropped.alias(f"{out_col}_dropped"))


def oracle(min_docs: int = 3, min_words: int = 3, min_fixed: float = 0.6, similarity: float = 0.8) -> str:
    """The same as DuckDB's SQL over documents: doc_id, n_lines, n_dropped, text_md5."""
    levels = "".join(
        rf"""
counted{k} as (select leaf, at_, word, sum(times) c from (select leaf, times, unnest(w) word, generate_subscripts(w, 1) at_ from kinds{k}) group by all),
best{k} as (select leaf, at_, max({{'c': c, 'w': word}}) top, sum(c) total from counted{k} group by leaf, at_),
trees{k} as (select leaf, count(*) filter (2 * top.c > total) fixed, count(*) n, list(case when 2 * top.c > total then top.w end order by at_) t, min({{'at_': at_, 'w': top.w}}) filter (2 * top.c <= total) open_ from best{k} group by leaf),
looked{k} as (select kinds{k}.*, fixed >= {min_fixed} * n good, fixed >= {min_fixed} * n and len(list_filter(list_zip(w, t), lambda x: x[1] = x[2])) >= {similarity} * fixed belongs, open_ from kinds{k} join trees{k} using (leaf)),
rest{k} as (select case when good then concat(leaf, ' /{k}') else concat(leaf, ' /{k} ', w[open_.at_] = open_.w) end leaf, m, w, times from looked{k} where not belongs),
kinds{k + 1} as (select * from rest{k} where leaf in (select leaf from rest{k} group by leaf having sum(times) >= {min_docs})),"""
        for k in range(LEVELS)
    )
    member = " union all ".join(f"select m, leaf from looked{k} where belongs" for k in range(LEVELS))
    return rf"""
with docs as (select coalesce(doc_id, {NO_ID}) d, md5(text) r, string_split(text, chr(10)) ls, text from documents),
split_ as (select d, r, unnest(ls) line, generate_subscripts(ls, 1) - 1 i from docs where text is not null),
masked_ as (select d, r, i, regexp_replace(trim(regexp_replace(line, '[	- ]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{MASK}', 'g') m from split_),
worded as (select d, r, i, m, string_split(m, ' ') w from masked_ where len(string_split(m, ' ')) >= {min_words}),
leafed as (select *, concat(len(w), ' ', array_to_string(w[1:{LEAD}], ' ')) leaf from worded),
cand as (select * from leafed where leaf in (select leaf from leafed group by leaf having count(distinct d) >= {min_docs})),
kinds0 as (select leaf, m, w, count(*) times from cand group by all),{levels}
member as ({member}),
named as (select c.d, c.r, c.i, case when member.m is not null then 'leaf ' || member.leaf else 'own ' || c.m end template from cand c left join member on member.m = c.m),
recurring as (select template, min((d, i, r)) first_ from named group by template having count(distinct d) >= {min_docs}),
gone as (select distinct d, r, i from named join recurring using (template) where (d, i, r) <> first_),
lists as (select d, r, list(i) gone from gone group by d, r)
select case when d <> {NO_ID} then d end doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(gone), 0)::bigint n_dropped,
  md5(case when gone is null then text else array_to_string([ls[k] for k in range(1, len(ls) + 1) if not list_contains(gone, k - 1)], chr(10)) end) text_md5
from docs left join lists using (d, r)
"""
