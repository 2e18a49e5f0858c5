"""Groups of spelling variants, by rotations of terminator-marked words.

Two words that differ by one replaced letter share the rotation that puts the
letter last, but for that letter; where one word has one letter more, that
rotation without its last letter is a whole rotation of the other word. So every
word gives, for each letter, the rotation up to that letter, and all of its own
rotations. Sorted, words one edit apart stand in one group of equal beginnings.
A group holds words that differ in one letter at one place, and at most one that
lacks it: with the 90 letters of :data:`RUN`, 91 words at most. It is scanned,
never paired off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix, read_table, staged

#: Letters that make up a run; only A to Z have a lower case here.
RUN = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH, LEAST_COUNT, TIMES, ODD = 7, 2, 10, 31
#: Ends a word; no letter of RUN.
END = "$"
#: A longer rotation is its beginning and a digest, so that a word's rows grow with its length, not with the square.
WHOLE = 128
# how a word stands in a group: all of it; without a letter; without a letter that repeats the one before it
ALL, WITHOUT, REPEATED = 0, 1, 2


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of letters, lower-cased, one letter left out where a hash says so.

    Shorter words than LEAST_LENGTH and rarer ones than LEAST_COUNT are left out. A null text has no words,
    a null doc_id hashes as the empty string; repeated rows count each time.
    """
    pattern = f"([{RUN}]{{{LEAST_LENGTH},}})"  # shorter runs give no word
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, UPPER.lower()))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", hashed.alias("h"))
    at = "CAST(h % length(run) AS INT)"
    word = F.when(F.col("h") % ODD == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _short(rotation: str) -> Column:
    return F.expr(f"CASE WHEN length({rotation}) <= {WHOLE} THEN {rotation} ELSE concat(left({rotation}, {WHOLE // 2}), md5({rotation})) END")


def rotations(numbered: DataFrame) -> DataFrame:
    """(key, m): m is (less, rank, kind) of each word (word, n, rank) in each group it may stand in; less is -n."""
    member = lambda kind: F.struct((-F.col("n")).alias("less"), "rank", kind.cast("int").alias("kind")).alias("m")
    skip = numbered.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("word"))))
    # of letters in a row that are the same, only the first is left out: else two words would meet more than once
    again = F.expr("i > 1 AND substring(word, i, 1) = substring(word, i - 1, 1)")
    skip = skip.select(_short(f"concat(substring(word, i + 1), '{END}', substring(word, 1, i - 1))").alias("key"), member(F.when(again, REPEATED).otherwise(WITHOUT)))
    own = numbered.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("word"))))
    own = own.select(_short(f"concat(substring(word, i + 1), '{END}', substring(word, 1, i))").alias("key"), member(F.lit(ALL)))
    return skip.unionByName(own)


def neighbours(numbered: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are one edit away, and the most frequent of them as (less, rank)."""
    groups = rotations(numbered).groupBy("key").agg(F.collect_list("m").alias("ms")).filter(F.size("ms") > 1)
    near = "filter(ms, x -> x.rank <> m.rank AND (x.kind > 0 AND m.kind > 0 OR x.kind + m.kind = 1))"
    each = groups.select(F.explode("ms").alias("m"), "ms").select("m.rank", F.expr(near).alias("near"))
    best = F.array_min(F.transform("near", lambda x: F.struct(x["less"].alias("less"), x["rank"].alias("rank"))))
    each = each.filter(F.size("near") > 0).select("rank", F.size("near").alias("k"), best.alias("best"))
    return each.groupBy("rank").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root) from (rank, root: the next word): each step doubles the way; counts grow tenfold, so five steps at most."""
    now = Scratch()
    forms = now.keep(forms, "forms")
    while True:
        there = forms.select(F.col("rank").alias("root"), F.col("root").alias("on"))
        after = Scratch()
        moved = after.keep(forms.join(there, "root", "left").select("rank", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "forms")
        now.clear()
        now, forms = after, moved.select("rank", "root")
        if moved.filter("moved").isEmpty():
            found = staged(forms, "roots")
            now.clear()
            return found


def group_variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) of the letters of :data:`RUN`.

    Words are near if they differ by exactly one inserted, deleted or replaced
    letter. A word's form is its most frequent near word, of equals the smallest,
    if it is ``times`` as frequent or more; its root is the last of the forms of
    forms, the word itself if it has none. An empty table gives none.
    """
    # a word's rank among all stands for it: it keeps the order
    numbered = staged(prefix(counted.select("word", "n"), ["word"], "n", "words").select("word", "n", F.col("__rank").alias("rank")), "numbered")
    near = staged(neighbours(numbered), "near")
    with_form = numbered.join(near, "rank", "left").withColumn("form_n", F.when(-F.col("best.less") >= F.col("n") * times, -F.col("best.less")))
    forms = with_form.filter("form_n IS NOT NULL").select("rank", F.col("best.rank").alias("form"))
    roots = _roots(forms.select("rank", F.col("form").alias("root")))
    name = lambda c: numbered.select(F.col("rank").alias(f"__{c}"), F.col("word").alias(c))
    named = forms.join(roots, "rank").withColumnsRenamed({"form": "__form", "root": "__root"}).join(name("form"), "__form").join(name("root"), "__root")
    out = with_form.join(named.select("rank", "form", "root"), "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return group_variants(words(read_table(spark, sf_dir, "documents")))


#: CRC-32 by a table of 256 entries; one edit by wildcards and deletions.
OP11_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
found AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM cut),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS most FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS form, any_value(p.m) AS form_n FROM pairs p JOIN near USING (word) WHERE p.m = near.most GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, w.n, b.form, b.form_n FROM words w JOIN best b USING (word) WHERE b.form_n >= 10 * w.n),
way(word, last) AS (SELECT word, form FROM forms UNION SELECT y.word, f.form FROM way y JOIN forms f ON f.word = y.last)
SELECT w.word, f.form, coalesce(r.last, w.word) AS root, w.n, coalesce(near.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN near USING (word) LEFT JOIN forms f ON f.word = w.word
LEFT JOIN (SELECT word, last FROM way WHERE last NOT IN (SELECT word FROM forms)) r ON r.word = w.word"""
