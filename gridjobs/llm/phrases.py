"""Phrase collocation mining by top-order marginalisation.

Each word of a piece of text heads one window: itself and, as lead columns, the two words after it, empty where the piece
ends. Only these longest windows are counted. A shorter phrase occurs as often as all windows that begin with it, so
Spark's ROLLUP over the counted windows gives the counts of all pairs, words and languages; no shorter phrase is ever
exploded from the texts.

1. Words are counted, and the commonest of up to 32 bytes, 2 ** 18 at most, get numbers. This dictionary only makes rows
   short: windows hold any other word as text.
2. Numpy makes the windows of a block of texts and adds up equal ones.
3. Windows are shuffled once, by their first two words. A window that is too rare to be a phrase gives up its third word,
   and its second if the pair is too rare: its count stays with the prefix that is left, so no sum of a prefix changes, and
   few rows are left.
4. ROLLUP adds up the prefixes.

A phrase's score is that of its cut into two parts that tells least: floor(10 ** 6 * a * a / (l * r)), where a, l and r
are the counts of the phrase and its parts. Phrases that mostly stand within a longer one are left out.

Defined results: a null text is empty, a null lang is ``und``. Only A-Z are lower-cased. Repeated rows count each. White
space alone has no words. A text over the block size is a block of its own. Of equal scores the higher count, then the
phrase in byte order comes first; of equal cuts the shorter first part. An empty table gives no rows. Other columns,
whatever their names, are not looked at. Products of counts are decimals of 38 digits, exact for counts up to 10 ** 15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .common import materialize, release, table

#: Bytes of text whose equal windows are added up before the shuffle.
COMBINED_BYTES = 4 << 20
#: Bytes that end a piece, and those that stand between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
WORDS = ["w1", "w2", "w3"]
#: Numbered words at most, their bytes at most, and the bits of a number; 0 stands for no word, OTHER for one without number.
DICTIONARY, NUMBERED_BYTES, BITS = 1 << 18, 32, 21
OTHER = (1 << BITS) - 1
SENT_ROWS = 1 << 16


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of its piece; no piece goes over from one text to the next."""
    gap, n = GAP[block.data], len(block.data)
    first = np.zeros(n + 1, bool)
    first[block.starts] = True
    before = first[:n].copy()
    before[1:] |= gap[:-1]
    after = first[1:].copy()
    after[-1:] = True
    after[:-1] |= gap[1:]
    s, e = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return s, e, np.cumsum(BREAK[block.data] | first[:n])[s]


def strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The bytes from each s to e as a string column, after an empty string."""
    ends = np.concatenate([[0, 0], np.cumsum(e - s)])
    at = np.repeat(s - ends[1:-1], e - s) + np.arange(ends[-1])
    return pa.LargeStringArray.from_buffers(len(s) + 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[at])))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word stands in ``docs`` (text)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for _, _, block in blocks(batch.column("text"), lower=True, limit=COMBINED_BYTES):
                s, e, _ = words(block)
                _, where, n = np.unique(block.hashes(s, e), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([strings(block.data, s[where], e[where])[1:].cast(pa.string()), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counted: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The words of up to NUMBERED_BYTES that occur at least as often as the smallest power of two which at most ``most``
    words reach."""
    short = counted.where(F.octet_length("word") <= NUMBERED_BYTES)
    by_power = sorted(((r["p"], r["words"]) for r in short.groupBy(F.floor(F.log2("n") + 1e-12).alias("p")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # under 64 rows
    power, room = 64, most
    for p, n in by_power:
        if n > room:
            break
        power, room = p, room - n
    found = short.where(F.floor(F.log2("n") + 1e-12) >= power).select("word").toArrow().column("word")
    return sorted(found.to_pylist())


class Numbers:
    """Numbers of words from 1, in their order."""

    def __init__(self, found: list[str]):
        self.words = pa.array(found, pa.large_string())
        hashes = [block.hashes(block.starts, block.ends) for _, _, block in blocks(self.words)]
        hashed = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]

    def of(self, hashes: np.ndarray, text: pa.Array) -> np.ndarray:
        """The number of each word, OTHER if it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), OTHER)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(np.asarray(pc.equal(text, self.words.take(pa.array(self.order[at])))), self.order[at] + 1, OTHER)


def windows(docs: DataFrame, numbers: Broadcast) -> DataFrame:
    """lang, pair, head, w3, tail, n: windows of ``docs`` (text, lang), equal ones of a block of texts as one. ``pair`` holds
    the numbers of the first two words, ``w3`` that of the third. ``head`` (joined by a tab) and ``tail`` have the words
    that have no number, and are null if all have one."""

    def text_of(known: pa.Array, words: list[np.ndarray], number: np.ndarray) -> pa.Array:
        """Those of the words that have no number, null if there are none."""
        bare = [known.take(pa.array(np.where(number[w] == OTHER, w, 0))) for w in words]
        some = np.logical_or.reduce([number[w] == OTHER for w in words])
        if not some.any():
            return pa.nulls(len(some), pa.string())
        joined = pc.binary_join_element_wise(*bare, pa.scalar("\t", pa.large_string()))
        return pc.if_else(pa.array(some), joined.cast(pa.string()), pa.scalar(None, pa.string()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("text"), lower=True, limit=COMBINED_BYTES):
                s, e, piece = words(block)
                if not len(s):
                    continue
                hashes, where, word = np.unique(block.hashes(s, e), return_index=True, return_inverse=True)
                known = strings(block.data, s[where], e[where])
                number = np.concatenate([[0], numbers.value.of(hashes, known[1:])])
                langs = batch.column("lang").slice(a, b - a).dictionary_encode()
                lang = np.asarray(langs.indices)[block.rows(s)].astype(np.int64)
                lead = np.zeros((3, len(s)), np.int64)
                lead[0] = word + 1
                for k in (1, 2):
                    lead[k, :-k] = np.where(piece[k:] == piece[:-k], word[k:] + 1, 0)
                wide = len(known)
                pair, of = np.unique((lang * wide + lead[0]) * wide + lead[1], return_inverse=True)
                window, n = np.unique(of * wide + lead[2], return_counts=True)
                for at in range(0, len(n), SENT_ROWS):
                    p, w3 = np.divmod(window[at : at + SENT_ROWS], wide)
                    of_lang, two = np.divmod(pair[p], wide * wide)
                    w1, w2 = np.divmod(two, wide)
                    columns = [langs.dictionary.take(pa.array(of_lang)), pa.array(number[w1] << BITS | number[w2]), text_of(known, [w1, w2], number), pa.array(number[w3]), text_of(known, [w3], number), pa.array(n[at : at + SENT_ROWS])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "pair", "head", "w3", "tail", "n"])

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, pair long, head string, w3 long, tail string, n long")


def shortened(sent: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, n: windows under ``least`` without their third word, those of pairs under ``least`` without their
    second. A word is its text, or a tab and its number."""
    counted = sent.repartition("pair", "lang", "head").groupBy("pair", "lang", "head", "w3", "tail").agg(F.sum("n").alias("n"))
    met = counted.withColumn("common", F.sum("n").over(Window.partitionBy("pair", "lang", "head")) >= least)
    full = F.col("n") >= least
    # a rare pair keeps its first word's number, or its text and the tab
    pair = F.when(F.col("common"), F.col("pair")).otherwise(F.col("pair").bitwiseAND(F.lit(~OTHER)))
    first = F.concat(F.substring_index("head", "\t", 1), F.lit("\t"))
    head = F.when(F.col("common"), F.col("head")).when(first != "\t", first)
    cut = met.select("lang", pair.alias("pair"), head.alias("head"), F.when(full, F.col("w3")).otherwise(0).alias("w3"), F.when(full, F.col("tail")).alias("tail"), "n")
    short = cut.groupBy("pair", "lang", "head", "w3", "tail").agg(F.sum("n").alias("n"))
    word = lambda number, text: F.when(number == OTHER, text).when(number > 0, F.concat(F.lit("\t"), number.cast("string")))
    w1 = word(F.shiftright("pair", BITS), F.substring_index("head", "\t", 1))
    w2 = word(F.col("pair").bitwiseAND(F.lit(OTHER)), F.substring_index("head", "\t", -1))
    return short.select("lang", w1.alias("w1"), w2.alias("w2"), word(F.col("w3"), F.col("tail")).alias("w3"), "n")


def frequent(docs: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, n: how often each phrase of one to three words occurs, if ``least`` times or more, with null for
    the words that it lacks; and the number of words of each lang, with null for all three."""
    spark = docs.sparkSession
    counted = materialize(word_counts(docs), "words")
    found = commonest(counted)
    release(counted)
    short = shortened(windows(docs, spark.sparkContext.broadcast(Numbers(found))), least)
    sums = short.rollup("lang", *WORDS).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))
    # a null that ROLLUP did not put there stands for a word that a window lacks or gave up
    phrase = F.lit(False)
    for level, word in ((0, "w3"), (1, "w2"), (3, "w1")):
        phrase = phrase | ((F.col("level") == level) & F.col(word).isNotNull())
    kept = sums.where((phrase & (F.col("n") >= least)) | (F.col("level") == 7)).drop("level")
    named = spark.createDataFrame(pa.table([pa.array([f"\t{i}" for i in range(1, len(found) + 1)], pa.string()), pa.array(found, pa.string())], ["number", "word"]))
    for w in WORDS:
        kept = kept.join(named.select(F.col("number").alias(w), F.col("word").alias(f"{w} word")), w, "left").withColumn(w, F.coalesce(f"{w} word", w)).drop(f"{w} word")
    return kept.select("lang", *WORDS, "n")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10 ** 6 * a * a / (left * right)), exactly; at most 10 ** 6, as a part occurs as often as its phrase."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two and three words of each lang that occur
    ``least`` times or more, without those of which a longer one has ``share`` per cent or more of the occurrences."""
    known = materialize(frequent(docs, least), "phrases")
    size = sum((F.col(w).isNotNull().cast("int") for w in WORDS), F.lit(0))
    of = {k: known.where(size == k) for k in range(4)}
    word = lambda w, n: of[1].select("lang", F.col("w1").alias(w), F.col("n").alias(n))
    pair = lambda a, b, n: of[2].select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(n))

    two = of[2].drop("w3").join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    within = of[3].select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = within.groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longer"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("n") * share, F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", score(F.col("n"), F.col("l"), F.col("r")).alias("score"))

    three = of[3].join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
    three = three.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"])
    cut = lambda k: F.struct(score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("n").alias("a"), F.least(cut(1), cut(2)).alias("c"))
    three = three.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # tasks keep their own first rows of a lang before they meet
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = of[0].select("lang", "n")
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


_COUNTS = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
 c1 as (select lang, x as p, count(*) as n from (select lang, unnest(w) as x from w) group by all),
 c2 as (select lang, a, b, a || ' ' || b as p, count(*) as n from (select lang, w[i] as a, w[i + 1] as b from (select lang, w, unnest(range(1, len(w))) as i from w)) group by all having count(*) >= 10),
 c3 as (select lang, a, b, c, a || ' ' || b || ' ' || c as p, count(*) as n from (select lang, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select lang, w, unnest(range(1, len(w) - 1)) as i from w)) group by all having count(*) >= 10)"""
SQL = _COUNTS + r""",
 cuts as (select c2.lang, c2.p as phrase, c2.n as a, 1 as k, x.n as l, y.n as r from c2 join c1 x on x.lang = c2.lang and x.p = c2.a join c1 y on y.lang = c2.lang and y.p = c2.b
  where not exists (select 1 from c3 where c3.lang = c2.lang and ((c3.a = c2.a and c3.b = c2.b) or (c3.b = c2.a and c3.c = c2.b)) and 100 * c3.n >= 50 * c2.n)
  union all select c3.lang, c3.p, c3.n, 1, x.n, y.n from c3 join c1 x on x.lang = c3.lang and x.p = c3.a join c2 y on y.lang = c3.lang and y.a = c3.b and y.b = c3.c
  union all select c3.lang, c3.p, c3.n, 2, x.n, y.n from c3 join c2 x on x.lang = c3.lang and x.a = c3.a and x.b = c3.b join c1 y on y.lang = c3.lang and y.p = c3.c),
 scored as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
 least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least_cut)
 select lang, rank, phrase, a, l, r, t.n::bigint as n, score from ranked join (select lang, sum(n) as n from c1 group by lang) t using (lang) where rank <= 2000"""
