"""Near-duplicate lines by an exact set-similarity join, in SQL functions only.

Two lines are alike if the sets of their words overlap by four fifths of their union. With all words in one order, rare ones
first, two alike sets share a few words within their prefixes, so only prefix words are joined. Lengths and the positions of the
shared words rule most candidates out; the rest is verified on the words themselves.

What is asked of a line is whether an earlier one is alike, not which ones are. So each line first meets a few pivots, the earliest lines with
which it shares most of its rarest words. Where one is alike the line is settled: it stays as a partner for later lines but asks no more. In a
group of near copies nearly all are settled by a few comparisons for each line; the join of all prefixes is left to the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, few_rows, materialise, spare_names, table

#: Words are counted in so many cells, each standing for the words that hash to it; a fixed number, whatever the corpus.
CELLS = 1 << 18
#: Up to so many keys of lines are broadcast; beyond, lines are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: A line looks for pivots by so many of its rarest words and meets so many of the lines that it shares most of them with.
RAREST, PIVOTS = 8, 4
#: Lines with a word that 2^HOT lines or more have look for pivots in parts of about that size.
HOT = 16

#: Prefix words are joined in so many rounds.
ROUNDS = 3

#: Words that alike sets must share within their prefixes. Up to 250 words parities tell most pairs apart; larger sets must share more.
SHARED = "IF({0} >= 250, 5, 1)"
#: Sets of so many words have parities of 128 bits.
LONG = 100
PREFIX = f"(n - (4 * n + 4) DIV 5 + {SHARED.format('n')})"  # length of the prefix in which a set that is alike shares so many
#: Four fifths of the union of sets of n and m words are four ninths of n + m.
ALIKE = "9 * size(array_intersect({0}, {1})) >= 4 * (size({0}) + size({1}))"


def _pieces(text: Column) -> Column:
    """Text between blanks, some of it empty. Splitting at one literal character needs no pattern; rare blanks are mapped first."""
    rare = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in "\t\r\x0b\x0c"])
    return F.split(F.when(rare, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text), " ")


def _words(line: Column) -> Column:
    return F.array_except(_pieces(line), F.array(F.lit("")))  # each word once


def _with_lines(text: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of the lines of a text, which is split once, not once for each place where ``use`` names them."""
    return F.transform(F.array(F.split(text, "\n")), use)[0]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t and text; t, the hash of the text, tells rows apart that repeat an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """id, t, line_no, 96-bit key k1, k2 and the words h, for lines with a word and for line 0 of each row.

    Words are distinct by hashes of 64 bits, of which 31 are kept: words that agree in these have an entry each. Lines without a word have no key.
    """
    split = rows.select("id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    full = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    hashes = F.array_except(F.transform(_pieces(F.col("line")), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    keys = {"k1": F.when(full, F.xxhash64("line")), "k2": F.when(full, F.hash("line")), "h": hashes}
    found = split.where(full | (F.col("line_no") == 0)).select("id", "t", "line_no", *[c.alias(name) for name, c in keys.items()])
    return found.withColumn("h", F.transform("h", lambda x: F.shiftrightunsigned(x, 33).cast("int")))


def _levels(lines: DataFrame) -> Column:
    """A number for each cell, as one literal array: three times the binary logarithm of the number of lines' words in it, over all documents."""
    cells = lines.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(CELLS - 1).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    dense = lines.sparkSession.range(0, CELLS, 1, 1).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("n")).unionByName(cells)
    dense = dense.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("level", F.expr("IF(n = 0, 0L, 1 + floor(3 * log2(n)))"))
    text = dense.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "level"))), lambda x: x["level"].cast("string")), ",").alias("levels"))
    return F.split(F.lit(text.first()["levels"]), ",").cast("array<bigint>")  # CELLS numbers, whatever the corpus


def _sets(lines: DataFrame) -> DataFrame:
    """k1, k2, first place, whether there are others, number n of words, bits, hi and prefix of every text of a line. Words are numbers: rarity, then 31 bits of hash.

    ``bits`` has the parity of the words that fall to each of 64 bits, so two sets differ in at least as many words as bits. Of long
    sets ``hi`` has those of the upper half of 128 bits.
    """
    levels = _levels(lines)
    # without nulls, numbers are sorted as such
    number = lambda h: F.coalesce(F.shiftleft(F.get(levels, h.bitwiseAND(CELLS - 1)), 31) + h, F.lit(0).cast("long"))
    found = lines.where("k1 IS NOT NULL").select("k1", "k2", F.struct("id", "t", "line_no").alias("at"), F.size("h").alias("n"), "h", F.sort_array(F.transform("h", number)).alias("s"))
    bits = F.expr("aggregate(h, 0L, (acc, x) -> acc ^ shiftleft(1L, x & 63))")
    hi = F.expr(f"IF(n >= {LONG}, aggregate(h, 0L, (acc, x) -> IF(x & 64 = 0, acc, acc ^ shiftleft(1L, x & 63))), 0L)")
    found = found.select("k1", "k2", "at", F.struct("n", bits.alias("bits"), hi.alias("hi"), F.expr(f"slice(s, 1, {PREFIX})").alias("prefix")).alias("s"))
    return found.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("s").alias("s")).select("k1", "k2", "first", (F.col("first") < F.col("last")).alias("again"), "s.*")


def _order(rows: DataFrame) -> Column:
    """A number of 31 bits that never falls along the order of ``first``: ids scaled to their range; 0 for ids that are no integers."""
    if not isinstance(rows.schema["id"].dataType, T.IntegralType):
        return F.lit(0)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return F.lit(0)
    step = max(1.0, (high - low + 1) / 2**30)
    return F.coalesce(F.floor((F.col("first.id").cast("double") - float(low)) / step).cast("int"), F.lit(-1))


def _coded(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """With ``code``, 31 bits of order and 32 of the key: stands for a line among candidates. Where lines share a code by chance, all of them are compared."""
    return sets.withColumn("code", F.shiftleft(_order(rows).cast("long"), 32).bitwiseOR(F.col("k1").bitwiseAND(0xFFFFFFFF)))


#: Whether sets of an and bn words may overlap enough by their sizes and parities; without ``hi`` of both, 64 bits are compared.
LIKELY = """5 * an >= 4 * bn AND 5 * bn >= 4 * an
    AND 9 * IF(ahi = 0 OR bhi = 0, bit_count(abits ^ bbits), bit_count(abits ^ ahi ^ bbits ^ bhi) + bit_count(ahi ^ bhi)) <= an + bn"""


def _pivots(firsts: DataFrame) -> DataFrame:
    """Pairs of codes (a, b): for the rarest words of a, the lines of least code that have them among theirs, if they are likely to be alike."""
    rarest = firsts.select("code", "n", "bits", "hi", F.explode(F.slice("prefix", 1, RAREST)).alias("s"))
    parts = F.expr(f"shiftleft(1, greatest(cast(shiftright(s, 31) DIV 3 AS int) - {HOT}, 0))")
    rarest = rarest.select("code", "n", "bits", "hi", F.col("s").bitwiseAND(0x7FFFFFFF).cast("int").alias("word"), F.pmod(F.hash("code"), parts).alias("part"))
    lists = W.partitionBy("word", "part").orderBy("code").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rarest.select(*[F.col(c).alias(f"a{c}") for c in ("code", "n", "bits", "hi")], *[F.first(c).over(lists).alias(f"b{c}") for c in ("code", "n", "bits", "hi")])
    votes = met.where(F.expr(f"acode != bcode AND {LIKELY}")).groupBy(F.col("acode").alias("a"), F.col("bcode").alias("b")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("votes"), "b"))), 1, PIVOTS).alias("best"))  # RAREST entries at most
    return best.select("a", F.explode("best.b").alias("b"))


def _candidates(firsts: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of codes (a, b) of an open line and any that is not later, which share enough prefix words at places where lengths, positions and
    parities leave room for the overlap. Two lines that share a code by chance meet under it.

    Words are joined in a few rounds, each a share of all words, so that shuffle files of one round at a time are on disk.
    """

    def posts(lines: DataFrame, side: str, turn: int) -> DataFrame:
        words = lines.select("code", "n", "bits", "hi", F.posexplode("prefix").alias("at", "s")).where(F.pmod("s", F.lit(ROUNDS)) == turn)
        place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at"))  # one number, for less to shuffle
        return words.select(F.col("code").alias(side), place.alias(f"{side}place"), F.col("bits").alias(f"{side}bits"), F.col("hi").alias(f"{side}hi"), F.col("s").bitwiseAND(0x7FFFFFFF).cast("int").alias(f"{side}word"))

    need = SHARED.format("least(an, bn)")
    room = f"9 * (least(an - aat, bn - bat) + {need} - 1) >= 4 * (an + bn) AND {LIKELY}"
    for name, value in {side + part: code.format(f"{side}place") for side in "ab" for part, code in {"n": "shiftright({}, 32)", "at": "({} & 4294967295)"}.items()}.items():
        room, need = re.sub(rf"\b{name}\b", value, room), re.sub(rf"\b{name}\b", value, need)
    earlier = "shiftright(b, 32) <= shiftright(a, 32) AND (a != b OR aplace != bplace OR abits != bbits)"
    open_, near = firsts.join(settled, ["k1", "k2"], "left_anti"), []
    for turn in range(ROUNDS):
        met = posts(open_, "a", turn).join(posts(firsts, "b", turn), F.expr(f"aword = bword AND {room} AND {earlier}"))
        near.append(materialise(met.groupBy("a", "b").agg(F.count("*").alias("found"), F.max(F.expr(need)).alias("need")), "line-near"))
    return reduce(DataFrame.unionByName, near).groupBy("a", "b").agg(F.sum("found").alias("found"), F.max("need").alias("need")).where("found >= need").select("a", "b")


def _linked(pairs: DataFrame, firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """k1 and k2 of the lines that have an earlier partner among the pairs of codes, judged by the words themselves."""
    ends = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).distinct()
    keys = firsts.select("k1", "k2", "first", "code").join(few_rows(materialise(ends, "line-codes"), BROADCAST_KEYS), "code", "left_semi")
    keys = materialise(keys.select("k1", "k2", "first", "code", "first.*"), "line-keys")
    # each line is taken from where it stands first, and a text is split once for all its lines
    k = keys.groupBy(F.col("id").alias("own"), F.col("t").alias("hash")).agg(F.collect_list(F.struct("k1", "k2", "first", "code", "line_no")).alias("wanted"))
    k = F.broadcast(k) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else k
    found = rows.join(k, F.expr("id <=> own AND t = hash")).select(_with_lines("text", lambda all_: F.transform("wanted", lambda w: F.struct(w.alias("k"), F.get(all_, w["line_no"]).alias("line")))).alias("found"))
    texts = found.select(F.explode("found").alias("f")).select("f.k.k1", "f.k.k2", "f.k.first", "f.k.code", "f.line")
    words = materialise(texts.distinct(), "line-texts").withColumn("w", _words(F.col("line")))
    a, b = (words.select(F.col("code").alias(side), F.struct("first", "k1", "k2").alias(f"{side}_key"), F.col("w").alias(f"{side}_w")) for side in ("a", "b"))
    alike = a.join(few_rows(pairs, BROADCAST_KEYS), "a").join(b, "b").where("a_key != b_key").where(ALIKE.format("a_w", "b_w"))
    return alike.select(F.greatest("a_key", "b_key").alias("later")).select("later.k1", "later.k2").distinct()


def line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_lines, n_removed, n_links, removed) for each document: its lines with a word, those that go, how many of these
    go because of a link, an alike earlier line of another text (and not as repeats alone), and the numbers (from 0) of the lines that go.

    Lines are separated by ``\\n``. A line goes if an earlier one, by id, hash of the text and line number, has an alike set of words, as judged on
    the input; each such link is found, whatever the size of a group, though not all partners of a line are listed. Lines without a word stay
    and are not counted. Null and empty texts have no line. Rows without an id are documents, which come first. Rows that
    repeat an id and a text count as one document, rows that repeat an id with other texts as several, which ``text_hash`` tells apart. Texts
    may be of any length and are read whole. An empty table gives no row; further columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    words = materialise(_lines(rows), "line-words")
    firsts = materialise(_coded(_sets(words), rows), "first-lines")
    lines = materialise(words.drop("h"), "lines")
    discard(words)
    settled = materialise(_linked(materialise(_pivots(firsts), "line-pairs"), firsts, rows), "settled-lines")
    pairs = materialise(_candidates(firsts, few_rows(settled, BROADCAST_KEYS)), "line-pairs")
    links = settled.unionByName(_linked(pairs, firsts, rows)).distinct().withColumn("linked", F.lit(True))
    links = few_rows(materialise(links, "line-links"), BROADCAST_KEYS)
    bounds = firsts.select("k1", "k2", "first", "again").join(links, ["k1", "k2"], "left").where("again OR linked")
    bounds = few_rows(materialise(bounds.select("k1", "k2", "first", "linked"), "line-bounds"), BROADCAST_KEYS)
    marked = lines.join(bounds, ["k1", "k2"], "left")
    gone = F.coalesce(F.col("linked") | (F.struct("id", "t", "line_no") > F.col("first")), F.lit(False))
    marks = marked.groupBy("id", "t").agg(
        F.count("k1").alias("n_lines"), F.count_if(gone).alias("n_removed"), F.count_if("linked").alias("n_links"), F.count_if(F.col("line_no") == 0).alias("times"),
        F.array_sort(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
    )
    counts = [F.expr(f"{c} DIV times").alias(c) for c in ("n_lines", "n_removed", "n_links")]
    return marks.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), *counts, "removed")


def remove_lines(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the marked lines; documents of which no line is left go. The marks are those of ``docs`` itself, so each row finds
    those of its id and text, null ids included; the names of further columns do not matter. An empty table gives an empty one."""
    row_id, row_hash, removed, none_left = spare_names(docs, 4)
    few = marks.where("n_removed > 0").select(F.col(id_col).alias(row_id), F.col("text_hash").alias(row_hash), F.col("removed").alias(removed), (F.col("n_lines") == F.col("n_removed")).alias(none_left))
    same = docs[id_col].eqNullSafe(few[row_id]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == few[row_hash])
    joined = docs.join(few, same, "left").where(~F.coalesce(F.col(none_left), F.lit(False)))
    kept = _with_lines(text_col, lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), removed), lambda i: F.get(all_, i)), "\n"))
    return joined.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = line_marks(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_lines", "n_removed", "n_links", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


OP5_SQL = """
WITH lines AS (
  SELECT DISTINCT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
  WHERE regexp_matches(l[i], '[^\\x20\\x09-\\x0D]')
),
texts AS (SELECT line, min((doc_id, line_no)) AS first, len(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS n, list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines GROUP BY line),
words AS (SELECT line, first, n, unnest(w) AS word FROM texts),
shared AS (
  SELECT a.line AS a, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM words a JOIN words b ON a.word = b.word AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.line, b.line
),
links AS (SELECT DISTINCT a AS line, 1 AS linked FROM shared WHERE 9 * o >= 4 * (n + m)),
marked AS (SELECT doc_id, line_no, coalesce(linked, 0) AS linked, linked IS NOT NULL OR (doc_id, line_no) > t.first AS gone FROM lines JOIN texts t USING (line) LEFT JOIN links k USING (line))
SELECT d.doc_id, count(line_no) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(sum(linked), 0)::BIGINT AS n_links,
       coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE gone), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""
