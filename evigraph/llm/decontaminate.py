"""Benchmark decontamination by windows over templates, in SQL functions only.

Numbers, names and units become typed placeholders, so a question with other figures or persons has the same template. Windows of
template words are hash-joined; along an alignment of a document with an item, a name goes with one name, numbers and units with any.
Windows with too few literal words for a template are hash-joined as they stand, in lower case.

Templates cost much, so they are made of few documents: each window of the benchmark has a probe, two literal words that follow each
other wherever the window stands. Only documents that hold the probes of enough windows of one item can hold it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import few_rows, materialise, native_words, spare_names, table

WIDTH = 8
#: A window of an item counts if it has so many words that are no placeholders.
LITERALS = 4
#: Items report from so many windows on, or half of their windows if they have fewer than twice as many.
LEAST_WINDOWS = 6
#: Tables of benchmark windows and of documents up to so many rows are broadcast.
BROADCAST_WINDOWS = 200_000
BROADCAST_DOCS = 500_000

TOKEN = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|[0-9]+(?:[.,:/][0-9]+)*|[.?!%$€£°]"
#: Words that count as units right after a number.
UNITS = (
    "%", "$", "€", "£", "°", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "t", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "degree", "degrees", "percent", "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "n", "pa", "kb", "mb", "gb",
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def with_template(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``t``, the template words of a text as array<struct<c, d, raw>>: c and d are the word in lower case or a placeholder, raw what stands there.

    A name is a word with a first letter in upper case; in c, not in d, only if it does not begin the text or follow ``.``, ``?`` or ``!``.
    """
    units = ", ".join(f"'{u}'" for u in UNITS)
    typed = f"""transform(filter(transform(tokens, (t, i) -> named_struct('c',
        CASE WHEN t < ':' AND t >= '0' THEN '{NUMBER}'
             WHEN i > 0 AND get(tokens, i - 1) < ':' AND get(tokens, i - 1) >= '0' AND lower(t) IN ({units}) THEN '{UNIT}'
             WHEN length(t) = 1 AND t IN ('.', '?', '!', '%', '$', '€', '£', '°') THEN ''
             WHEN i > 0 AND left(t, 1) != lower(left(t, 1)) AND get(tokens, i - 1) NOT IN ('.', '?', '!') THEN '{NAME}'
             ELSE lower(t) END, 'first', left(t, 1), 'raw', t)), x -> x.c != ''),
        x -> named_struct('c', x.c, 'd', IF(left(x.c, 1) != '<' AND x.first != lower(x.first), '{NAME}', x.c), 'raw', x.raw))"""
    return df.withColumn("tokens", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0))).withColumn("t", F.expr(typed)).drop("tokens")


#: What the windows of a text are made of: the template with the words that begin sentences as literals, the one with capitalised ones among
#: them as names (windows that differ from the first alone), the words as they stand.
LITERAL, NAMED, RAW = "c", "d", "raw"


def _starts(n: Column, w: Column) -> Column:
    return F.when(n >= w, F.sequence(F.lit(1), n - w + 1)).otherwise(F.expr("CAST(array() AS array<int>)"))


def _mark(words: Column, w: Column, form: str) -> Column:
    return F.xxhash64(words, w, *([F.lit(RAW)] if form == RAW else []))


def _with(words: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use`` of an array that is unpacked once: slices of an array as it comes from a table copy the whole array each."""
    return F.get(F.transform(F.array(F.transform(words, lambda x: x)), use), F.lit(0))


def _slots(words: Column, at: Column, w: Column, form: Column) -> Column:
    """Placeholders of the window and what stands there; a window as it stands has none."""
    typed = lambda x: F.when(form == NAMED, x[NAMED]).otherwise(x[LITERAL])
    part = F.filter(F.slice(words, at, w), lambda x: (form != RAW) & F.startswith(typed(x), F.lit("<")))
    return F.transform(part, lambda x: F.struct(typed(x).alias("c"), F.lower(x["raw"]).alias("v")))


def _windows(w: Column, form: str) -> Column:
    """Windows of ``w`` words of the array ``t`` of an item: hash, position, values in placeholders, number of literals and what always stands there."""
    starts = _starts(F.size("t"), w)
    if form == NAMED:  # those that differ from the literal form
        starts = F.filter(starts, lambda i: F.exists(F.slice("t", i, w), lambda x: x["c"] != x["d"]))
    word = lambda x: F.lower(x["raw"]) if form == RAW else x[form]
    typed = lambda x: x[NAMED if form == NAMED else LITERAL]

    def window(i: Column) -> Column:
        part = F.slice("t", i, w)
        literals = F.size(F.filter(part, lambda x: ~F.startswith(typed(x), F.lit("<"))))
        # what stands in every text with this window: literal words; nothing for a number, which has no letters; "0" where any words may stand
        fixed = F.transform(part, lambda x: word(x) if form == RAW else F.when(typed(x) == NUMBER, " ").when(F.startswith(typed(x), F.lit("<")), "0").otherwise(typed(x)))
        return F.struct(_mark(F.transform(part, word), w, form).alias("hash"), i.alias("at"), _slots(F.col("t"), i, w, F.lit(form)).alias("slots"), literals.alias("literals"), F.lit(form).alias("form"), F.array_join(fixed, " ").alias("fixed"))

    return F.transform(starts, window)


def _hashed(docs: DataFrame, widths: list[int], raw_widths: list[int]) -> DataFrame:
    """id, text_hash, hash, at and form of all windows of documents with words ``t``."""
    # words that begin sentences, each judged by itself: looked up by number in a field of ``t``, that field would be taken out of the whole text for each word
    begins = F.array_compact(F.transform("t", lambda x, i: F.when(x[LITERAL] != x[NAMED], i + 1)))
    words = docs.select("id", "text_hash", F.size("t").alias("n"), F.col("t.c").alias(LITERAL), F.col("t.d").alias(NAMED), F.transform("t.raw", F.lower).alias(RAW), begins.alias("begins"))

    def of(w: int, form: str) -> Column:
        starts = _starts(F.col("n"), F.lit(w))
        if form == NAMED:  # around words that begin sentences alone
            around = F.transform("begins", lambda j: F.sequence(F.greatest(j - w + 1, F.lit(1)), F.least(j, F.col("n") - w + 1)))
            starts = F.when(F.col("n") >= w, F.array_distinct(F.flatten(around))).otherwise(F.expr("CAST(array() AS array<int>)"))
        return _with(form, lambda own: F.transform(starts, lambda i: F.struct(_mark(F.slice(own, i, F.lit(w)), F.lit(w), form).alias("hash"), i.alias("at"), F.lit(form).alias("form"))))

    windows = F.concat(*[of(w, form) for w in widths for form in (LITERAL, NAMED)], *[of(w, RAW) for w in raw_widths])
    return words.select("id", "text_hash", F.explode(windows).alias("d")).select("id", "text_hash", "d.*")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, width, need, need_all, hash, at, slots, form, strong, fixed of the windows of an item.

    A window with enough literals is ``strong`` and hashed as template, once more with names at the beginning of sentences if literals are enough
    then too. Those that lack literals in either template, and a first one whose unit a number before it would turn into a placeholder, are
    hashed as they stand. ``need`` counts strong windows, ``need_all`` all.
    """
    items = with_template(benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct(), "text").withColumn("width", F.least(F.size("t"), F.lit(WIDTH)))
    items = items.where("width > 0").withColumn("first", F.lower(F.col("t")[0]["raw"]))
    enough = lambda n: (n >= LITERALS) | ((F.col("width") < WIDTH) & (n >= LITERALS - 1))
    found = items.select("item", "width", "first", F.explode(F.concat(*[_windows(F.col("width"), form) for form in (LITERAL, NAMED, RAW)])).alias("w")).select("item", "width", "first", "w.*")
    place = W.partitionBy("item", "at")
    literal = F.max(F.when(F.col("form") == LITERAL, F.col("literals"))).over(place)
    found = found.withColumns({"strong": enough(literal), "sure": enough(F.min("literals").over(place))})
    unit = (F.col("at") == 1) & F.col("first").isin(*UNITS)
    found = found.where(F.when(F.col("form") == RAW, ~F.col("sure") | unit).otherwise(enough(F.col("literals")))).drop("first", "literals", "sure")
    half = lambda n: F.least(F.lit(LEAST_WINDOWS), F.ceil(n / 2))
    number = found.groupBy("item").agg(half(F.countDistinct(F.when(F.col("strong"), F.col("at")))).alias("need"), half(F.countDistinct("at")).alias("need_all"))
    return found.join(number, "item")


#: What does not belong to a run of letters and marks.
NO_LETTERS = r"[^\p{L}\p{M}]+"


def _probes(items: DataFrame) -> DataFrame:
    """item, at, strong, need, need_all, probe and digits of each window. The probe is the hash of two runs of letters that follow each other in
    every text with the window, the longest such two, or of one run if there are no two. Windows without letters have ``digits``, the longest of
    their numbers, instead; without either, the window may stand anywhere."""
    # a final sigma in lower case depends on what surrounds it, so words with one may be anything here
    runs = items.withColumn("runs", F.transform(F.array_remove(F.split(F.regexp_replace("fixed", r"[1-9]", ""), r"[^\p{L}\p{M}0]+"), ""), lambda r: F.when(r.rlike("[σςΣ]"), "0").otherwise(r)))
    pairs = F.filter(F.transform("runs", lambda r, i: F.struct((F.length(r) + F.length(F.get("runs", i + 1))).alias("size"), r.alias("a"), F.get("runs", i + 1).alias("b"))), lambda p: p["size"].isNotNull() & ~F.contains(F.concat(p["a"], p["b"]), F.lit("0")))
    ones = F.transform(F.filter("runs", lambda r: ~F.contains(r, F.lit("0"))), lambda r: F.struct(F.length(r).alias("size"), r.alias("a"), F.lit(None).cast("string").alias("b")))
    best = F.coalesce(F.array_max(pairs), F.array_max(ones))
    numbers = F.transform(F.regexp_extract_all("fixed", F.lit("[0-9]+"), F.lit(0)), lambda d: F.struct(F.length(d).alias("size"), d.alias("d")))
    digits = F.when(F.col("form") == RAW, F.array_max(numbers)["d"])
    return runs.select("item", "at", "strong", "need", "need_all", best.alias("best"), digits.alias("digits")).select(
        "item", "at", "strong", "need", "need_all", F.when(F.col("best").isNotNull(), F.xxhash64("best.a", "best.b")).alias("probe"), F.when(F.col("best").isNull(), F.col("digits")).alias("digits"), (F.col("best").isNotNull() & F.col("best.b").isNull()).alias("single")
    ).distinct()


def _suspects(rows: DataFrame, items: DataFrame) -> DataFrame:
    """id and t of the rows that hold the probes of enough windows of an item; every row that holds an item is among them."""
    probes = materialise(_probes(items), "benchmark-probes")
    runs = F.split(F.lower("text"), NO_LETTERS)
    two = F.transform("runs", lambda r, i: F.xxhash64(r, F.get("runs", i + 1)))  # a null at the end leaves the hash of one run
    marks = [two] if probes.where("single").isEmpty() else [two, F.transform("runs", lambda r: F.xxhash64(r, F.lit(None).cast("string")))]
    words = rows.select("id", "t", runs.alias("runs")).select("id", "t", F.explode(F.concat(*marks)).alias("probe"))
    known = few_rows(probes.where("probe IS NOT NULL").select("probe").distinct(), BROADCAST_WINDOWS)
    hits = words.join(known, "probe", "left_semi").distinct().join(few_rows(probes, BROADCAST_WINDOWS), "probe").select("id", "t", "item", "at", "strong", "need", "need_all")
    numbers = probes.where("digits IS NOT NULL").select("item", "at", "strong", "need", "need_all", F.col("digits").alias("number"))
    if not numbers.isEmpty():
        # a window's number is a whole run of digits wherever the window stands
        digits = rows.select("id", "t", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("number"))
        hits = hits.unionByName(digits.join(few_rows(numbers, BROADCAST_WINDOWS), "number").select(hits.columns))
    # windows that may stand anywhere count for every row
    free = probes.where("probe IS NULL AND digits IS NULL").groupBy("item").agg(F.countDistinct("at").alias("free"))
    counts = hits.groupBy("id", "t", "item", "need", "need_all").agg(F.size(F.collect_set("at")).alias("n"), F.size(F.collect_set(F.when(F.col("strong"), F.col("at")))).alias("n_strong"))
    enough = F.expr("n + coalesce(free, 0) >= need_all OR (need > 0 AND n_strong + coalesce(free, 0) >= need)")
    found = counts.join(few_rows(free, BROADCAST_WINDOWS), "item", "left").where(enough).select("id", "t")
    anywhere = probes.join(free, "item").where("free >= need_all OR (need > 0 AND free >= need)")
    return (found if anywhere.isEmpty() else rows.select("id", "t")).distinct()


def _blank_free(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(native_words(F.lower(text)), " "), F.lit(" "))


def _wordless(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, t, item, n_windows, changed) for items (item, text) without any template word, such as rows of symbols: looked for as a whole, between blanks.

    Rows with the longest word of an item are found by equality, then the whole is looked for in these.
    """
    items = with_template(benchmark.distinct(), "text").where("size(t) = 0").select("item", _blank_free(F.col("text")).alias("whole")).where("trim(whole) != ''").distinct()
    longest = F.array_max(F.transform(native_words(F.col("whole")), lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    items = materialise(items.withColumn("word", longest), "benchmark-wordless")
    none = rows.select("id", "t", F.lit(None).cast(items.schema["item"].dataType).alias("item")).limit(0)
    if items.isEmpty():
        met = none
    else:
        words = rows.select("id", "t", F.explode(F.array_distinct(native_words(F.lower("text")))).alias("word"))
        near = words.join(few_rows(items, BROADCAST_WINDOWS), "word").select(F.col("id").alias("own"), F.col("t").alias("hash"), "item", "whole")
        met = rows.join(near, F.expr("id <=> own AND t = hash")).where(F.contains(_blank_free(F.col("text")), F.col("whole")))
    return met.select("id", "t", "item", F.lit(1).cast("long").alias("n_windows"), F.lit(False).alias("changed")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_hash, item, n_windows, changed) for each document that holds an item, perhaps with other numbers, names or units.

    An item is held if ``need`` of its strong windows, or ``need_all`` of all, stand in the document. Along an alignment each name in
    the item must go with one name in the document, or the windows that hold it do not count; several names may go with the same one, and
    numbers and units with any. ``changed`` tells that some value differs. Capitalised words that
    begin sentences are tried as literals and as names. Windows with few
    literal words count where they stand as they are, so a verbatim copy is always held, however short. Null and empty texts hold nothing;
    rows that repeat an id and a text count as one document, rows that repeat an id, or have none, with other texts as several, which
    ``text_hash`` tells apart; texts may be of any length and are read whole; empty tables give no row; further columns are ignored.

    All documents are read once for their probes, which meet the benchmark's by a broadcast, or a shuffle if those are many.
    Templates are made of the documents with probes enough alone.
    """
    items = materialise(benchmark_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    kinds = [tuple(r) for r in items.select("width", "form").distinct().collect()]  # at most three times WIDTH values
    widths, raw_widths = sorted({WIDTH, *(w for w, form in kinds if form != RAW)}), sorted(w for w, form in kinds if form == RAW)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    suspects = few_rows(materialise(_suspects(rows, items), "leak-suspects"), BROADCAST_DOCS).alias("s")
    found = rows.alias("r").join(suspects, F.expr("r.id <=> s.id AND r.t = s.t"), "left_semi").distinct().withColumnRenamed("t", "text_hash")
    found = materialise(with_template(found, "text").select("id", "text_hash", "t"), "leak-templates")
    known = few_rows(items.select("hash", "width").distinct(), BROADCAST_WINDOWS)
    hits = _hashed(found, widths, raw_widths).join(known, "hash").groupBy("id", "text_hash").agg(F.collect_list(F.struct("hash", "at", "form", "width")).alias("hits"))
    # values are worked out where a window of the benchmark stands, with the words of a document at hand once
    placed = found.alias("f").join(hits.alias("h"), F.expr("f.id <=> h.id AND f.text_hash = h.text_hash")).select("f.id", "f.text_hash", "t", "hits")
    valued = _with("t", lambda t: F.transform("hits", lambda h: F.struct(h["hash"].alias("hash"), h["at"].alias("d_at"), h["form"].alias("d_form"), _slots(t, h["at"], h["width"], h["form"]).alias("d_slots"))))
    placed = placed.select("id", "text_hash", F.explode(valued).alias("d"))
    met = placed.select("id", "text_hash", "d.*").join(few_rows(items.drop("fixed"), BROADCAST_WINDOWS), "hash")
    values = F.zip_with("slots", "d_slots", lambda i, d: F.struct(i["c"].alias("c"), i["v"].alias("item"), d["v"].alias("doc")))
    # windows that take no word at the beginning of a sentence for a name are judged by themselves and along with the others
    forms = F.when((F.col("form") == NAMED) | (F.col("d_form") == NAMED), F.array(F.lit(NAMED))).otherwise(F.array(F.lit(LITERAL), F.lit(NAMED)))
    lines = met.select("id", "text_hash", "item", "need", "need_all", F.struct(F.struct("at", "strong").alias("place"), values.alias("values")).alias("w"), (F.col("d_at") - F.col("at")).alias("shift"), forms.alias("form"))
    keys = ("id", "text_hash", "item", "need", "need_all")
    lines = lines.withColumn("form", F.explode("form")).groupBy(*keys, "shift", "form").agg(F.collect_set("w").alias("ws"))
    # where every name stands for itself none goes with two
    other = f"exists(ws, w -> exists(w.values, v -> v.c = '{NAME}' AND v.item != v.doc))"
    lines = lines.withColumn("names", F.expr(f"IF({other}, array_distinct(filter(flatten(transform(ws, w -> w.values)), v -> v.c = '{NAME}')), slice(ws[0].values, 1, 0))"))
    lines = lines.withColumn("mixed", F.expr("transform(filter(names, n -> exists(names, m -> m.item = n.item AND m.doc != n.doc)), n -> n.item)"))
    lines = lines.withColumn("ws", F.expr(f"filter(ws, w -> NOT exists(w.values, v -> v.c = '{NAME}' AND array_contains(mixed, v.item)))"))
    lines = lines.select(*keys, "shift", F.col("ws.place").alias("ats"), F.expr("exists(ws, w -> exists(w.values, v -> v.item != v.doc))").alias("changed")).where("size(ats) > 0")
    lines = lines.groupBy(*keys, "shift").agg(F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"), F.max("changed").alias("changed"))
    pairs = lines.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"), F.min("changed").alias("changed"))
    strong = F.size(F.filter("ats", lambda a: a["strong"]))
    pairs = pairs.where(((F.col("need") > 0) & (strong >= F.col("need"))) | (F.size("ats") >= F.col("need_all"))).select("id", "text_hash", "item", F.size("ats").cast("long").alias("n_windows"), "changed")
    wordless = _wordless(rows, benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))
    pairs = pairs.unionByName(wordless.withColumnRenamed("t", "text_hash"))
    return pairs.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), "n_windows", "changed")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark. A row is known by its id, null ids included, and its text; null texts hold
    nothing; further columns may have any name; an empty table gives an empty one."""
    row_id, row_hash = spare_names(docs, 2)
    held = leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(row_id), F.col("text_hash").alias(row_hash)).distinct()
    held = few_rows(materialise(held, "leaking"), BROADCAST_DOCS)
    same = docs[id_col].eqNullSafe(held[row_id]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == held[row_hash])
    return docs.join(held, same, "left_anti")
