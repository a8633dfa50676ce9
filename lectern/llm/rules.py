"""Quality rules by distribution divergence, native DataFrame operations only.

Counts of character classes and of common words of each document are compared
with those of each language by the Jensen-Shannon distance (base 2, so from 0 to
1). A language's reference is what all documents marked with it add up to; its
common words are the most frequent ones of these documents, for every language that
occurs. The common words of a document are compared among themselves, so the distance
does not hang on their share of the text; that they are there at all is a rule of its own,
relative to the language's share. A
document is kept if it is near to a language in both respects. Short texts
scatter widely, so a distance counts from a least length on only.

Words are counted by language with partial sums; the counts of a document are taken inside the row. Only the references, a
few numbers per language, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tables import written

#: Words of a text; the base rules count these (fixed patterns).
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
#: Character classes in the order in which they are taken out of the text (fixed patterns).
CLASSES = {"lower": "[a-z]+", "space": SPACE, "upper": "[A-Z]+", "wide": "[^\\x00-\\x7F]+", "symbol": "[#*$%&|<>]+", "digit": "[0-9]+"}
REST = "other"
#: Common words are the most frequent tokens of a language that are letters only; so many of each.
LETTERS, N_COMMON = "^\\p{L}+$", 24
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is kept up to these distances, counted from these lengths on.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.3, 200
MAX_WORD_DISTANCE, MIN_COUNTED_WORDS = 0.7, 100
#: Common words must make up this part, at least, of the share that they have in the language.
MIN_COVER = 0.25


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _n_repeat_words(grams: Column) -> Column:
    """Words covered by windows of three that occur twice or more, from the array of (window, place), sorted.

    Places whose window equals the one before or after it in order are repeated; sorted again, each covers the words up to the next
    one's start, three at most."""
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    ahead = F.concat(F.slice(grams, 2, F.size(grams)), F.array(F.lit(None)))
    behind = F.concat(F.array(F.lit(None)), F.slice(grams, 1, F.greatest(F.size(grams) - 1, F.lit(0))))
    near = F.zip_with(ahead, behind, lambda a, b: F.struct(a["g"].alias("a"), b["g"].alias("b")))
    marked = F.zip_with(grams, near, lambda x, n: F.when((x["g"] == n["a"]) | (x["g"] == n["b"]), x["i"]))
    return F.when(F.size(grams) > 0, F.sort_array(F.filter(marked, lambda x: x.isNotNull()))).otherwise(F.transform(none, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    ahead = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**30)))
    steps = F.zip_with(places, ahead, lambda a, b: F.least(b - a, F.lit(3)))
    return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))


def common_words(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Per language that occurs, its ``N_COMMON`` most frequent words of letters with their counts; ties go to the smaller word."""
    words = docs.where("lang IS NOT NULL").select("lang", F.explode_outer(_words(F.coalesce("text", F.lit("")))).alias("w")).where(F.col("w").rlike(LETTERS))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")  # with its limit, each partition sends on N_COMMON rows of a language only
    ranked = words.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= N_COMMON)
    out: dict[str, dict[str, int]] = {}
    for row in ranked.collect():
        out.setdefault(row["lang"], {})[row["w"]] = row["n"]
    return out


def base_counts(docs: DataFrame, listed: list[str]) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and per document the histograms ``chars`` (struct) and ``common`` (words with counts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text"), _words(text).alias("words"))
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("g"), i.alias("i"))
    three = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = rows.select(
        "doc_id",
        "lang",
        "text",
        F.size("words").alias("n_words"),
        F.sort_array(three).alias("grams"),
        lines.alias("lines"),
        F.sort_array(F.filter("words", lambda w: w.isin(listed))).alias("found"),
    )
    left, taken = F.col("text"), []
    for name, pattern in CLASSES.items():
        rows = rows.withColumn(f"less_{name}", F.regexp_replace(left, pattern, ""))
        taken.append((F.length(left) - F.length(f"less_{name}")).alias(name))
        left = F.col(f"less_{name}")
    rows = rows.select(
        "doc_id",
        "lang",
        "n_words",
        F.struct(*taken, F.length(left).alias(REST)).alias("chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _n_repeat_words(F.col("grams")).alias("places"),
        "found",
        F.array_distinct("found").alias("kinds"),
    )
    # equal words stand together, so counts are differences of first places
    first = F.transform("kinds", lambda w: F.array_position("found", w))
    rows = rows.withColumn("first", first)
    after = F.concat(F.slice("first", 2, F.size("first")), F.array((F.size("found") + 1).cast("long")))
    counts = F.zip_with("first", after, lambda a, b: b - a)
    return rows.select(
        "doc_id",
        "lang",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        "chars",
        F.zip_with("kinds", counts, lambda w, n: F.struct(w.alias("w"), n.alias("n"))).alias("common"),
    )


def _term(p: Column, q: float) -> Column:
    """What one bin adds to the Jensen-Shannon divergence."""
    half = (p + F.lit(q)) / 2
    own = F.when(p > 0, p * F.log2(p / half)).otherwise(F.lit(0.0))
    other = F.lit(q) * F.log2(F.lit(q) / half) if q > 0 else F.lit(0.0)
    return (own + other) / 2


def _distance(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for p, q in parts:
        total = total + _term(p, q)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _word_distance(reference: dict[str, float], cover: float, n_words: Column) -> Column:
    """Distance of the ``common`` histogram to a reference, both among its words; 1 where these words are too few of the text.

    Only the words that occur are looked at: each other one adds half its share."""
    if not reference:
        return F.lit(1.0)
    shares = F.create_map(*[F.lit(x) for pair in sorted(reference.items()) for x in pair])
    known = F.filter("common", lambda x: F.map_contains_key(shares, x["w"]))
    every = F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def add(d: Column, x: Column) -> Column:
        q, p = shares[x["w"]], x["n"] / every
        half = (p + q) / 2
        return d + (p * F.log2(p / half) + q * F.log2(q / half) - q) / 2

    divergence = F.aggregate(known, F.lit(sum(reference.values()) / 2), add)
    return F.when(every >= MIN_COVER * cover * n_words, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(1.0))


def references(counts: DataFrame, common: dict[str, dict[str, int]]) -> dict[str, tuple[dict[str, float], dict[str, float], float]]:
    """Per language that some document is marked with: shares of character classes, shares of its common words among them, and their share of all words."""
    names = [*CLASSES, REST]
    chars = counts.where("lang IS NOT NULL").groupBy("lang").agg(*[F.sum(f"chars.{c}").alias(c) for c in names], F.sum("n_words").alias("n_words")).collect()
    out = {}
    for row in chars:
        every, words = sum(row[c] for c in names) or 1, common.get(row["lang"], {})
        listed = sum(words.values())
        out[row["lang"]] = ({c: row[c] / every for c in names}, {w: n / listed for w, n in words.items()}, listed / (row["n_words"] or 1))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) to doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A null text has no words. A document without words has distance 0 to anything, but fails by length. Without any document marked with a
    language only the base rules decide; every language that a document is marked with has a reference. lang is used for the references alone. Each row is a document of its own, also with a null or
    repeated doc_id; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    common = common_words(docs)
    counts = written(base_counts(docs, sorted({w for words in common.values() for w in words})), "rules")
    found = references(counts, common)
    chars = sum((F.col(f"chars.{c}") for c in [*CLASSES, REST]), F.lit(0))
    n_words = F.col("n_words")
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    char_far, word_far = [], []
    for char_ref, word_ref, cover in (found[x] for x in sorted(found)):
        char_far.append(_distance([(share(F.col(f"chars.{c}"), chars), q) for c, q in char_ref.items()]))
        word_far.append(_word_distance(word_ref, cover, n_words))
    nearest = lambda x: F.least(*x, F.lit(1.0)) if x else F.lit(0.0)
    rows = counts.select(
        "doc_id",
        "n_words",
        (chars - F.col("chars.space")).cast("long").alias("word_chars"),
        F.col("chars.symbol").cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((n_words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n_words)).alias("base_failed"),
        chars.alias("n"),
        F.when(chars > 0, nearest(char_far)).otherwise(F.lit(0.0)).alias("char_distance"),
        F.when(n_words > 0, nearest(word_far)).otherwise(F.lit(0.0)).alias("word_distance"),
    )
    near = ((F.col("n") < MIN_CHARS) | (F.col("char_distance") <= MAX_CHAR_DISTANCE)) & ((n_words < MIN_COUNTED_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE))
    return rows.withColumn("kept", ~F.col("base_failed") & near).drop("n")
