"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document has two histograms: characters by class, and words by common word. Per language the histograms
of all documents that pass the base rules make the reference. A document is rejected if the
Jensen-Shannon distance (base 2, 0 to 1) of one of its histograms to its language's reference passes that
histogram's limit and the document is long enough for that histogram to say something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, written

# Frequent function words of the languages with references.
COMMON_WORDS = (
    "the of and to in a is that for it on was",  # English
    "der die und das den von zu mit ist im sich nicht",  # German
    "le la les et des en un une du que est qui",  # French
    "el los las y de se una por con su para no",  # Spanish
)
WORDS = tuple(dict.fromkeys(" ".join(COMMON_WORDS).split()))
SPACE = " \t\n\x0b\f\r"
#: Digits count with the small letters: a phone number makes no text worse.
CLASSES = ("upper", "space", "punctuation", "symbol", "rest")

#: Characters and words below which a histogram is not judged, and the largest distances kept.
MIN_CHARS, MIN_WORDS = 200, 60
CHAR_LIMIT, WORD_LIMIT = 0.16, 0.4
#: Up to so many values are sought by a scan; it changes the way, not the result.
FEW = 24
#: A language needs so many documents to have a reference.
MIN_REFERENCE = 20
#: So many references of some 500 bytes are broadcast at most.
BROADCAST_LANGUAGES = 2000


def without(text: Column, pattern: str) -> Column:
    """How many characters match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` not null) with the base counts and both histograms. Every step is an
    expression within the row: long texts cost n log n at most, and nothing is shuffled."""
    t = F.col("text")
    bare = F.btrim(t, F.lit(SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = docs.withColumn("_words", F.when(bare == "", F.array().cast("array<string>"))
                         .otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_common": F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(*WORDS)), "  "), F.lit(" ")),
        "_lines": lines, "n_letters": F.length(F.array_join("_words", "")),
    }).drop("_words")
    h = F.col("_hashes")
    # A three-word window is its words' hashes, hashed; equal ones within one text are repeats.
    df = df.withColumn("_windows", F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))))
    w = F.col("_windows")
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(w)))
    s = F.col("_sorted")
    df = df.withColumn("_again", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
    # Few values that come again are sought one by one; many are found by sorting with their places.
    few = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains("_again", x), i)), lambda i: i.isNotNull())
    df = df.withColumn("_pairs", F.when(F.size("_again") > FEW, F.sort_array(
        F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    p = F.col("_pairs")
    many = F.sort_array(F.filter(F.transform(p, lambda e, i: F.when(
        e["w"].eqNullSafe(F.get(p, i - 1)["w"]) | e["w"].eqNullSafe(F.get(p, i + 1)["w"]), e["i"])), lambda i: i.isNotNull()))
    places = F.when(F.size("_again") > FEW, many).when(F.size("_again") > 0, few)
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
                          lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")))
    counts = {
        "upper": without(t, r"\p{Lu}+"), "space": F.length(t) - F.col("n_letters"),
        "punctuation": without(t, r"[-.,;:!?'\"()]+"), "symbol": without(t, r"[#*$%&|<>]+"),
    }
    df = df.withColumns({f"_{k}": v.cast("double") for k, v in counts.items()} | {
        "n_repeat_words": F.coalesce(covered["n"], F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_uses": F.array(*[((F.length("_common") - F.length(F.replace("_common", F.lit(f" {w} "), F.lit(""))))
                            / (len(w) + 2)) for w in WORDS]),
    })
    n = F.length(t).cast("double")
    rest = n - sum((F.col(f"_{k}") for k in counts), F.lit(0.0))
    share = F.array(*[F.col(f"_{k}") for k in counts], rest)
    per_word = F.array_append("_uses", F.col("n_words") - F.aggregate(
        "_uses", F.lit(0.0), lambda a, x: a + x))
    return df.withColumns({
        "word_chars": F.col("n_letters").cast("long"), "n_symbols": F.col("_symbol").cast("long"),
        "chars": F.transform(share, lambda x: x / F.greatest(n, F.lit(1.0))),
        "words": F.transform(per_word, lambda x: x / F.greatest(F.col("n_words"), F.lit(1))),
        "n_text": n.cast("long"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("_hashes", "_common", "_lines", "_windows", "_sorted", "_again", "_pairs", "_uses", "n_letters", *[f"_{k}" for k in counts])


def references(measured: DataFrame, min_documents: int = MIN_REFERENCE) -> DataFrame:
    """One row per language over its documents that pass the base rules: the median share of each
    character class, which junk does not move, brought to a sum of one, and the mean share of each word."""
    means = [F.percentile_approx(F.get("chars", F.lit(i)), 0.5, 1000).alias(f"c{i}") for i in range(len(CLASSES))]
    means += [F.avg(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    by = measured.where(~F.col("base_failed")).groupBy("lang").agg(F.count("*").alias("n"), *means)
    total = sum(F.col(f"c{i}") for i in range(len(CLASSES)))
    return by.where(F.col("n") >= min_documents).select(
        F.col("lang").alias("of_lang"), F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES))]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(len(WORDS) + 1)]).alias("ref_words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to one."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.sqrt(F.when(total < 0, 0.0).otherwise(total))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the features, null texts empty and null languages a language of their own."""
    return features(docs.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit("")),
                                      "lang": F.coalesce(F.col("lang").cast("string"), F.lit(""))}))


def judge(measured: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Measured rows, stored, with ``char_distance``, ``word_distance`` and ``kept``.

    A distance is null, and rejects nothing, where the text is below the histogram's minimum length or
    the language has no reference.
    """
    known = written(references(measured), "quality-references")
    # A language may have a third of all rows, so few references go to every task; many are joined.
    small = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
    with_reference = measured.join(small, measured.lang == F.col("of_lang"), "left")
    judged = with_reference.withColumns({
        "char_distance": F.when(F.col("n_text") >= MIN_CHARS, distance(F.col("chars"), F.col("ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("words"), F.col("ref_words"))),
    })
    odd = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(
        F.col("word_distance") > word_limit, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_distance, word_distance``.

    Null texts count as empty ones and fail the base rules; repeated rows and null ids stay as they are;
    an empty table gives no rows. The features, without the texts, are stored once: the references need
    all of them before the first verdict.
    """
    df = columns(docs, doc_id="bigint", text="string", lang="string")
    return judge(written(measure(df).drop("text"), "quality-features")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, as they came."""
    df = columns(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    # Null texts fail the base rules; of null languages only the mark is stored besides.
    df = df.withColumn("no_lang", F.col("lang").isNull())
    kept = judge(written(measure(df), "quality-documents")).where("kept")
    return kept.select("doc_id", "text", F.when(~F.col("no_lang"), F.col("lang")).alias("lang"), "source", "n_chars")
