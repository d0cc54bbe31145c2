"""Statistics of a text as DataFrame functions, in one pass over its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of, words

SYMBOLS = "[#*$%&|<>]"
#: Inputs of the learned rules and scores, all derived from the text alone.
FEATURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "exclaim_share",
    "upper_share",
    "digit_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "comma_share",
)


def repeated(w: Column) -> Column:
    """Words that stand in 3-word windows found twice or more in the text, the first included.

    Each window becomes one long: its hash in the upper bits, its place in the
    lower ones.  After a sort, windows of equal hash bits are neighbours, so no
    pairs of places are formed however often a window occurs.  The words of
    neighbours are compared; only where some differ, as among millions of words
    whose places leave few bits, the windows in question are sorted by their words.
    """
    window = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    beside = lambda s, k, same: same(F.get(s, k), F.get(s, k - 1)) | same(F.get(s, k), F.get(s, k + 1))

    def by_words(places: Column) -> Column:
        named = F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", *window(p.cast("int"))).alias("words"), p.alias("place"))))
        same = lambda a, b: F.coalesce(a["words"] == b["words"], F.lit(False))
        return let(named, lambda s: F.array_compact(F.transform(s, lambda v, k: F.when(beside(s, k, same), v["place"]))))

    def count(n: Column) -> Column:
        bits = F.length(F.bin(n.cast("bigint")))
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(*window(i)), bits).bitwiseOR(i.cast("bigint")))
        hash_of = lambda v: F.call_function("shiftright", v, bits)
        place = lambda v: (v - F.call_function("shiftleft", hash_of(v), bits)).cast("int")
        same = lambda a, b: F.coalesce(hash_of(a) == hash_of(b), F.lit(False))

        def starts(s: Column) -> Column:
            """Places of windows with a neighbour of equal hash bits, in the order of the hashes."""
            return F.array_compact(F.transform(s, lambda v, k: F.when(beside(s, k, same), v)))

        def verified(s: Column) -> Column:
            differ = lambda p, q: ~((F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2)))
            wrong = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: same(F.get(s, k), F.get(s, k - 1)) & differ(place(F.get(s, k)), place(F.get(s, k - 1))))
            places = F.transform(s, lambda v: place(v).cast("bigint"))
            return F.when(F.size(s) < 2, places).when(wrong, by_words(places)).otherwise(places)

        return let(let(F.sort_array(packed), starts), lambda s: _covered(F.sort_array(verified(s))))

    return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(F.size(w), count))


def _covered(starts: Column) -> Column:
    """Places covered by windows of three at these sorted starts."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES' further ones.

    A null text counts as empty; all counts of an empty text are 0, and so are all shares.
    """
    text = text_of(docs)
    narrow = docs.select(*[docs[c].alias(c) for c in keep], text.alias("_t"))
    t = F.col("_t")
    number = lambda chars: F.regexp_count(t, F.lit(chars)).cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = words(t)
    counted = narrow.select(
        *keep,
        let(
            w,
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                repeated(w).alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("bigint").alias("_distinct"),
            ),
        ).alias("_w"),
        (F.length(t) - number(SPACE)).alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.greatest(F.size(F.split(t, "\n")), F.lit(1)).alias("_lines"),
        number("[!?]").alias("_exclaim"),
        number("[,;]").alias("_comma"),
        number("[0-9]").alias("_digit"),
        number(r"\p{Lu}").alias("_upper"),
    )
    n, chars = F.greatest(F.col("_w.n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        *keep,
        F.col("_w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("_exclaim") / n).alias("exclaim_share"),
        (F.col("_upper") / chars).alias("upper_share"),
        (F.col("_digit") / chars).alias("digit_share"),
        (F.col("n_dup_lines") / F.col("_lines")).alias("dup_line_share"),
        (F.col("_w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("_w._distinct") / n).alias("distinct_share"),
        (F.col("_comma") / n).alias("comma_share"),
    )


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> list:
    """Rows (features..., _y, _id) of at most ``most`` labelled documents, those of the smallest md5 of the doc_id.

    Only labels of ids that ``docs`` holds count, so fewer than ``most`` come
    back only if fewer documents are labelled.  Labels without a doc_id or a
    quality are left out; of several labels of one id the smallest quality
    counts, of several rows of one id the smallest statistics.  The sample is
    bounded by ``most``, so it can be broadcast and its statistics collected.
    """
    marks = labels.select(labels["doc_id"].alias("_id"), labels["quality"].cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    marks = marks.groupBy("_id").agg(F.min("_y").alias("_y"))
    # Distinct ids are combined in each task before they meet, so a repeated id is no hot key.
    present = docs.select(docs["doc_id"].alias("_id")).where("_id IS NOT NULL").distinct()
    few = marks.join(present, "_id", "left_semi").orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most)
    found = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text")).join(F.broadcast(few), "_id")
    stats = with_stats(found, ["_id", "_y"])
    one = stats.groupBy("_id", "_y").agg(F.min(F.struct(*FEATURES)).alias("_f"))
    return one.select(*[F.col("_f")[f].alias(f) for f in FEATURES], "_y", "_id").collect()
