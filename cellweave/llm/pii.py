"""Personal data: base patterns, and terms that reveal protected entities, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_blocks, let, looked_up, removed, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Texts of the average share of entities that are added to a term's own texts, so that a term of few texts is judged with care, not left out.
PRIOR = 1.0
#: A term is disclosing if its pointwise mutual information with a kind reaches this share of the kind's information content.
ALPHA = 0.9
#: A term is a run of letters outside all spans, of any length, in lower case.
TERM = r"\p{L}++"
#: Disclosing terms are broadcast up to this many terms and bytes.
MOST_TERMS, MOST_BYTES = 500_000, 64 << 20
#: Private-use characters that stand in for a joiner, and for the same character in the text itself.
JOIN, OWN = "\ue000", "\ue001"

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: A dot between two labels, and an address in which JOIN stands for such dots.
DOT = rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])"
EMAIL = rf"(?:(?<![{JOIN}{_LOCAL}])|\G)[{JOIN}{_LOCAL}]++@[{_LABEL}]++{JOIN}[{JOIN}{_LABEL}]++"
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def _joined(text: Column, separator: str) -> Column:
    """The text with JOIN for each match of separator; as long in code points as before.

    Repeated groups of a pattern recurse in Java's matcher and overflow the stack
    on long runs.  With joiners the same runs are repeats of one character class.
    """
    return F.regexp_replace(F.replace(text, F.lit(JOIN), F.lit(OWN)), separator, JOIN)


def _matched(text: Column, pattern: str) -> Column:
    """struct(matches, between): the matches and the pieces around them, one more."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("between"))


def _ends(found: Column) -> Column:
    """Where each match ends: the lengths of all matches and pieces up to it."""

    def step(at: Column, i: Column) -> Column:
        return let(at + F.length(F.get(found["between"], i)) + F.length(F.get(found["matches"], i)), lambda end: F.struct(end.alias("state"), end.alias("out")))

    return in_blocks(F.size(found["matches"]), F.lit(0).cast("bigint"), "bigint", step)


def _spans(text: Column, pattern: str, kind: str, holds=None) -> Column:
    """Matches of the pattern, leftmost and non-overlapping, for which holds() is true."""
    none = F.expr(f"cast(array() as {SPAN})")

    def spans(found: Column) -> Column:
        span = lambda e, i: F.struct(F.lit(kind).alias("kind"), (e - F.length(F.get(found["matches"], i))).alias("start"), e.alias("end"))
        if holds is None:
            return F.transform(_ends(found), span)
        kept = lambda e, i: F.when(holds(F.get(found["matches"], i)), span(e, i))
        return F.array_compact(F.transform(_ends(found), kept))

    return let(text, lambda t: F.when(t.rlike(pattern), let(_matched(t, pattern), spans)).otherwise(none))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> spans (kind, start, end) in code points, end exclusive.

    ``(?<![class])|\\G`` lets a match start only where a run of its first
    class starts or the last match ended, so long runs cost no second look.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    card = rf"[{JOIN}0-9]{{13,}}+"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"

    def byte_parts(m: Column) -> Column:
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substr(F.regexp_replace(p, "^0+", ""), F.lit(1), F.lit(4)).try_cast("int"), F.lit(0)) <= 255))

    def card_number(m: Column) -> Column:
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))

    return {
        "email": F.when(F.contains(text, F.lit("@")), _spans(_joined(text, DOT), EMAIL, "email")).otherwise(none),
        "ip": _spans(text, ip, "ip", byte_parts),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _spans(_joined(text, r"(?<=[0-9])[\x20-](?=[0-9])"), card, "card", card_number)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _spans(text, phone, "phone", lambda m: F.length(_digits(m)).between(9, 15))).otherwise(none),
    }


def _masked(text: Column) -> Column:
    """The text with blanks for addresses, the only spans that hold letters; as long in code points as before."""

    def blanked(f: Column) -> Column:
        pieces = F.transform(f["between"], lambda x, i: F.concat(x, F.coalesce(F.repeat(F.lit(" "), F.length(F.get(f["matches"], i))), F.lit(""))))
        return F.array_join(pieces, "")

    return F.when(F.contains(text, F.lit("@")), let(_matched(_joined(text, DOT), EMAIL), blanked)).otherwise(text)


def _scanned(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rid, doc_id, t, spans) as a table, and its path: the base patterns run once, and rids don't change."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].alias("doc_id"), text_of(docs).alias("t"))
    spans = base_spans(F.col("t"))
    return written(base.select("rid", "doc_id", "t", F.concat(*[spans[k] for k in KINDS]).alias("spans")))


def _revealing(scanned: DataFrame, alpha: float) -> DataFrame:
    """(term, kind, texts, with_term, disclosure); see ``disclosures``."""
    among = lambda k: F.count_if(F.array_contains("kinds", k)).alias(k)
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"])).alias("kinds")
    held = scanned.select(kinds).agg(F.count("*").alias("texts"), *[among(k) for k in KINDS]).first()
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(_masked(F.col("t")), F.lit(TERM), F.lit(0))), F.lower))
    counts = scanned.select(kinds, F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"), *[among(k) for k in KINDS])
    shares = {k: held[k] / held["texts"] for k in KINDS if 0 < held[k] < held["texts"]}
    if not shares:
        return counts.select("term", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("texts"), "with_term", F.lit(None).cast("double").alias("disclosure")).limit(0)
    value = lambda k, p: F.log2((F.col(k) + PRIOR * p) / (F.col("with_term") + PRIOR) / p) / F.log2(F.lit(1 / p))
    judged = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("texts"), value(k, p).alias("disclosure")) for k, p in shares.items()])
    return counts.select("term", "with_term", F.explode(F.filter(judged, lambda x: x["disclosure"] >= alpha)).alias("x")).select("term", "x.kind", "x.texts", "with_term", "x.disclosure")


def disclosures(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(term, kind, texts, with_term, disclosure) of the terms that reveal a kind of entity.

    Over all texts: p(kind) is the share of texts with such an entity, p(kind | term)
    that among the texts with the term anywhere, smoothed by PRIOR texts of the
    share p(kind).  The disclosure is PMI(kind, term) / IC(kind); at 1 the term
    never stands without the entity.

    Null or empty text: counts as a text without entities and terms.  Repeated
    rows count each.  A kind in no text, or in all, reveals nothing.  Empty
    table: empty result.  Other columns are not read.
    """
    scanned, path = _scanned(docs)
    try:
        return cut(_revealing(scanned, alpha))
    finally:
        removed(docs.sparkSession, path)


def _marks(scanned: DataFrame, alpha: float) -> DataFrame:
    """(rid, terms): the places of disclosing terms, in order, for each text that has any."""
    revealing = cut(_revealing(scanned, alpha).groupBy("term").agg(F.max("with_term").alias("with_term")))

    def places(found: Column) -> Column:
        return F.transform(_ends(found), lambda e, i: F.struct(F.lower(F.get(found["matches"], i)).alias("term"), (e - F.length(F.get(found["matches"], i))).alias("start"), e.alias("end")))

    rows = scanned.select("rid", F.explode(let(_matched(_masked(F.col("t")), TERM), places)).alias("m")).select("rid", "m.*")
    # The terms follow the vocabulary, which has no bound: broadcast only up to a checked size.
    total = revealing.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if total[0] <= MOST_TERMS and (total[1] or 0) <= MOST_BYTES:
        met = rows.join(F.broadcast(revealing.select("term")), "term", "left_semi")
    else:
        # The most frequent terms, disclosing or not, meet in no task.
        frequent = rows.groupBy("term").count().orderBy(F.desc("count"), "term").limit(1000).select("term", F.lit(True).alias("_hot"))
        found = revealing.select("term", F.lit(True).alias("_yes")).join(F.broadcast(frequent), "term", "full").select("term", "_yes", F.coalesce("_hot", F.lit(False)).alias("_hot"))
        met = looked_up(rows, cut(found), "term", F.struct("rid", "start")).where("_yes")
    return met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_m"))


def _found(scanned: DataFrame, alpha: float) -> DataFrame:
    terms = F.transform("_m", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    met = scanned.join(_marks(scanned, alpha), "rid", "left")
    return met.withColumn("terms", F.coalesce(terms, F.expr(f"cast(array() as {SPAN})")))


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of docs: rid, doc_id, spans (base ones, in order) and terms (every occurrence of disclosing ones outside the spans).

    Null or empty text: no spans.  Null and repeated doc_ids: rows stay apart by
    their number in the scan.  Empty table: empty result.  Without entities no
    term is judged.  Other columns are not read.
    """
    scanned, path = _scanned(docs)
    try:
        return cut(_found(scanned, alpha).select("rid", "doc_id", "spans", "terms"))
    finally:
        removed(docs.sparkSession, path)


def _digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests of ``find``, one row for each row of docs.

    Null, empty and repeated rows and empty tables: as in ``find``.
    """
    found = find(docs)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(_digest(F.col("spans")), 256).alias("base_sha256"), _digest(F.concat("spans", "terms")).alias("spans"))


def sanitise(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, text): entities generalised to their kind in brackets, disclosing terms removed.

    Of overlapping spans the one that starts first is replaced.  Null text: the
    empty text.  Null and repeated doc_ids: row by row.  Empty table: empty
    result.  Other columns are not passed on.
    """
    scanned, path = _scanned(docs)
    try:
        ordered = F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        cuts = _found(scanned, alpha).select("doc_id", "t", ordered.alias("_s"))

        def step(at: Column, i: Column) -> Column:
            s = F.get(F.col("_s"), i)
            out = F.when(s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
            return F.struct(F.greatest(at, F.when(s["start"] >= at, s["end"])).alias("state"), out.alias("out"))

        kept = F.array_compact(in_blocks(F.size("_s"), F.lit(0).cast("bigint"), "struct<from: bigint, start: bigint, end: bigint, kind: string>", step))

        def pieces(chars: Column, k: Column) -> Column:
            # A place in a string is found by counting from its start, in an array at once.
            between = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), "")
            new = lambda s: F.concat(between(s["from"], s["start"]), F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))
            last = between(F.get(k, F.size(k) - 1)["end"], F.size(chars))
            return F.concat(F.array_join(F.transform(k, new), ""), last)

        text = F.when(F.size("_s") == 0, F.col("t")).otherwise(let(kept, lambda k: let(F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0)), lambda chars: pieces(chars, k))))
        return cut(cuts.select("doc_id", text.alias("text")))
    finally:
        removed(docs.sparkSession, path)
