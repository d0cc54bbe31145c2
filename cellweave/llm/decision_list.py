"""Quality rules: a decision list learned by sequential covering, applied as a Spark conditional expression."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import FEATURES, labelled, with_stats

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] < self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _candidates(rows: list, cuts: int) -> list[tuple[Condition, int]]:
    """Each threshold condition with the set of rows for which it holds, as the bits of an int."""
    found = []
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        for t in sorted({values[len(values) * i // cuts] for i in range(1, cuts)} | {values[-1]}):
            for at_least in (True, False):
                c = Condition(f, at_least, float(t))
                bits = int("".join("1" if c.holds(r) else "0" for r in reversed(rows)), 2)
                if bits and bits.bit_count() < len(rows):
                    found.append((c, bits))
    return found


def learn(rows: list, most_rules: int = 16, most_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 5, cuts: int = 48) -> list[Rule]:
    """Rules for rejecting, in order.  rows: FEATURES and _y, 1 for good quality.

    Two thirds of the rows grow a rule by FOIL's information gain; the last
    third prunes it, condition by condition from its end.  A rule stays if
    ``least_precision`` of what it newly covers is bad.  Rows without either
    class give no rule.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"], r["_y"]))
    if not any(r["_y"] == 0 for r in rows) or all(r["_y"] == 0 for r in rows):
        return []
    candidates = _candidates(rows, cuts)
    every = (1 << len(rows)) - 1
    bad = int("".join("1" if r["_y"] == 0 else "0" for r in reversed(rows)), 2)
    prune_set = sum(1 << i for i in range(0, len(rows), 3))
    left, rules = every, []
    for _ in range(most_rules):
        rule: list[tuple[Condition, int]] = []
        cover = left & ~prune_set
        while len(rule) < most_conditions:
            p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not p or not n:
                break
            now, best, gain = math.log2(p / (p + n)), None, 1e-9
            for c, bits in candidates:
                if p1 := (both := cover & bits) and (both & bad).bit_count():
                    g = p1 * (math.log2(p1 / both.bit_count()) - now)
                    if g > gain:
                        best, gain = (c, bits), g
            if best is None:
                break
            rule.append(best)
            cover &= best[1]

        def held(conditions, within: int) -> tuple[int, int]:
            for _, bits in conditions:
                within &= bits
            return (within & bad).bit_count(), within.bit_count()

        def worth(conditions) -> float:
            p, both = held(conditions, left & prune_set)
            return (2 * p - both) / both if both else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        p, both = held(rule, left) if rule else (0, 0)
        if both < least_rows or p < least_precision * both:
            break
        rules.append(tuple(c for c, _ in rule))
        gone = left
        for _, bits in rule:
            gone &= bits
        left &= ~gone
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True (keep) or the first rule's rejection, as one ordered conditional expression."""
    out = None
    for rule in rules:
        all_hold = rule[0].column()
        for c in rule[1:]:
            all_hold = all_hold & c.column()
        out = F.when(all_hold, F.lit(False)) if out is None else out.when(all_hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """The text of the rule that rejects, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        all_hold = rule[0].column()
        for c in rule[1:]:
            all_hold = all_hold & c.column()
        out = F.when(all_hold, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, most_labels: int = 20_000) -> DataFrame:
    """Statistics, base_failed, kept and the rule that rejects, for each row of docs.

    Rules are learned from at most ``most_labels`` labelled documents (see
    ``textstats.labelled``); the learned conditional expression runs inside the
    scan's projection, without a shuffle.

    Null text: as empty, so base_failed.  Repeated rows: judged alike.  Empty
    tables: no rows, or no rules (then base_failed alone decides).  Columns of
    docs named like a statistic are passed on only if in ``keep``, by default doc_id.
    """
    rules = learn(labelled(docs, labels, most_labels))
    keep = keep or ["doc_id"]
    packed = docs.select(F.struct(*[docs[c].alias(c) for c in keep]).alias("_kept"), docs["text"].alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = with_stats(packed, ["_kept"])
    judged = stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumn("rule", fired(rules))
    return judged.select("_kept", *BASE, "base_failed", "kept", "rule")
