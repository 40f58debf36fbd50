"""Quality rules: a learned decision list over text statistics.

text_statistics() counts over whole texts in Arrow batches. learn() fits an
ordered list of rules "if all of these thresholds hold, the text is bad" by
sequential covering: each rule is grown condition by condition for the largest
FOIL gain on one part of the labelled sample, pruned from its end on the other
part, and accepted if it is precise enough there; the rows that it covers are
then set aside. The list becomes an ordered Spark conditional expression, which
is all that runs over the corpus.

Base rules come before the list: fewer than 50 words, or more than half of the
words inside 3-word windows that the text repeats.

Defined results: a null text has no words and fails the base rules; unlabelled
or one-sided samples give an empty list, which keeps what the base rules keep;
rows with equal ids are judged each; of several labels of a document the smallest
counts, labels without id none. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from ._common import F, T, map_batches, segment_sum, strings, utf8_view

#: Labelled documents that learning reads at most.
SAMPLE = 20_000
WINDOW = 3
#: Characters counted as symbols (fixed by the statistic's definition).
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_lines"]
STATISTICS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL = _lut(SPACE), _lut(SYMBOLS)
_UPPER, _PUNCT = _lut(bytes(range(65, 91))), _lut(b"!?.,;:")


def repeated_windows(codes: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n, docs = len(codes), len(bounds) - 1
    if n < width:
        return np.zeros(docs, np.int64)
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    whole = owner[: n - width + 1] == owner[width - 1 :]
    start = np.flatnonzero(whole)
    if not len(start):
        return np.zeros(docs, np.int64)
    # windows as dense numbers, one word after another, so that no product overflows
    number = codes[start].astype(np.int64)
    for k in range(1, width):
        _, number = np.unique(number * (int(codes.max()) + 1) + codes[start + k], return_inverse=True)
    number = number.astype(np.int64) * docs + owner[start]
    _, number, count = np.unique(number, return_inverse=True, return_counts=True)
    again = start[count[number] > 1]
    marked = np.zeros(n, bool)
    for k in range(width):
        marked[again + k] = True
    return segment_sum(marked, bounds)


def batch_statistics(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    raw, offsets = utf8_view(texts)
    space = _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts[heads] = ~space[heads]  # a text's first byte follows no other
    points = (raw & 0xC0) != 0x80
    words = segment_sum(starts, offsets)
    flat = texts
    for c in "\t\n\v\f\r":
        flat = pc.replace_substring(flat, c, " ")
    lists = pc.split_pattern(flat, " ")
    values = lists.flatten()
    values = values.filter(pc.not_equal(values, ""))
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(words)))
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        own = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        lines[k] = len(own)
        dup[k] = len(own) - len(set(own))
    return [
        words,
        segment_sum(points & ~space, offsets),
        segment_sum(_SYMBOL[raw], offsets),
        dup,
        repeated_windows(codes, bounds),
        segment_sum(_UPPER[raw], offsets),
        segment_sum(_PUNCT[raw], offsets),
        lines,
    ]


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in batch_statistics(strings(batch.column(1))))], names=STATISTICS.names)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), STATISTICS, run)


#: name -> (numerator, denominator); None: 1. What rules may test.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "punct_a_word": ("n_punct", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def ratio(name: str) -> Column:
    num, den = RATIOS[name]
    top = F.col(num).cast("double")
    return top if den is None else top / F.greatest(F.col(den), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] <= self.value

    def column(self) -> Column:
        return ratio(self.name) >= F.lit(self.value) if self.above else ratio(self.name) <= F.lit(self.value)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def text(self) -> str:
        return " and ".join(f"{c.name} {'>=' if c.above else '<='} {c.value:g}" for c in self.conditions)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Condition | None]:
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base = np.log2(p0 / (p0 + n0))
    best = (0.0, None)
    for name, values in cuts.items():
        v = x[name][inside]
        y = bad[inside]
        order = np.argsort(v, kind="stable")
        v, pos = v[order], np.concatenate(([0], np.cumsum(y[order])))
        for above in (True, False):
            at = np.searchsorted(v, values, side="left" if above else "right")
            p = (pos[-1] - pos[at]) if above else pos[at]
            total = (len(v) - at) if above else at
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, float(values[k])))
    return best


def _worth(rule: Rule, x, bad) -> float:
    c = rule.covers(x)
    p, n = int((c & bad).sum()), int((c & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.97, least: int = 3) -> list[Rule]:
    """x: ratio name -> values of the labelled rows; bad: their labels."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    rng = np.random.default_rng(11)
    grow = rng.random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    cuts = {}
    for name, v in x.items():
        u = np.unique(np.quantile(v, np.linspace(0, 1, 257)))
        cuts[name] = (u[1:] + u[:-1]) / 2 if len(u) > 1 else u
    while len(rules) < max_rules:
        g = grow & left
        if (bad & g).sum() < least:
            break
        conditions: list[Condition] = []
        inside = g.copy()
        while len(conditions) < max_conditions and (~bad & inside).any():
            _, c = _best_condition(x, bad, inside, cuts)
            if c is None:
                break
            conditions.append(c)
            inside &= c.holds(x)
        if not conditions:
            break
        held = {k: v[left & ~grow] for k, v in x.items()}
        held_bad = bad[left & ~grow]
        # prune from the end; of equal worth, the shorter. Worth grows with precision, so
        # if the best is not precise enough on the rows that pruned it, none is
        choices = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        rule = max(choices, key=lambda r: (_worth(r, held, held_bad), -len(r.conditions)))
        covered = rule.covers(held)
        hits = int((covered & held_bad).sum())
        if not hits or hits < precision * covered.sum() or (rule.covers(x) & left & bad).sum() < least:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k].column(), F.lit(k + 1)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_sample(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """At most `sample` labelled rows, in the order of a hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("_q"))
    # bounded by `sample`, so this side can be broadcast
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    own = stats.join(known, "doc_id").select("_q", *(ratio(k).alias(k) for k in RATIOS))
    # one row of each label decides, also where ids repeat
    rows = own.orderBy(*own.columns).limit(2 * sample).toPandas()
    return {k: rows[k].to_numpy(float) for k in RATIOS}, rows["_q"].to_numpy() == 0


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the rows that the base rules pass: the list has nothing to say
    of the others."""
    x, bad = labelled_sample(stats.where(~base_failed()), labels, sample)
    return learn(x, bad) if len(bad) else []


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
