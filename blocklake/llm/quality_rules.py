"""Quality rules learned as decision lists.

Statistics of labelled texts are gathered by a Spark job, sequential covering
grows and prunes threshold conjunctions on them, and the result is an ordered
Spark conditional expression over the same statistics.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows, utf8

WINDOW = 8
_BLANK, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Base counts; then what only the learned rules look at.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_exclaim", "n_digits", "n_same_next", "n_lines")
#: Ratios that rules set thresholds on.
RATIOS = ("symbols_per_word", "chars_per_word", "dup_line_share", "repeat_share", "upper_share", "exclaim_per_word", "digit_share", "same_next_share", "words_per_line")
#: Bound on the labelled rows that the rules are fitted on; those with the least hashes of their ids.
SAMPLE = 20_000
#: Bad rows that a rule has to meet, so as not to follow single texts.
LEAST_HITS = 5
#: The base rule: fewer words, or a greater percentage of them in repeated windows, fails.
MIN_WORDS, MAX_REPEAT = 20, 30


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(31)
    hashes = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + codes[i : i + n]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def _counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    packed = text.translate(None, _BLANK)
    letters = packed.decode("utf-8", "replace")
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return (
        len(words), len(letters), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words),
        sum(map(str.isupper, letters)), text.count(b"!"), len(packed) - len(packed.translate(None, b"0123456789")), sum(map(operator.eq, words, words[1:])), len(lines),
    )


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts and the ratios of every row; a null or empty text has zeros. No shuffle; other columns are left out."""
    kind = docs.schema[key].dataType.simpleString()
    counted = map_rows(docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text")), lambda k, t: (k, *_counts(t)), f"key {kind}, " + ", ".join(f"{c} long" for c in BASE + EXTRA))
    return with_ratios(counted).withColumnRenamed("key", key)


def with_ratios(counted: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (
        per("n_symbols", "n_words"), per("word_chars", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_upper", "word_chars"),
        per("n_exclaim", "n_words"), per("n_digits", "word_chars"), per("n_same_next", "n_words"), per("n_words", "n_lines"),
    )
    return counted.withColumns(dict(zip(RATIOS, values, strict=True)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, is_greater, threshold); texts that meet it are bad."""

    terms: tuple[tuple[str, bool, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, greater, cut in self.terms:
            out &= x[name] > cut if greater else x[name] <= cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, cut in self.terms:
            out &= F.col(name) > cut if greater else F.col(name) <= cut
        return out


def _gain(good: int, bad: int, base: float) -> float:
    """FOIL's information gain of covering bad texts and few good ones."""
    return bad * (np.log2((bad + 1e-9) / (bad + good)) - base) if bad else 0.0


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, limit: int) -> Rule:
    """Adds the term with the most gain, and of those the widest gap at its threshold, until no good text is covered or nothing helps."""
    inside, terms = np.ones(len(bad), bool), []
    while len(terms) < limit:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-6, 0.0, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            below = np.cumsum(b)[cuts]
            count = cuts + 1
            for greater in (True, False):
                pos = p - below if greater else below
                neg = (p + n - count - pos) if greater else count - pos
                gains = np.where(pos > 0, pos * (np.log2((pos + 1e-9) / np.maximum(pos + neg, 1)) - base), 0)
                i = int(np.argmax(gains))
                low, high = float(v[cuts[i]]), float(v[cuts[i] + 1])
                margin = (high - low) / float(v[-1] - v[0])
                if (round(float(gains[i]), 6), margin) > best[:2]:
                    best = (round(float(gains[i]), 6), margin, (name, greater, (low + high) / 2))
        if best[2] is None:
            break
        terms.append(best[2])
        inside = Rule(tuple(terms)).mask(x)
    return Rule(tuple(terms))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops terms from the end while the held-out rows agree as well: (bad - good) / (bad + good)."""

    def worth(r: Rule) -> float:
        m = r.mask(x)
        p, n = int(bad[m].sum()), int((~bad[m]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    while len(best.terms) > 1 and worth(Rule(best.terms[:-1])) >= worth(best):
        best = Rule(best.terms[:-1])
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.99, max_rules: int = 24, max_terms: int = 4, tries: int = 5, seed: int = 7) -> list[Rule]:
    """Ordered rules for bad texts by sequential covering.

    Two thirds of the rows that no rule covers yet grow a rule, the last third prunes it. The pruned rule counts, or
    else the grown one, if it is right in at least `precision` of the rows it meets; if neither is, other thirds are
    drawn, `tries` times in all. Without bad or without good rows there are no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    draw = np.random.default_rng(seed)

    def right(rule: Rule) -> bool:
        met = rule.mask(x)
        return bool(rule.terms) and (met & left).sum() >= LEAST_HITS and all(bad[m].mean() >= precision for m in (met & left, met))

    failed = 0
    while failed < tries and bad[left].sum() >= LEAST_HITS and (~bad[left]).any() and len(rules) < max_rules:
        rows = np.flatnonzero(left)
        draw.shuffle(rows)
        grow, prune = rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]
        grown = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_terms)
        pruned = _prune(grown, {k: v[prune] for k, v in x.items()}, bad[prune])
        rule = next((r for r in (pruned, grown) if right(r)), None)
        if rule is None:
            failed += 1
            continue
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, as one ordered conditional expression; null if none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(i))
    return out.cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Rules from at most `sample` labelled rows (the least hashes of their keys), which come to the driver as nine ratios each.

    A row without a label, or a key labelled both ways, is left out. Of rows with an equal key the one with the
    least ratios counts.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    chosen = marks.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # at most `sample` rows
    single = text_statistics(rows, "k", "t").groupBy("k").agg(F.min(F.struct(*RATIOS)).alias("x"))  # a row for each chosen key at most
    found = single.join(F.broadcast(chosen), "k").select("k", "low", "x.*").toPandas().sort_values("k")
    return learn_rules({name: found[name].to_numpy(float) for name in RATIOS}, found["low"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> dict[str, Column]:
    """base_failed, rule (the first learned rule that rejects a text, else null) and kept over the columns of text_statistics."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rule = rules_column(rules)
    return {"base_failed": failed, "rule": rule, "kept": ~failed & rule.isNull()}


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base counts, base_failed, rule (the first learned rule that rejects the text, else null) and kept, a row per row of docs.

    A null or empty text has no words and fails the base rule. Without labels nothing but the base rule rejects.
    """
    rules = fit(docs, labels, key=key, text=text)
    stats = text_statistics(docs, key, text)
    return stats.withColumns(verdict(rules)).select(key, *BASE, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, each counted where it is read."""
    rules = fit(docs, labels, key=key, text=text)

    @F.pandas_udf("array<long>")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(_counts)

    names = BASE + EXTRA
    counted = docs.select(F.struct(*docs.columns).alias("row"), counts(utf8(F.col(text))).alias("c")).select("row", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return with_ratios(counted).where(verdict(rules)["kept"]).select("row.*")
