"""Quality rules as a short-circuit cascade, all in built-in column functions.

Every rule is a condition that rejects a text. On a sample the rejections of each rule are counted and
its evaluation is timed; rules then run in order of rejection per cost, as the branches of one CASE WHEN:
a text leaves at the first rule that rejects it and the dearer rules never see it. The verdict does not
depend on the order, only the time does (and the name of the rule that a text left by). A text is split into
words once, whichever rules look at them.

Words are runs of characters other than space and U+0009 to U+000D. Nothing is shuffled: repeated
five-word windows are found inside each row, first by comparing the number of distinct window hashes with
the number of windows, and only for texts where these differ by sorting (hash, place) pairs. Windows are
compared by 64-bit XXH64 values of their words' XXH64 values.

Defined results: a null or blank text has no words, fails the base rules and is not kept; copies and ties
get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runout.llm.common import stored

#: Bound of the sample that rules are timed on: rows, and characters of a text that may enter it.
SAMPLE_ROWS = 500
SAMPLE_CHARS = 20_000
#: Seconds that a timed evaluation is to take beside reading, the most copies of the sample that it is
#: given to reach them, and seconds by which jobs differ anyway: no cost is taken to be less.
TIMED_SECONDS, MOST_COPIES, NOISE_SECONDS = 0.2, 128, 0.02
#: Factor by which ranks, or costs, must differ to count as different.
APART = 1.5

_BLANK = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    for blank in _BLANK[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    # one plain character is split at without a regular expression
    return F.array_remove(F.split(text, " "), "")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.coalesce(F.length(F.translate(text, _BLANK, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters that prose hardly has."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long")


def line_counts(text: Column) -> Column:
    """Lines with a word (n), and those of them that equal an earlier line (dup)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    with_words = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        with_words,
        lambda found: F.struct(
            F.size(found).alias("n"), (F.size(found) - F.size(F.array_distinct(found))).alias("dup")
        ),
    )


def _repeat_words(words: Column, size: int) -> Column:
    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - size)
        return F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, _covered_words(size))

    def repeats(hashes: Column) -> Column:
        same = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(same, F.lit(0)).otherwise(covered(hashes))

    return F.when(F.size(words) <= size, F.lit(0)).otherwise(
        let(F.transform(words, lambda word: F.xxhash64(word)), lambda hashes: let(windows(hashes), repeats))
    )


def _covered_words(size: int) -> Callable[[Column], Column]:
    """From sorted (hash, place) pairs to the number of words that windows of repeated hashes cover."""

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1

        def twice(p: Column, k: Column) -> Column:
            before = F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"] == p["h"]
            after = F.get(pairs, F.least(k + 1, last))["h"] == p["h"]
            return ((k > 0) & before) | ((k < last) & after)

        return F.sort_array(F.transform(F.filter(pairs, twice), lambda p: p["i"]))

    def length(places: Column) -> Column:
        end = F.size(places) - 1
        steps = F.transform(
            places, lambda p, k: F.when(k == end, size).otherwise(F.least(F.get(places, k + 1) - p, F.lit(size)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return lambda pairs: let(repeated(pairs), length)


@dataclass(frozen=True)
class Counts:
    """What rules look at, as columns: expressions of the text, or counts that are there already."""

    chars: Column
    n_words: Column
    n_symbols: Column
    lines: Column  # as ``line_counts`` has them
    n_repeat_words: Column
    n_upper: Column
    n_not_letters: Column

    @classmethod
    def of(cls, text: Column, words: Column) -> Counts:
        def kept(pattern: str) -> Column:
            return F.coalesce(F.length(F.regexp_replace(text, pattern, "")), F.lit(0))

        return cls(
            chars=F.coalesce(F.length(text), F.lit(0)),
            n_words=F.size(words),
            n_symbols=n_symbols(text),
            lines=line_counts(text),
            n_repeat_words=_repeat_words(words, 5),
            n_upper=kept(r"[^\p{Lu}]+"),
            n_not_letters=kept(r"[\p{L}\p{M}\s]+"),
        )


@dataclass(frozen=True)
class Rule:
    """A named condition under which a text is rejected."""

    name: str
    rejects: Callable[[Counts], Column]


#: The base of every verdict: too few words, or over a fifth of them in repeated windows.
BASE_RULES = (
    Rule("few_words", lambda c: c.n_words < 10),
    Rule("repeated_windows", lambda c: 100 * c.n_repeat_words > 20 * c.n_words),
)
#: Shares of a text's characters, words or lines that prose stays far from.
RULES = (
    Rule("symbols", lambda c: 100 * c.n_symbols > 4 * c.chars),
    Rule("upper_case", lambda c: 100 * c.n_upper > 45 * c.chars),
    Rule("not_letters", lambda c: 100 * c.n_not_letters > 55 * c.chars),
    Rule("long_words", lambda c: c.chars > 26 * c.n_words),
    Rule("duplicate_lines", lambda c: let(c.lines, lambda found: 100 * found["dup"] > 60 * found["n"])),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float  # seconds for the sample
    rejected: int  # rows of the sample
    spread: float = 0.0  # of the timed runs, relative to their time

    @property
    def rank(self) -> float:
        return self.rejected / self.cost


def hash_sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts of some four times ``rows`` rows, chosen by a hash of the text.

    Stored, so that nothing but the hash is computed for the rows that are not chosen.
    """
    share = min(1.0, 4 * rows / max(1, docs.count()))
    lot = F.pmod(F.xxhash64(text_col, F.lit("rules")), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.where(lot < share).select(F.col(text_col).alias("text"))
    return stored(texts.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS))


def bounded(sample: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows of a sample, stored, one row per text."""
    return stored(sample.dropDuplicates(["text"]).orderBy(F.xxhash64("text", F.lit("rules"))).limit(rows))


def estimate(sample: DataFrame, counts: Counts, rules: Sequence[Rule]) -> list[Estimate]:
    """Cost and selectivity of every rule on a bounded, stored sample of the texts that reach the cascade.

    ``counts`` are columns of the sample, as the cascade has them: what it finds computed is computed in the
    sample as well, so that a rule is charged for its own work only. Every rule runs over as many copies of
    the sample as it takes to be well above what jobs differ by. Reading as many copies is subtracted.
    """
    baselines: dict[int, float] = {}

    def timed(condition: Column, copies: int) -> tuple[float, float, int]:
        """Least seconds of three runs, the first of which compiles, their spread, and rows found."""
        several = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        job, seconds, n = several.agg(F.count_if(condition).alias("n")), [], 0
        for _ in range(3):
            start = time.perf_counter()
            n = job.first().n
            seconds.append(time.perf_counter() - start)
        return min(seconds), max(seconds[1:]) / min(seconds[1:]) - 1, n // copies

    def of(rule: Rule) -> Estimate:
        copies = 4
        while True:
            if copies not in baselines:
                baselines[copies] = timed(F.length("text") < 0, copies)[0]
            seconds, spread, rejected = timed(rule.rejects(counts), copies)
            own = seconds - baselines[copies]
            if own >= TIMED_SECONDS or copies >= MOST_COPIES:
                return Estimate(rule, max(own, NOISE_SECONDS) / copies, rejected, spread)
            copies = min(MOST_COPIES, copies * 8)

    return [of(rule) for rule in rules]


def ordered(estimates: Sequence[Estimate]) -> list[Rule]:
    """Most rejections per cost first; among rules that reject nothing, the cheaper first.

    Rules that differ by less than ``APART``, which timing may turn around, keep the order they are given in.
    """
    place = {e.rule.name: i for i, e in enumerate(estimates)}
    falling = sorted(((e.rank or -e.cost, e) for e in estimates), key=lambda x: -x[0])
    groups: list[list[Estimate]] = []
    before = 0.0
    for rank, e in falling:
        near = rank * before > 0 and (before <= rank * APART if rank > 0 else rank >= before * APART)
        if not near:
            groups.append([])
        groups[-1].append(e)
        before = rank
    return [e.rule for g in groups for e in sorted(g, key=lambda e: place[e.rule.name])]


def cascade(counts: Counts, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the text, null if none does; later rules are not run."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].rejects(counts), F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects(counts), F.lit(rule.name))
    return out


def _base_counts(words: Column) -> Column:
    return F.struct(
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        _repeat_words(words, 5).alias("n_repeat_words"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with the counts that every text is asked for, all from its column ``text``, and base_failed."""
    text = F.col("text")
    base = let(words_of(text), _base_counts)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = rows.withColumn("base", base).withColumn("lines", line_counts(text))
    return found.select(
        *rows.columns,
        *(F.col(f"base.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")),
        n_symbols(text).alias("n_symbols"),
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "lines",
    ).withColumn("base_failed", failed)


def _known() -> Counts:
    """What the cascade of ``measure`` looks at: columns of ``_counted`` where these have it."""
    counts = Counts.of(F.col("text"), F.lit(None).cast("array<string>"))
    return replace(counts, **{c: F.col(c) for c in ("n_words", "n_symbols", "lines", "n_repeat_words")})


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, failed_rule (of the cascade) and kept.

    The counts are asked for of every text; the cascade runs only where the base holds, and is timed on
    such texts, with the counts there.
    """
    survivors = bounded(_counted(hash_sample(docs, text_col)).where("NOT base_failed"))
    order = ordered(estimate(survivors, _known(), rules))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    judged = _counted(rows).withColumn(
        "failed_rule", F.when(~F.col("base_failed"), cascade(_known(), order))
    )
    kept = ~F.col("base_failed") & F.col("failed_rule").isNull()
    return judged.withColumn("kept", kept).select(
        F.col("__id").alias(id_col),
        *("n_words", "word_chars", "n_repeat_words", "n_symbols", "n_dup_lines", "base_failed", "failed_rule", "kept"),
    )


def order_for_texts(docs: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The order of rules that look at bare texts, timed with their words split already."""
    sample = bounded(hash_sample(docs)).withColumn("words", words_of(F.col("text")))
    return ordered(estimate(stored(sample), Counts.of(F.col("text"), F.col("words")), rules))


def drop_rejected(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES)) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` no rule rejects; base rules take part in the order."""
    order, text = order_for_texts(docs, rules), F.col("text")
    return docs.where(let(words_of(text), lambda words: cascade(Counts.of(text, words), order)).isNull())
