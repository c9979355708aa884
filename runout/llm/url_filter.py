"""URL filters by a Bloom filter cascade, in built-in column functions only.

A cascade answers membership exactly for every key of a known universe, here all keys that the corpus
has. Level 1 is a Bloom filter of the listed keys. Level 2 encodes the other keys of the universe that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until no key of the
opposite kind passes. A key is a member if it passes an odd number of levels before it is stopped, or all of
an odd number. Looking up is a handful of hashes and array reads per url; no url takes part in a join.

The universe and the listed keys are folded to distinct keys before anything else, so that a host with a
third of all pages is one row. The size of the filters follows from the counts of both kinds of keys: where it
is above ``MAX_WORDS`` the key space is cut by a hash into shards, each with a cascade of its own. Rows are
then written once by shard, and every shard's rows are looked up in their cascade, one shard after the other;
so a plan and the driver hold the filters of one shard, whatever the length of the list.

Rules: a rule has a host and the beginning of a path. A url's keys are its host's last labels with the
beginning of its path, for those numbers of labels and lengths that rules have. The longest rule that
fits wins, by host and then by path. Where none fits, a url is blocked if its whole host is listed.

Defined results: host and path of a null url, or one without ``://``, are empty, and no rule fits; a path
that does not begin with a rule's is not its; repeated urls get equal verdicts; repeated keys and rules
count once; an empty list blocks nothing; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runout.llm.common import ascii_lower, stored
from runout.sources.sinks import scratch_folder

#: 64-bit words that the levels of one cascade may have together, about (8 MB).
MAX_WORDS = 1 << 20
#: Words that come to the driver as one row.
BLOCK_WORDS = 1024
#: False positive rate of the levels after the first.
DEEP_RATE = 1 / 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``n_words`` words of 64 bits as comma-joined numbers, ``hashes`` places per key."""

    number: int
    hashes: int
    n_words: int
    words: str = field(repr=False)

    def passes(self, key: Column) -> Column:
        # the words are in the plan once a level, whatever the number of hashes
        literal = F.split(F.lit(self.words), ",").cast("array<bigint>")
        asked = F.array(*places(key, self.number, self.hashes, 64 * self.n_words))

        def is_set(place: Column) -> Column:
            word = F.get(literal, F.shiftright(place, 6).cast("int"))
            return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1

        return key.isNotNull() & F.forall(asked, is_set)


def places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """The bits of a key in a filter."""
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def shape(n: int, rate: float) -> tuple[int, int]:
    """(hashes, words) of a filter of ``n`` keys at a false positive rate."""
    hashes = max(1, round(math.log2(1 / rate)))
    return hashes, max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))


def first_rate(n_in: int, n_out: int) -> float:
    """The rate of a first level after which the second has not more keys than the first, and at most a half."""
    return min(0.5, math.sqrt(0.5) * n_in / max(n_out, 1)) if n_in else 0.5


def cascade_words(n_in: int, n_out: int) -> int:
    """Words that a cascade of this many listed and other keys needs, about."""
    rate = first_rate(n_in, n_out)
    first, second = shape(n_in, rate)[1], shape(math.ceil(rate * n_out), DEEP_RATE)[1]
    # every further level encodes a sixteenth of the keys of the level before the last
    third = shape(math.ceil(n_in * DEEP_RATE), DEEP_RATE)[1]
    return math.ceil((first + second + third) / (1 - DEEP_RATE))


@dataclass(frozen=True)
class Cascade:
    """Exact membership of a universe's keys in a list."""

    levels: list[Level]

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out


def _distinct_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) for every non-null key of the first columns of both frames."""
    both = universe.select(universe[0].alias("key"), F.lit(0).alias("listed")).unionByName(
        listed.select(listed[0].alias("key"), F.lit(1).alias("listed"))
    )
    return both.where("key IS NOT NULL").groupBy("key").agg((F.max("listed") == 1).alias("listed"))


def _counts(keys: DataFrame) -> tuple[int, int]:
    """Listed keys and others."""
    return tuple(keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade of the keys of ``listed`` over those of both frames (their first columns), in one shard."""
    keys = stored(_distinct_keys(universe, listed))
    return _cascade(keys, *_counts(keys))


def _cascade(keys: DataFrame, n_in: int, n_out: int) -> Cascade:
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    rate = first_rate(n_in, n_out)
    levels: list[Level] = []
    while n_in:
        hashes, n_words = shape(n_in, rate)
        level = _level(inside, len(levels) + 1, hashes, n_words)
        levels.append(level)
        passed = stored(outside.where(level.passes(F.col("key"))))
        inside, outside, n_in, rate = passed, inside, passed.count(), DEEP_RATE
    return Cascade(levels)


def _level(keys: DataFrame, number: int, hashes: int, n_words: int) -> Level:
    """The bits set by the keys, folded per word and joined per block of words before they reach the driver."""
    place = F.explode(F.array(*places(F.col("key"), number, hashes, 64 * n_words))).alias("place")
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    rows = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct(F.pmod("word", F.lit(BLOCK_WORDS)).cast("int"), "bits")
    blocks = rows.groupBy(F.expr(f"word div {BLOCK_WORDS}").alias("block")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("bits")
    )
    each = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("bits", i), F.lit(0))
    )
    found = dict(blocks.select("block", F.array_join(each.cast("array<string>"), ",")).collect())
    blank = ",".join(["0"] * BLOCK_WORDS)
    n_blocks = math.ceil(n_words / BLOCK_WORDS)
    return Level(number, hashes, n_words, ",".join(found.get(b, blank) for b in range(n_blocks)))


def mark_members(
    rows: DataFrame, key: str, universe: DataFrame, listed: DataFrame, name: str, max_words: int = MAX_WORDS
) -> DataFrame:
    """``rows`` with the membership of their column ``key`` in ``listed`` as the column ``name``.

    The first column of ``universe`` holds every key that rows have. A null key is no member.
    """
    keys = stored(_distinct_keys(universe, listed))
    n_in, n_out = _counts(keys)
    shards = math.ceil(cascade_words(n_in, n_out) / max_words)
    if shards <= 1:
        return rows.withColumn(name, _cascade(keys, n_in, n_out).contains(F.col(key)))

    def by_shard(df: DataFrame, of: str) -> tuple[DataFrame, ...]:
        """``df`` written once, a folder a shard, and read again shard by shard; null keys are in the first."""
        folder = scratch_folder(df.sparkSession)
        shard = F.coalesce(F.when(F.col(of).isNotNull(), F.pmod(F.xxhash64(of), F.lit(shards))), F.lit(0))
        df.withColumn("__shard", shard).write.partitionBy("__shard").parquet(folder)
        schema = StructType([*df.schema.fields, StructField("__shard", LongType())])
        whole = df.sparkSession.read.schema(schema).parquet(folder)
        return tuple(whole.where(F.col("__shard") == i).drop("__shard") for i in range(shards))

    done = None
    for some_keys, some_rows in zip(by_shard(keys, "key"), by_shard(rows, key), strict=True):
        cascade = _cascade(some_keys, *_counts(some_keys))
        part = stored(some_rows.withColumn(name, cascade.contains(F.col(key))))
        done = part if done is None else done.unionAll(part)
    return done


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> list[Column]:
    """The keys under which a rule could fit, longest first; null where host or path is too short."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)
    labels = F.split(host, r"\.")
    keys = []
    for n, size in shapes:
        tail = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
        fits = (F.size(labels) >= n) & (F.length(path) >= size)
        keys.append(F.when(fits, F.concat(tail, F.substring(path, 1, size))))
    return keys


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed_hosts: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule (host and path, null if none fits), listed and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = mark_members(rows, "host", rows.select("host"), listed_hosts, "listed")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    if rules:
        keys = rule_keys(F.col("host"), F.col("path"), rules)
        corpus = rows.select(F.explode(F.array_compact(F.array(*keys))))
        by_rule = build_cascade(corpus, spark.range(1).select(F.explode(F.array(*(F.lit(r.key) for r in rules)))))
        verdicts = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.verdict)))
        # as a filter of the keys the levels are written once, not once per key
        rule = F.get(F.filter(F.array_compact(F.array(*keys)), by_rule.contains), F.lit(0))
        verdict = F.element_at(verdicts, F.col("rule"))
    rows = rows.withColumn("rule", rule)
    other = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce(verdict, other))
