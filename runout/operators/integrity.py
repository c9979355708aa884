"""Checks on the raw extracts: keys, formats, causality and plausibility.

They take the all-text extracts by table name. Rule checks yield ``(rule, n_violations)``;
statistical ones ``(rule, measured, required, passed)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.columns import QTY, parse_date
from runout.operators.quality import all_of, condition_counts, dealt, summary
from runout.params import Params

Extracts = Mapping[str, DataFrame]

# Child columns -> parent columns of each foreign key.
FOREIGN_KEYS = [
    ("VBAP", ["vbeln"], "VBAK", ["vbeln"]),
    ("LIPS", ["vgbel"], "EKKO", ["ebeln"]),
    ("EKPO", ["ebeln"], "EKKO", ["ebeln"]),
    ("VBAP", ["matnr"], "MARA", ["matnr"]),
    ("LIPS", ["vbeln"], "LIKP", ["vbeln"]),
    ("VBBE", ["vbeln"], "VBAK", ["vbeln"]),
    ("EQUP", ["qunum"], "EQUK", ["qunum"]),
]
COMPOSITE_FOREIGN_KEYS = [
    ("EKPO", ["matnr", "werks"], "MARC", ["matnr", "werks"]),
    ("LIPS", ["vbeln", "posnr"], "VBUP", ["vbeln", "posnr"]),
    ("EKET", ["ebeln", "ebelp"], "EKPO", ["ebeln", "ebelp"]),
    ("VBBE", ["matnr", "werks"], "MARC", ["matnr", "werks"]),
]
# Primary keys. KNA1 and LFA1 are checked for NULLs only.
PRIMARY_KEYS = {
    "VBAK": ["vbeln"],
    "VBAP": ["vbeln", "posnr"],
    "LIKP": ["vbeln"],
    "LIPS": ["vbeln", "posnr"],
    "VBUP": ["vbeln", "posnr"],
    "EKKO": ["ebeln"],
    "EKPO": ["ebeln", "ebelp"],
    "EKET": ["ebeln", "ebelp", "etenr"],
    "MARA": ["matnr"],
    "MARC": ["matnr", "werks"],
    "MARD": ["matnr", "werks", "lgort"],
    "T001W": ["werks"],
    "KNA1": ["kunnr"],
    "LFA1": ["lifnr"],
    "EQUK": ["qunum"],
    "EQUP": ["qunum", "qupos"],
}
NULL_CHECK_ONLY = {"KNA1", "LFA1"}
# Date columns, id lengths, constants and least row counts.
DATE_COLUMNS = [
    ("VBAK", "erdat"),
    ("LIKP", "erdat"),
    ("LIKP", "wadat"),
    ("LIKP", "wadat_ist"),
    ("EKKO", "bedat"),
    ("EKET", "eindt"),
    ("VBBE", "mbdat"),
    ("RESB", "bddat"),
    ("MARA", "ersda"),
]
ID_LENGTHS = [
    ("MARA", "matnr", 18),
    ("VBAK", "vbeln", 10),
    ("LIKP", "vbeln", 10),
    ("KNA1", "kunnr", 10),
    ("LFA1", "lifnr", 10),
]
CONSTANTS = [
    ("VBAK", "mandt", "100"),
    ("EKKO", "mandt", "100"),
    ("MARA", "mandt", "100"),
    ("LIKP", "lfart", "EL"),
]
LEAST_ROWS = {
    "VBAK": 5000,
    "VBAP": 20000,
    "LIKP": 4000,
    "EKKO": 1500,
    "EKPO": 4000,
    "MARA": 500,
    "KNA1": 100,
    "LFA1": 50,
}


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]):
    """Child rows whose key is not among the parent's; a NULL key is an orphan."""
    known = parent.select([F.col(c).alias(f"parent_{c}") for c in parent_keys])
    same = [F.col(c) == F.col(f"parent_{k}") for c, k in zip(keys, parent_keys, strict=True)]
    return child.join(known, same, "left_anti")


def _key_name(table: str, columns: list[str]) -> str:
    return f"{table}({','.join(columns)})"


def foreign_key_rule(child: str, columns: list[str], parent: str, parent_columns: list[str]) -> str:
    return f"{_key_name(child, columns)} in {_key_name(parent, parent_columns)}"


def key_counts(
    extracts: Extracts, foreign: list[tuple] = (), primary: Mapping[str, list[str]] | None = None
) -> tuple[DataFrame, list[str]]:
    """How often each key occurs under each rule: ``(rule, k0, k1, .., n, known)``, and the rules' names.

    Every table is read once. A row is unfolded to the rules that it is a child, a parent or a holder of a
    key in; the tables' rows meet in one aggregation. ``rule`` is the place of the rule's name, the key's
    fields are columns, NULL beyond the key's length. ``n`` counts children and holders, ``known`` tells
    whether there is a parent. A parent without a full key is none.

    Most keys occur once or a few times, so combining them before the shuffle would hold nearly every row of
    a task in memory and save little: the bare keys are shuffled, and a task that counts them holds its
    distinct keys only. The rows of a hot key are counted by one task as they come, in one entry.
    """
    rules: list[str] = []
    marks: dict[str, list[Column]] = {}
    keys = [(child, columns) for child, columns, *_ in foreign] + list((primary or {}).items())
    width = max(len(columns) for _, columns in keys)
    fields = [f"k{i}" for i in range(width)]

    def mark(table: str, columns: list[str], parent: bool) -> None:
        key = [F.col(c) for c in columns] + [F.lit(None).cast("string")] * (width - len(columns))
        found = F.struct(
            F.lit(len(rules) - 1).alias("rule"),
            *[k.alias(f) for k, f in zip(key, fields, strict=True)],
            F.lit(0 if parent else 1).cast("long").alias("n"),
            F.lit(parent).alias("known"),
        )
        full = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
        marks.setdefault(table, []).append(F.when(full, found) if parent else found)

    for child, columns, parent, parent_columns in foreign:
        rules.append(foreign_key_rule(child, columns, parent, parent_columns))
        mark(child, columns, parent=False)
        mark(parent, parent_columns, parent=True)
    for table, columns in (primary or {}).items():
        rules.append(_key_name(table, columns))
        mark(table, columns, parent=False)
    rows = [
        extracts[table].select(F.explode(F.array_compact(F.array(*found))).alias("mark")).select("mark.*")
        for table, found in marks.items()
    ]
    keyed = dealt(all_of(rows), "rule", *fields).groupBy("rule", *fields)
    return keyed.agg(F.sum("n").alias("n"), F.max("known").alias("known")), rules


def _per_rule(counts: DataFrame, rules: list[str], broken: Column) -> DataFrame:
    """Sum of the broken rows of each key; every rule has keys unless its tables are empty."""
    found = counts.groupBy("rule").agg(F.sum(broken).alias("n_violations"))
    name = F.get(F.array(*map(F.lit, rules)), F.col("rule"))
    return found.select(name.alias("rule"), "n_violations")


def _every_rule(found: DataFrame, rules: list[str]) -> DataFrame:
    """Rules without any key hold."""
    none = found.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, rules))).alias("rule"), F.lit(0).cast("long").alias("n_violations")
    )
    return found.unionByName(none).groupBy("rule").agg(F.max("n_violations").alias("n_violations"))


def _orphan_counts(extracts: Extracts, keys: list[tuple]) -> DataFrame:
    """Child rows per foreign key whose key no parent has; a NULL key is an orphan."""
    orphaned = F.when(F.col("known"), 0).otherwise(F.col("n"))
    counts, rules = key_counts(extracts, foreign=keys)
    return _every_rule(_per_rule(counts, rules, orphaned), rules)


def fk_orphans(extracts: Extracts) -> DataFrame:
    return _orphan_counts(extracts, FOREIGN_KEYS)


def fk_orphans_composite(extracts: Extracts) -> DataFrame:
    return _orphan_counts(extracts, COMPOSITE_FOREIGN_KEYS)


def pk_nulls(extracts: Extracts) -> DataFrame:
    """NULL fields in primary keys, counted per field."""
    frames = []
    for table, key in PRIMARY_KEYS.items():
        nulls = sum(F.col(c).isNull().cast("int") for c in key)
        frames.append(
            extracts[table]
            .agg(F.coalesce(F.sum(nulls), F.lit(0)).alias("n_violations"))
            .select(F.lit(_key_name(table, key)).alias("rule"), "n_violations")
        )
    return all_of(frames)


def pk_duplicates(extracts: Extracts) -> DataFrame:
    """Rows beyond the first of each primary key."""
    keys = {t: key for t, key in PRIMARY_KEYS.items() if t not in NULL_CHECK_ONLY}
    counts, rules = key_counts(extracts, primary=keys)
    return _every_rule(_per_rule(counts, rules, F.col("n") - 1), rules)


def _per_table(extracts: Extracts, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Condition counts with the conditions grouped by table, one pass over each."""
    by_table: dict[str, dict[str, Column]] = {}
    for table, rule, broken in rules:
        by_table.setdefault(table, {})[rule] = broken
    return all_of([condition_counts(extracts[t], r) for t, r in by_table.items()])


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def date_format(extracts: Extracts) -> DataFrame:
    """Date texts that are not ``YYYYMMDD``; blanks are ignored."""
    return _per_table(
        extracts,
        [(t, f"{t}.{c}", filled(c) & parse_date(c).isNull()) for t, c in DATE_COLUMNS],
    )


def id_length(extracts: Extracts) -> DataFrame:
    return _per_table(
        extracts,
        [
            (t, f"{t}.{c} has {n} characters", F.coalesce(F.length(c) != n, F.lit(True)))
            for t, c, n in ID_LENGTHS
        ],
    )


def constant_value(extracts: Extracts) -> DataFrame:
    return _per_table(
        extracts,
        [
            (t, f"{t}.{c} is {v}", F.coalesce(F.col(c) != v, F.lit(True)))
            for t, c, v in CONSTANTS
        ],
    )


def _qty(column: str) -> Column:
    return F.col(column).cast(QTY)


def over_receipt(extracts: Extracts) -> DataFrame:
    """Schedule lines that received more than was ordered, beyond a cent."""
    excess = _qty("wemng") - _qty("menge")
    return condition_counts(extracts["EKET"], {"received <= ordered": excess > 0.01})


def early_receipt(extracts: Extracts, p: Params) -> DataFrame:
    early = (parse_date("eindt") > p.today) & (_qty("wemng") > 0)
    return condition_counts(extracts["EKET"], {"nothing received before it is due": early})


def value_tolerance(extracts: Extracts) -> DataFrame:
    """Order values that differ from quantity times price by more than 1 % and 5 cents."""
    expected = _qty("menge") * _qty("netpr")
    off = F.abs(_qty("netwr") - expected) > F.abs(expected) * F.lit("0.01").cast(
        "decimal(3,2)"
    ) + F.lit("0.05").cast("decimal(3,2)")
    return condition_counts(extracts["EKPO"], {"value = quantity x price": off})


def receipt_in_future(extracts: Extracts, p: Params) -> DataFrame:
    late = parse_date("wadat_ist") > p.today
    return condition_counts(extracts["LIKP"], {"confirmed receipts not after the anchor": late})


def asn_status_conflict(extracts: Extracts) -> DataFrame:
    """Received items of deliveries that have no actual goods issue yet."""
    underway = extracts["LIKP"].where(~filled("wadat_ist")).select("vbeln")
    received = extracts["VBUP"].where("wbstk = 'C'").join(underway, "vbeln", "left_semi")
    return summary("deliveries underway are not received", received)


def open_qty_positive(extracts: Extracts) -> DataFrame:
    """A missing quantity is not positive either."""
    positive = F.coalesce(F.col("omeng").cast("decimal(18,4)") > 0, F.lit(False))
    return condition_counts(extracts["VBBE"], {"open quantity positive": ~positive})


def _measure(rule: str, measured: Column, required: Column, passed: Column) -> list[Column]:
    return [
        F.lit(rule).alias("rule"),
        measured.cast("double").alias("measured"),
        required.cast("double").alias("required"),
        passed.alias("passed"),
    ]


def future_demand_share(extracts: Extracts, p: Params) -> DataFrame:
    """More than half of the dated open demand lies on or after the anchor."""
    due = parse_date("mbdat")
    counts = extracts["VBBE"].agg(
        F.count_if(due >= p.today).alias("future"), F.count(due).alias("n")
    )
    return counts.select(
        _measure(
            "demand lines on or after the anchor",
            F.col("future"),
            F.col("n") * 0.5,
            F.col("future") > F.col("n") * 0.5,
        )
    )


def future_supply_count(extracts: Extracts, p: Params) -> DataFrame:
    """More than 100 schedule lines lie on or after the anchor."""
    counts = extracts["EKET"].agg(F.count_if(parse_date("eindt") >= p.today).alias("future"))
    return counts.select(
        _measure(
            "schedule lines on or after the anchor",
            F.col("future"),
            F.lit(100),
            F.col("future") > 100,
        )
    )


def active_quota_share(extracts: Extracts, p: Params) -> DataFrame:
    """At least 80 % of the quota windows contain the anchor."""
    active = p.today.between(parse_date("vdatu"), parse_date("bdatu"))
    counts = extracts["EQUK"].agg(F.count_if(active).alias("active"), F.count("*").alias("n"))
    return counts.select(
        _measure(
            "quota windows containing the anchor",
            F.col("active"),
            F.col("n") * 0.8,
            F.col("active") >= F.col("n") * 0.8,
        )
    )


def top_share(df: DataFrame, key: str, qty: Column, parts: int = 5) -> DataFrame:
    """Share of the total held by the top ``1/parts`` of the keys (at least one key).

    Returns one row ``(keys, top_keys, top_qty, total_qty)``. Ranking every key would put them all
    in one task. Instead the smallest top quantity is located digit by digit: each step counts the
    keys per 16-bit digit (at most 65,536 groups), finds the digit in which the ranking passes the
    wanted number of keys, and looks only at the keys in that digit next. Keys of equal quantity
    are interchangeable, so the sum is exact. The digit found so far is always one row, hence the
    broadcasts: they keep the keys from being shuffled by a digit they may all share.
    """
    offset = 2**62  # quantities of either sign sort as unsigned digits
    per_key = df.groupBy(key).agg(F.sum(qty.cast(QTY)).alias("qty")).where("qty IS NOT NULL")
    per_key = per_key.select("qty", ((F.col("qty") * 100).cast("bigint") + offset).alias("v"))
    totals = per_key.agg(
        F.count("*").alias("keys"),
        F.sum("qty").alias("total_qty"),
        F.shiftright(F.min("v"), 63).alias("prefix"),
    )
    cut = totals.select(
        "keys",
        "total_qty",
        F.greatest(F.lit(1), F.floor(F.col("keys") / parts)).alias("top_keys"),
        F.greatest(F.lit(1), F.floor(F.col("keys") / parts)).alias("wanted"),
        F.lit(0).cast("decimal(38,2)").alias("above"),
        "prefix",
    )
    by_digit = Window.partitionBy("prefix").orderBy(F.desc("digit")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for shift in (48, 32, 16, 0):
        inside = per_key.select(
            "qty",
            F.shiftright("v", shift).alias("digit"),
            F.shiftright("v", min(shift + 16, 63)).alias("prefix"),
        )
        # the one row of the cut is joined once and goes along with the counts: a step adds one
        # reader of the keys to the plan, not a second copy of all steps before it
        counts = (
            inside.join(F.broadcast(cut), "prefix")
            .groupBy("prefix", "digit")
            .agg(
                F.count("*").alias("n"),
                F.sum("qty").alias("s"),
                *[F.first(c).alias(c) for c in ("keys", "total_qty", "top_keys", "wanted", "above")],
            )
            .withColumn("upto_n", F.sum("n").over(by_digit))
            .withColumn("upto_s", F.sum("s").over(by_digit))
        )
        passing = (F.col("upto_n") >= F.col("wanted")) & (
            F.col("upto_n") - F.col("n") < F.col("wanted")
        )
        cut = counts.where(passing).select(
            "keys",
            "total_qty",
            "top_keys",
            (F.col("wanted") - (F.col("upto_n") - F.col("n"))).alias("wanted"),
            (F.col("above") + F.col("upto_s") - F.col("s")).cast("decimal(38,2)").alias("above"),
            F.col("digit").alias("prefix"),
        )
    # what is left wanted all has the quantity the digits spell
    smallest = (F.col("prefix") - offset).cast("decimal(20,0)") / 100
    top = F.col("above") + F.col("wanted") * smallest
    return cut.select("keys", "top_keys", top.alias("top_qty"), "total_qty")


def pareto_share(extracts: Extracts) -> DataFrame:
    """The top fifth of the materials carries at least half of the ordered quantity."""
    share = F.round(F.col("top_qty").cast("double") / F.col("total_qty").cast("double"), 6)
    return top_share(extracts["VBAP"], "matnr", F.col("menge")).select(
        _measure("share of the top fifth of materials", share, F.lit(0.5), share >= 0.5)
    )


def min_volume(extracts: Extracts) -> DataFrame:
    frames = []
    for table, least in LEAST_ROWS.items():
        counts = extracts[table].agg(F.count("*").alias("n"))
        frames.append(
            counts.select(
                _measure(f"{table} rows", F.col("n"), F.lit(least), F.col("n") >= least)
            )
        )
    return all_of(frames)
