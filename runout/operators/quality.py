"""Model tests: each names a rule and yields the rows that break it; no rows means it holds.

``violations`` applies all rules of a table in one pass: a row is unfolded to the rules it may break, with
the columns that name what breaks them, and one aggregation per table counts these. ``counted`` reduces
that to ``(rule, n_violations)``, one row per rule, which a clean table has too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that keys are dealt to at least; more if ``spark.sql.shuffle.partitions`` is more. Spark does not merge
#: tasks whose number is given. It leaves a shuffle out if the rows lie in the same number of partitions
#: already, which may be few merged ones, so the number is never that of the session.
KEY_TASKS = 199
#: Violations of one rule that are kept as rows; all are counted.
SHOWN_ROWS = 100_000
REPEATED, UNACCEPTED, BROKEN = "repeated", "unaccepted", "broken"


@dataclass(frozen=True)
class Rule:
    """What the rows of a table must keep.

    ``columns`` name a violation. A repeated rule is broken by values of them that occur more than once
    (NULL in a single column is ignored, in a combination NULLs are equal), an unaccepted one by values
    for which ``condition`` holds, each counted once, and any other by rows for which it holds.
    """

    name: str
    columns: tuple[str, ...]
    kind: str
    condition: Column | None = None

    def applies(self) -> Column:
        if self.kind != REPEATED:
            return self.condition
        return F.col(self.columns[0]).isNotNull() if len(self.columns) == 1 else F.lit(True)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by columns to as many tasks as keys need, to be counted there."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = KEY_TASKS if session < KEY_TASKS else session - 1
    return df.repartition(tasks, *columns)


def _repeated(df: DataFrame, rule: Rule) -> DataFrame:
    """Violations of a table's one rule, that values do not repeat.

    As nearly all values differ, nothing is combined before the shuffle, which carries the bare columns.
    Rows are dealt by the first of them alone: rows that share it stay side by side on their way, where
    they compress well, and the whole combination is counted where they arrive.
    """
    names = list(rule.columns)
    rows = dealt(df.where(rule.applies()).select(*names), names[0])
    counts = rows.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1")
    return counts.select(
        F.lit(rule.name).alias("rule"), F.to_json(F.struct(*names)).alias("key"), F.col("__n").alias("n")
    )


def violations(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """What breaks the rules of one table: ``(rule, key, n)``, ``key`` being the columns as JSON.

    One scan and one aggregation, whatever the number of rules; several rules are combined map-side. The
    keys keep their types until they are found to break a rule.
    """
    rules = list(rules)
    if [r.kind for r in rules] == [REPEATED]:
        return _repeated(df, rules[0])
    names = list(dict.fromkeys(c for r in rules for c in r.columns))
    kinds = {c: df.schema[c].dataType for c in names}

    def mark(rule: Rule) -> Column:
        key = [
            (F.col(c) if c in rule.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names
        ]
        return F.when(rule.applies(), F.struct(F.lit(rule.name).alias("__rule"), *key))

    marks = F.array_compact(F.array(*map(mark, rules)))
    found = df.select(F.explode(marks).alias("mark")).select("mark.*")
    repeated = [r.name for r in rules if r.kind == REPEATED]
    counts = found.groupBy("__rule", *names).agg(F.count("*").alias("__n"))
    return counts.where(~F.col("__rule").isin(repeated) | (F.col("__n") > 1)).select(
        F.col("__rule").alias("rule"),
        F.to_json(F.struct(*names)).alias("key"),
        F.col("__n").alias("n"),
    )


def counted(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``(rule, n_violations)`` of violations, for rules that nothing breaks as well.

    Repeated and unaccepted values count once each, other violations by their rows.
    """
    rules = list(rules)
    by_row = [r.name for r in rules if r.kind == BROKEN]
    weight = F.when(F.col("rule").isin(by_row), F.col("n")).otherwise(F.lit(1).cast("long"))
    none = found.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"),
        F.lit(0).cast("long").alias("weight"),
    )
    every = found.select("rule", weight.alias("weight")).unionByName(none)
    return every.groupBy("rule").agg(F.sum("weight").alias("n_violations"))


def shown(found: DataFrame, most: int = SHOWN_ROWS) -> DataFrame:
    """At most ``most`` violations of each rule, those broken by the most rows first."""
    worst = Window.partitionBy("rule").orderBy(F.desc("n"), "key")
    return found.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= most).drop("place")


def unique_violations(df: DataFrame, *columns: str) -> DataFrame:
    """Values of one column, or combinations of several, that occur more than once.

    For a single column NULLs are ignored. A combination counts NULLs as equal.
    """
    if len(columns) == 1:
        df = df.where(F.col(columns[0]).isNotNull())
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values_violations(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list, with how often each occurs. NULL passes."""
    return df.where(~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def summary(rule: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("n_violations")).select(
        F.lit(rule).alias("rule"), "n_violations"
    )


def condition_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows per broken condition, all conditions of a table in one pass over it."""
    counts = df.agg(*[F.count_if(condition).alias(rule) for rule, condition in rules.items()])
    return counts.unpivot([], [F.col(f"`{r}`") for r in rules], "rule", "n_violations")


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unique_rule(table: str, *columns: str) -> Rule:
    name = f"{table}.{columns[0]}" if len(columns) == 1 else f"{table}({','.join(columns)})"
    return Rule(f"unique {name}", columns, REPEATED)


def accepted_rule(table: str, column: str, values: list) -> Rule:
    """Broken by distinct values outside the list. NULL passes."""
    return Rule(f"accepted_values {table}.{column}", (column,), UNACCEPTED, ~F.col(column).isin(values))


def null_rule(table: str, column: str, key: Iterable[str] = ()) -> Rule:
    return Rule(f"not_null {table}.{column}", tuple(key) or (column,), BROKEN, F.col(column).isNull())


def checked(tables: Mapping[str, DataFrame], rules: Mapping[str, list[Rule]]) -> DataFrame:
    """Violations of all tables, one pass over each."""
    return all_of([violations(tables[table], of_table) for table, of_table in rules.items()])


def _counts(tables: Mapping[str, DataFrame], rules: Mapping[str, list[Rule]]) -> DataFrame:
    return counted(checked(tables, rules), [r for of_table in rules.values() for r in of_table])


def dq_unique(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    return _counts(tables, {t: [unique_rule(t, column)] for t, column in keys.items()})


def dq_unique_combo(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    return _counts(tables, {t: [unique_rule(t, *columns)] for t, columns in keys.items()})


def dq_not_null(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    return all_of(
        [
            condition_counts(
                tables[table], {f"not_null {table}.{c}": F.col(c).isNull() for c in cols}
            )
            for table, cols in columns.items()
        ]
    )


def dq_accepted_values(
    tables: dict[str, DataFrame], accepted: dict[tuple[str, str], list]
) -> DataFrame:
    """Counts distinct values outside the list."""
    rules: dict[str, list[Rule]] = {}
    for (table, column), values in accepted.items():
        rules.setdefault(table, []).append(accepted_rule(table, column, values))
    return _counts(tables, rules)


RATE_RANGE = "otd_rate between 0 and 1"
NULL_PROJECTION = "projected quantity not null"
NEGATIVE_TRANSIT = "max_tt not negative"
NEGATIVE_RED_DAYS = "red_days not negative"


def mart_conditions() -> dict[str, tuple[str, Column]]:
    """The rule of its own that a table has, and the rows that break it."""
    rate = F.col("otd_rate")
    return {
        "mart_vendor_performance": (RATE_RANGE, (rate < 0) | (rate > 1)),
        "mart_inventory_simulation": (NULL_PROJECTION, F.col("simulated_inventory_qty").isNull()),
        "int_tt_quota": (NEGATIVE_TRANSIT, F.col("max_tt") < 0),
        "mart_shortage_report": (NEGATIVE_RED_DAYS, F.col("red_days") < 0),
    }


def _condition_count(table: str, df: DataFrame) -> DataFrame:
    return condition_counts(df, dict([mart_conditions()[table]]))


def dq_rate_range(vendors: DataFrame) -> DataFrame:
    return _condition_count("mart_vendor_performance", vendors)


def dq_null_projection(simulation: DataFrame) -> DataFrame:
    return _condition_count("mart_inventory_simulation", simulation)


def dq_negative_transit(transit: DataFrame) -> DataFrame:
    return _condition_count("int_tt_quota", transit)


def dq_negative_red_days(report: DataFrame) -> DataFrame:
    return _condition_count("mart_shortage_report", report)


# What the model tests are applied to.
UNIQUE = {
    "stg_marc": "marc_id",
    "stg_ekko": "po_number",
    "stg_ekpo": "ekpo_id",
    "stg_likp": "delivery_number",
    "int_pn_infor": "marc_id",
    "mart_shortage_report": "marc_id",
    "mart_vendor_performance": "vendor_number",
}
UNIQUE_COMBINATIONS = {
    "int_factory_calendar": ["plant", "calendar_date"],
    "int_working_calendar": ["plant", "calendar_date"],
    "int_tt_quota": ["marc_id", "vendor_number"],
    "mart_inventory_simulation": ["marc_id", "calendar_date"],
    "mart_consumption": ["marc_id", "requirement_date"],
}
NOT_NULL = {
    "stg_marc": ["marc_id"],
    "stg_ekko": ["po_number"],
    "stg_ekpo": ["ekpo_id", "marc_id"],
    "stg_likp": ["delivery_number"],
    "int_pn_infor": ["marc_id", "available_stock"],
    "mart_shortage_report": ["marc_id"],
    "mart_vendor_performance": ["vendor_number"],
}
ACCEPTED_VALUES = {
    ("stg_marc", "procurement_type"): ["F", "E", "X"],
    ("stg_vbup", "goods_movement_status"): ["A", "B", "C"],
    ("int_inbound_deliveries_asn", "asn_status"): ["future", "overdue", "pending"],
    ("mart_shortage_report", "status"): ["Shortage", "No Shortage"],
}


def model_rules() -> dict[str, list[Rule]]:
    """All 29 model tests by the table they read; rows are named by the table's unique columns."""
    keys = {t: (c,) for t, c in UNIQUE.items()} | {t: tuple(c) for t, c in UNIQUE_COMBINATIONS.items()}
    rules: dict[str, list[Rule]] = {t: [unique_rule(t, *columns)] for t, columns in keys.items()}
    for table, columns in NOT_NULL.items():
        rules[table] += [null_rule(table, c, keys[table]) for c in columns]
    for (table, column), values in ACCEPTED_VALUES.items():
        rules.setdefault(table, []).append(accepted_rule(table, column, values))
    for table, (name, condition) in mart_conditions().items():
        rules[table].append(Rule(name, keys[table], BROKEN, condition))
    return rules


def model_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What breaks any of the model tests, from one pass over each table."""
    return checked(tables, model_rules())


def model_tests(found: DataFrame) -> DataFrame:
    """All 29 model tests as ``(rule, n_violations)``, from what ``model_violations`` found."""
    return counted(found, [r for of_table in model_rules().values() for r in of_table])
