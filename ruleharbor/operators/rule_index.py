"""Any number of rules of a table checked in one read.

Rules that compare the same cell share one look-up instead of a condition each:

* *Ladders.* Comparisons by one operator (``<``, ``<=``, ``>``, ``>=``; also dates and the bounds of ranges) are sorted
  by their threshold. A cell breaks a prefix of them, whose length is found by a binary search over the
  thresholds (``Bucketizer``). The search runs on doubles, in which neighbouring long or decimal values can
  fall together; thresholds equal to the cell as doubles are therefore compared exactly.
* *Equality.* The values of ``=``, ``!=``, ``IN`` and ``NOT IN`` are the keys of a map, or, if there are many, of a small
  table that is joined to the rows.
* *The rest* (patterns, comparisons of two cells, rules of users) stay conditions. Beyond one pass of them, groups are
  evaluated as lambda functions, so no generated method grows beyond what the JVM compiles.

Work per row grows with the logarithm of the thresholds and with the rules that are broken.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleharbor.functions import values as V
from ruleharbor.functions.expr import let
from ruleharbor.operators.predicates import Rule, Setting, Terms, comparisons, find_field, membership

_EPOCH = datetime(1970, 1, 1)
_WIDE = Context(prec=400)
_RISING = (">", ">=")  # broken by cells above the threshold
MOST_MAPPED = 100  # values of a cell that are looked up in a literal; more are a table
MOST_BROADCAST = 50_000  # values of such a table that is sent to all tasks


@dataclass(frozen=True)
class Step:
    """A threshold: its double, what it sorts by exactly, its literal, and the rule."""

    number: float
    exact: Decimal | datetime | float
    literal: Column
    rule_id: str


@dataclass
class Ladder:
    """The thresholds of one cell and operator, in the order in which cells break them."""

    terms: Terms
    steps: list[Step]

    @property
    def rising(self) -> bool:
        return self.terms.op in _RISING

    @property
    def number(self) -> Column:
        cell, dtype = self.terms.cell, self.terms.dtype
        if self.terms.kind == "number":
            return cell.cast("double") + F.lit(0.0)  # the search puts -0.0 below 0.0
        if isinstance(dtype, T.TimestampType):
            return F.unix_micros(cell).cast("double")
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), cell.cast("timestamp_ntz")).cast("double")


@dataclass
class Values:
    """The values of one cell that equality rules name: by a name of the value its literal and the rules of either kind."""

    cell: Column
    literals: dict[str, Column] = field(default_factory=dict)
    equal: dict[str, list[str]] = field(default_factory=dict)
    unequal: dict[str, list[str]] = field(default_factory=dict)
    negated: list[str] = field(default_factory=list)


@dataclass
class RuleIndex:
    ladders: list[Ladder]
    values: list[Values]
    rest: list[tuple[str, Column]]


def _step(spark: SparkSession, rule_id: str, t: Terms) -> Step | None:
    """The threshold as a value of the cell's own type, rounded so that the comparison keeps its meaning; None if there is none."""
    if t.kind == "moment":
        if isinstance(t.dtype, T.TimestampType):
            # An instant, by the time zone of the session.
            micros = spark.range(1).select(F.unix_micros(t.literal)).first()[0]
        else:
            micros = (t.value - _EPOCH) // timedelta(microseconds=1)
        return Step(float(micros), t.value, t.literal, rule_id)
    number = t.value
    if t.kind != "number" or not number.is_finite():
        return None
    if not isinstance(t.dtype, T.NumericType) or isinstance(t.dtype, (T.FloatType, T.DoubleType)):
        value = float(number) + 0.0
        return Step(value, value, F.lit(value), rule_id) if math.isfinite(value) else None
    places, digits = (t.dtype.scale, t.dtype.precision) if isinstance(t.dtype, T.DecimalType) else (0, 18)
    if number.adjusted() >= digits - places:
        return None
    rounded = number.quantize(Decimal(1).scaleb(-places), ROUND_FLOOR if t.op in (">", "<=") else ROUND_CEILING, _WIDE)
    if rounded.adjusted() >= digits - places and rounded:
        return None
    literal = F.lit(int(rounded)) if places == 0 and V.is_integral(t.dtype) else F.lit(rounded).cast(t.dtype)
    return Step(float(rounded) + 0.0, rounded, literal, rule_id)


def _equality_literal(t: Terms) -> tuple[str, Column] | None:
    """A name and the literal of a value in the cell's own type; None for a value that no cell equals."""
    if t.kind == "number" and isinstance(t.dtype, (T.DecimalType, T.IntegralType)):
        number = t.value
        if not number.is_finite():
            return None
        places, digits = (t.dtype.scale, t.dtype.precision) if isinstance(t.dtype, T.DecimalType) else (0, 19)
        if number.adjusted() >= digits - places or number != (exact := number.quantize(Decimal(1).scaleb(-places), ROUND_FLOOR, _WIDE)):
            return None
        if isinstance(t.dtype, T.DecimalType):
            return str(exact.normalize() + 0), F.lit(exact).cast(t.dtype)
        return (str(int(exact)), F.lit(int(exact)).cast("long")) if -(2**63) <= exact < 2**63 else None
    if t.kind == "number":
        value = float(t.value) + 0.0
        return repr(value), F.lit(value)
    return str(t.value), t.literal


def _equalities(rule: Rule, found: list[Terms] | None, schema: T.StructType, setting: Setting) -> tuple[list[Terms], bool] | None:
    """The values that the rule names and whether it breaks on all others."""
    if found and len(found) == 1 and found[0].op in ("=", "!="):
        return found, found[0].op == "!="
    op = rule.operator.upper().strip()
    if rule.rule_complexity == "simple" and op in ("IN", "NOT IN"):
        items = membership(rule, schema)
        return (items, op == "NOT IN") if items is not None else None
    return None


def build(spark: SparkSession, rules: Iterable[tuple[Rule, Column, Setting]], schema: T.StructType) -> RuleIndex:
    """The index of ``rules`` with their conditions and settings, whose ``prepared`` takes up the readings of text cells."""
    ladders: dict[tuple[str, str], Ladder] = {}
    values: dict[str, Values] = {}
    rest: list[tuple[str, Column]] = []
    for rule, violates, setting in rules:
        found = comparisons(rule, schema, setting)
        same = _equalities(rule, found, schema, setting)
        if same is not None:
            named, negate = same
            target = find_field(schema, rule.target_column)
            name = named[0].name if named else f"number {target.name}"
            cell = named[0].cell if named else F.col("`" + target.name.replace("`", "``") + "`")
            own = values.setdefault(name, Values(_key_cell(named[0]) if named else cell))
            if negate:
                own.negated.append(rule.rule_id)
            for key, literal in dict(filter(None, map(_equality_literal, named))).items():
                own.literals.setdefault(key, literal)
                (own.unequal if negate else own.equal).setdefault(key, []).append(rule.rule_id)
            continue
        steps = [_step(spark, rule.rule_id, t) if t.kind != "text" else None for t in found or ()]
        # A range upside down is broken twice by what lies between its bounds.
        if not steps or None in steps or (len(steps) == 2 and steps[0].exact > steps[1].exact):
            rest.append((rule.rule_id, violates))
            continue
        for t, step in zip(found, steps, strict=True):
            ladders.setdefault((t.name, t.op), Ladder(t, [])).steps.append(step)
    for ladder in ladders.values():
        ladder.steps.sort(key=lambda s: s.exact, reverse=not ladder.rising)
    return RuleIndex(list(ladders.values()), list(values.values()), rest)


def _key_cell(t: Terms) -> Column:
    """The cell in the type of the literals that it is joined with."""
    if t.kind == "number" and V.is_integral(t.dtype):
        return t.cell.cast("long")
    if t.kind == "number" and isinstance(t.dtype, (T.FloatType, T.DoubleType)):
        return t.cell.cast("double")
    return t.cell.cast("timestamp_ntz") if t.kind == "moment" and not isinstance(t.dtype, T.TimestampType) else t.cell


def may_break(index: RuleIndex) -> Column:
    """A condition that holds for every row with a broken rule, to be pushed to the scan. It names all of the rest."""
    parts = [violates for _, violates in index.rest]
    for ladder in index.ladders:
        parts.append(ladder.terms.against(ladder.steps[0].literal))  # the easiest to break
    for own in index.values:
        parts.append(own.cell.isNotNull() if own.negated else own.cell.isin(*own.literals.values()) if own.literals else F.lit(False))
    found = parts[0]
    for p in parts[1:]:
        found = found | p
    return found


def _steps_broken(rows: DataFrame, ladders: Sequence[Ladder]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with what the search needs, and per ladder how many of its steps a row breaks (0 for NULL)."""
    if not ladders:
        return rows, []
    rows = rows.withColumns({f"_number{i}": ladder.number for i, ladder in enumerate(ladders)})
    marks = [sorted({s.number for s in ladder.steps}) for ladder in ladders]
    rows = Bucketizer(
        splitsArray=[[-math.inf, *m, math.inf] for m in marks], handleInvalid="keep",
        inputCols=[f"_number{i}" for i in range(len(ladders))], outputCols=[f"_bucket{i}" for i in range(len(ladders))]).transform(rows)
    broken = []
    for i, (ladder, mark) in enumerate(zip(ladders, marks, strict=True)):
        up_to, steps = [0], ladder.steps if ladder.rising else ladder.steps[::-1]
        for m in mark:
            up_to.append(sum(s.number <= m for s in steps[up_to[-1]:]) + up_to[-1])
        total, below = len(steps), F.array(*[F.lit(n) for n in up_to])
        # NaN has a bucket of its own behind the last and is above all numbers.
        bucket = F.col(f"_bucket{i}").cast("int")
        at = F.when(bucket > len(mark), len(mark)).otherwise(bucket)
        tie = (at > 0) & (F.get(F.array(*[F.lit(m) for m in mark]), at - 1) == F.col(f"_number{i}"))
        reached, before = F.get(below, at), F.when(tie, F.get(below, at - 1)).otherwise(F.get(below, at))
        sure = before if ladder.rising else F.lit(total) - reached
        exact = F.array(*[s.literal for s in ladder.steps])
        ties = F.when(tie, F.size(F.filter(F.slice(exact, sure + 1, reached - before), ladder.terms.against))).otherwise(0)
        broken.append(F.coalesce(sure + ties, F.lit(0)))
    return rows, broken


def _named(rows: DataFrame, values: Sequence[Values]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """``rows`` with what the look-ups need, and per cell the ids of the rules that name its value: those broken, those kept."""
    spark, found = rows.sparkSession, []
    ids = lambda rules: F.array(*[F.lit(r) for r in rules]).cast("array<string>")
    for i, own in enumerate(values):
        entries = {key: F.struct(ids(own.equal.get(key, ())).alias("equal"), ids(own.unequal.get(key, ())).alias("kept")) for key in own.literals}
        if not entries:
            told = F.struct(ids(()).alias("equal"), ids(()).alias("kept"))
        elif len(entries) <= MOST_MAPPED:
            told = F.element_at(F.create_map(*[x for key, e in entries.items() for x in (own.literals[key], e)]), own.cell)
        else:
            table = spark.range(1).select(F.inline(F.array(*[
                F.struct(own.literals[key].alias(f"_value{i}"), e.alias(f"_told{i}")) for key, e in entries.items()])))
            table = F.broadcast(table) if len(entries) <= MOST_BROADCAST else table
            rows = rows.withColumn(f"_key{i}", own.cell).join(table, F.col(f"_key{i}") == F.col(f"_value{i}"), "left")
            told = F.col(f"_told{i}")
        found.append((F.coalesce(told["equal"], ids(())), F.coalesce(told["kept"], ids(()))))
    return rows, found


def _rest(rest: Sequence[tuple[str, Column]], groups: Iterable[Sequence[tuple[str, Column]]]) -> list[Column]:
    """Ids of the broken rules among the rest, an array per group; all groups but the first as lambda functions."""
    def ids(group: Sequence[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(violates, F.lit(rule_id)) for rule_id, violates in group]))

    def apart(group: Sequence[tuple[str, Column]]) -> Column:
        return let(F.lit(0), lambda _: ids(group))

    return [ids(g) if i == 0 else apart(g) for i, g in enumerate(groups)] if rest else []


def _literal_ids(rules: Iterable[str]) -> Column:
    return F.array(*[F.lit(r) for r in rules])


def broken(rows: DataFrame, index: RuleIndex, groups: Iterable[Sequence[tuple[str, Column]]]) -> tuple[DataFrame, Column]:
    """``rows`` with what the look-ups need, and the ids of all rules that a row breaks."""
    rows, steps = _steps_broken(rows, index.ladders)
    rows, same = _named(rows, index.values)
    parts = [F.slice(_literal_ids(s.rule_id for s in ladder.steps), F.lit(1), n) for ladder, n in zip(index.ladders, steps, strict=True)]
    for own, (equal, kept) in zip(index.values, same, strict=True):
        parts.append(equal)
        if own.negated:
            others = F.array_except(_literal_ids(own.negated), kept)
            parts.append(F.when(own.cell.isNotNull(), others).otherwise(F.array().cast("array<string>")))
    return rows, F.concat(*parts, *_rest(index.rest, groups))


def counted(rows: DataFrame, index: RuleIndex, groups: Iterable[Sequence[tuple[str, Column]]], rule_ids: Sequence[str]) -> DataFrame:
    """(rule_id, violation_count) of ``rule_ids``, zeros included.

    A row adds one to the length of its prefix on each ladder, not one to every rule it breaks; a rule's count is the
    sum over the prefixes that reach it. Rules that break on all values but some are counted by the others.
    """
    spark = rows.sparkSession
    rows, steps = _steps_broken(rows, index.ladders)
    rows, same = _named(rows, index.values)
    event = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), n.cast("int").alias("n"))
    one = F.lit(1)
    parts = [F.array(event("ladder", F.lit(i), n)) for i, n in enumerate(steps)]
    for i, (own, (equal, kept)) in enumerate(zip(index.values, same, strict=True)):
        parts.append(F.transform(equal, lambda r: event("rule", r, one)))
        if own.negated:
            parts.append(F.array(event("cell", F.lit(i), own.cell.isNotNull().cast("int"))))
            parts.append(F.transform(kept, lambda r: event("kept", r, one)))
    parts += [F.transform(ids, lambda r: event("rule", r, one)) for ids in _rest(index.rest, groups)]
    totals = rows.select(F.explode(F.filter(F.concat(*parts), lambda e: e["n"] > 0)).alias("e")).groupBy("e.kind", "e.name", "e.n").agg(
        F.count(F.lit(1)).alias("rows"))
    # What each event means for which rule: at most a row per rule and threshold.
    means = [("ladder", str(i), at, s.rule_id, 1) for i, ladder in enumerate(index.ladders) for at, s in enumerate(ladder.steps, 1)]
    means += [("cell", str(i), 1, r, 1) for i, own in enumerate(index.values) for r in own.negated]
    means += [(kind, r, 1, r, sign) for kind, sign in (("rule", 1), ("kept", -1)) for r in rule_ids]
    table = spark.createDataFrame(means, "kind string, name string, least int, rule_id string, sign int")
    met = totals.join(table, ["kind", "name"]).where("n >= least").groupBy("rule_id").agg(F.sum(F.col("rows") * F.col("sign")).alias("n"))
    every = spark.createDataFrame([(r,) for r in rule_ids], "rule_id string")
    return every.join(met, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0).cast("long")).alias("violation_count"))
