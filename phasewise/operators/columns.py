"""Row-local column work: typing, masks, fills, bins, text rules. All plain expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.functions.keyed import uniform
from phasewise.operators.order import quantile_values, running_sums
from phasewise.session import join_small, settle

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Texts read as missing, and logical spellings.
NULL_TOKENS = ("nan", "NaN", "None", "")
TRUE_WORDS = ("TRUE", "true", "T", "True")
FALSE_WORDS = ("FALSE", "false", "F", "False")


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. ``pairs`` lists (surrogate, validated)."""

    key: str
    pairs: tuple[tuple[str, str], ...]
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    weight: str = "W"
    extra: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def phase1(self) -> list[str]:
        return [a for a, _ in self.pairs]

    @property
    def phase2(self) -> list[str]:
        return [b for _, b in self.pairs]

    @property
    def numeric_pairs(self) -> list[tuple[str, str]]:
        return [p for p in self.pairs if p[1] in self.numeric]

    @property
    def categorical_pairs(self) -> list[tuple[str, str]]:
        return [p for p in self.pairs if p[1] in self.categorical]

    def for_design(self, design: str) -> Roles:
        """Roles with the columns a design adds (scores are numeric, strata categorical)."""
        # Columns each design adds.
        added = {
            "RS": (("rs",), ()),
            "WRS": (("wrs",), ()),
            "SFS": (("score",), ()),
            "ODS_TAIL": ((), ()),
            "Neyman_ODS": ((), ("outcome_strata",)),
            "Neyman_INF": (("inf",), ("outcome_strata",)),
            "Neyman_ODS_UNVAL": ((), ("outcome_strata",)),
            "Neyman_INF_UNVAL": (("inf",), ("outcome_strata",)),
            "Balance": ((), ("STRATA",)),
            "Neyman": ((), ("STRATA",)),
        }
        num, cat = added.get(design, ((), ()))
        return Roles(self.key, self.pairs, self.numeric + num, self.categorical + cat, self.weight)

    def exposure_only(self, outcomes: Sequence[str]) -> Roles:
        """Scenario in which the outcome columns are measured without error."""
        pairs = tuple(p for p in self.pairs if p[1] not in outcomes)
        gone = {p[0] for p in self.pairs if p[1] in outcomes}
        return Roles(
            self.key, pairs, tuple(c for c in self.numeric if c not in gone),
            tuple(c for c in self.categorical if c not in gone), self.weight,
        )


def cast_to_template(df: DataFrame, template: T.StructType, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Cast shared columns to the template's types; unknown factor levels become NULL."""
    levels = levels or {}
    wanted = {f.name: f.dataType for f in template.fields}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in levels:
            s = c.cast("string")
            c = F.when(s.isin(*levels[f.name]), s)
        elif f.name in wanted:
            target = wanted[f.name]
            if isinstance(target, T.BooleanType) and isinstance(f.dataType, T.StringType):
                number = c.try_cast("double")
                c = F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False).otherwise(number != 0)
            elif isinstance(target, T.IntegerType) and isinstance(f.dataType, T.StringType):
                c = c.try_cast("double").try_cast("int")
            else:
                c = c.try_cast(target)
        out.append(c.alias(f.name))
    return df.select(*out)


def level_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Distinct non-null levels with 1-based codes in sorted order."""
    levels = df.where(F.col(column).isNotNull()).select(column).distinct()
    table, small = settle(levels)
    if small:
        return table.withColumn(code, F.row_number().over(Window.orderBy(column)).cast("bigint"))
    return running_sums(table.withColumn("_one", F.lit(1)), [column], {code: "_one"}).drop("_one")


def safe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All-or-nothing: numbers if every non-null value parses, else the sorted level's code."""
    bad = df.agg(*[
        F.count(F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(NUMBER), 1)).alias(c) for c in cols
    ]).first()
    for c in cols:
        if bad[c] == 0:
            df = df.withColumn(c, F.col(c).cast("string").try_cast("double"))
        else:
            order = df.columns
            codes = level_codes(df, c, "_code")
            df = join_small(df, codes, [c]).withColumn(c, F.col("_code").cast("double")).select(*order)
    return df


def normalize_category(column: str | Column) -> Column:
    """Trim; integral numbers written as floats lose their ``.0``."""
    s = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.when(s.rlike(r"^\d+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)


def robust_category(column: str | Column) -> Column:
    """Text of a category read as a number where it is an integral one: ``-1.0`` to ``-1``, ``02`` to ``2``, ``1e3`` to ``1000``; else trimmed.

    Null stays null; text that is no finite number, and numbers of 2^53 or more, which doubles do not tell apart, stay text.
    """
    s = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(float(2**53)))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(s)


def null_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in cols})


def mask_phase2(df: DataFrame, cols: Sequence[str], r: str = "R") -> DataFrame:
    """Validated columns are NULL outside the validation sample."""
    return df.withColumns({c: F.when(F.col(r) == 1, F.col(c)) for c in cols})


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def fill_rules(df: DataFrame, rules: Mapping[str, Sequence]) -> DataFrame:
    """``rules[col]`` lists fallbacks in order: Column objects or constants."""
    return df.withColumns({
        c: F.coalesce(F.col(c), *[v if isinstance(v, Column) else F.lit(v) for v in vals])
        for c, vals in rules.items()
    })


def survival_times(df: DataFrame, start: str, onset: str, last: str, death: str | None = None) -> DataFrame:
    """Event flag, time from start to onset or last contact, and a death flag."""
    out = df.withColumn("event", F.col(onset).isNotNull().cast("int")).withColumn(
        "time", F.coalesce(F.col(onset), F.col(last)) - F.col(start)
    )
    return out.withColumn("death", F.col(death).isNotNull().cast("int")) if death else out


@dataclass(frozen=True)
class TextRule:
    """First rule whose ``all_of`` match and whose ``none_of`` do not gives ``label``."""

    label: str
    all_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()


def classify_by_rules(
    text: str | Column, rules: Sequence[TextRule], replacements: Sequence[tuple[str, str]] = (), other: str = "Other"
) -> Column:
    """Ordered case-insensitive text classifier; NULL or blank stays NULL."""
    raw = F.col(text) if isinstance(text, str) else text
    s = raw
    for pattern, new in replacements:
        s = F.regexp_replace(s, f"(?i){pattern}", new)
    out = F.when(raw.isNull() | (F.trim(raw) == ""), F.lit(None).cast("string"))
    for rule in rules:
        hit = F.lit(True)
        for p in rule.all_of:
            hit = hit & s.rlike(f"(?i){p}")
        for p in rule.none_of:
            hit = hit & ~s.rlike(f"(?i){p}")
        out = out.when(hit, rule.label)
    return out.otherwise(other)


def design_columns(df: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """Add named model terms (see ``centred``, ``product``, ``dummies``)."""
    return df.withColumns(dict(terms))


def centred(column: str, centre: float, unit: float = 1.0) -> Column:
    return (F.col(column) - F.lit(float(centre))) / F.lit(float(unit))


def product(a: Column, b: Column) -> Column:
    return a * b


def dummies(column: str, levels: Sequence[str], reference: str) -> dict[str, Column]:
    """0/1 columns for every level but the reference; NULL stays NULL."""
    return {f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in levels if v != reference}


def cut_bins(column: str, breaks: Sequence[float]) -> Column:
    """Right-closed bins 1..k+1 with open ends."""
    c = F.col(column)
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, b in enumerate(breaks):
        out = out.when(c <= F.lit(float(b)), F.lit(i + 1))
    return out.otherwise(F.lit(len(breaks) + 1)).cast("int")


def quantile_bins(df: DataFrame, column: str, probs: Sequence[float] = (0.19, 0.81), name: str = "outcome_strata") -> DataFrame:
    return df.withColumn(name, cut_bins(column, quantile_values(df, column, probs)))


def cross_strata(*cols: str | Column) -> Column:
    """Stratum label; unused combinations never appear because labels come from rows."""
    return F.concat_ws(".", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def residualize_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Validated column becomes surrogate minus validated. Applying it twice restores it."""
    return df.withColumns({p2: F.col(p1) - F.col(p2) for p1, p2 in pairs})


def null_out_of_range(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) <= F.lit(float(v)), F.col(c)) for c, v in limits.items()})


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def split_phases(df: DataFrame, roles: Roles) -> tuple[DataFrame, DataFrame]:
    """(phase-1-only rows, validated rows), by NULL in the first validated column."""
    c = F.col(roles.phase2[0])
    return df.where(c.isNull()), df.where(c.isNotNull())


def draw_in_band(df: DataFrame, code: str, bands: Mapping[str, tuple[float, float]], key: str, seed, name: str) -> DataFrame:
    """Banded code to a uniform value inside its band; unknown code gives NULL."""
    u = uniform(seed, name, key)
    value = None
    for band, (lo, hi) in bands.items():
        hit = F.col(code).cast("string") == band
        v = F.lit(float(lo)) + F.lit(float(hi - lo)) * u
        value = F.when(hit, v) if value is None else value.when(hit, v)
    return df.withColumn(name, value)


def range_midpoint(column: str | Column) -> Column:
    """Midpoint of the first ``low-high`` range in a text."""
    c = F.col(column) if isinstance(column, str) else column
    pattern = r"([0-9]+\.?[0-9]*)\s*-\s*([0-9]+\.?[0-9]*)"
    lo = F.regexp_extract(c, pattern, 1).try_cast("double")
    hi = F.regexp_extract(c, pattern, 2).try_cast("double")
    return (lo + hi) / 2
