"""Which kind each column is, and the typed expression that its statistics are taken of.

The schema decides most columns without a job. Text columns are probed for times, numbers
and truth values, numeric columns for 0/1 and few levels, each in one scan of all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import numbers as N
from plumbline.operators import boolean as B
from plumbline.options import ComputeOptions
from plumbline.plans.together import together

#: The share of texts that must parse, the earliest year, and levels of a categorical number: fixed values.
PARSED, LEAST_YEAR, FEW_LEVELS = 0.8, 1000, 50
#: Texts longer than this are no times.
LONGEST_TIME = 64
#: Texts of digits alone, which a cast would take for years of more than four digits.
_WHOLE_NUMBER = r"^\s*[+-]?\d{5,}\s*$"
#: Texts that are truth values, for columns where these are looked for: fixed values.
TRUTH = ("true", "false", "1", "0", "yes", "no")
#: Formats that texts are tried as, in this order: fixed values.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd")
_BOOLEAN_NAME = re.compile(r"^(is|has|can|should|was|did|flag|enabled|active)(_|$)|(_flag|_ind|_yn|_bool)$", re.I)


@dataclass(frozen=True)
class ColumnPlan:
    """A column's kind, and its values as that kind: a double, text, timestamp or boolean."""

    name: str
    kind: str
    values: Column
    dtype: str
    reclassified: bool = False


def parse_time(text: Column, fmt: str | None = None) -> Column:
    """A text as a timestamp, by one format or by the first that fits; else null."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in ([fmt] if fmt else TIME_FORMATS)]
    return F.coalesce(*tried, *([] if fmt else [F.when(~text.rlike(_WHOLE_NUMBER), text.try_cast("timestamp"))]))


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _by_schema(kind: T.DataType) -> str | None:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.NumericType, T.DayTimeIntervalType)):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "categorical"


def _shape(fmt: str) -> str:
    """What a text of a format looks like: a digit for each letter."""
    return "^" + re.sub(r"[A-Za-z]+|'T'", lambda m: "T" if m[0] == "'T'" else r"\d{%d}" % len(m[0]), fmt) + "$"


def _fits(v: Column, fmt: str | None) -> Column:
    """Whether a text is a time of a format, or of any that a cast knows; only texts that look like one are parsed, and a whole number is none to a cast."""
    looks = (F.length(v) <= LONGEST_TIME) & (v.rlike(r"\d{4}.*\d|\d.*\d{4}") & ~v.rlike(_WHOLE_NUMBER) if fmt is None else v.rlike(_shape(fmt)))
    t = v.try_cast("timestamp") if fmt is None else parse_time(v, fmt)
    return F.coalesce(F.when(looks, t.isNotNull() & (F.year(t) >= LEAST_YEAR)), F.lit(False))


def _probe(df: DataFrame, texts: list[str], strategy: str = "balanced") -> dict[str, str]:
    """Kinds of text columns over all rows.

    Times if more than PARSED of the non-nulls parse by one format, unless the strategy is
    "conservative"; else numbers if more than PARSED of all rows do; else truth values, if
    it is "aggressive" and more than PARSED of all rows are such.
    """
    if not texts:
        return {}
    formats = () if strategy == "conservative" else (*TIME_FORMATS, None)
    asks = []
    for i, c in enumerate(texts):
        v = F.col(f"`{c}`")
        asks += [F.count(F.lit(1)).alias(f"rows{i}"), F.count(v).alias(f"known{i}"), F.count_if(N.looks_numeric(F.trim(v))).alias(f"numbers{i}")]
        asks += [F.count_if(_fits(v, fmt)).alias(f"times{i}_{k}") for k, fmt in enumerate(formats)]
        if strategy == "aggressive":
            asks.append(F.count_if(F.lower(v).isin(*TRUTH)).alias(f"truth{i}"))
    found = df.agg(*asks).first().asDict()

    def kind(i: int) -> str:
        if max((found[f"times{i}_{k}"] for k in range(len(formats))), default=0) > PARSED * found[f"known{i}"]:
            return "datetime"
        if found[f"numbers{i}"] > PARSED * found[f"rows{i}"]:
            return "numeric"
        return "boolean" if found.get(f"truth{i}", 0) > PARSED * found[f"rows{i}"] else "categorical"

    return {c: kind(i) for i, c in enumerate(texts)}


def _few_levels(df: DataFrame, columns: dict[str, Column], options: ComputeOptions, complete: bool) -> dict[str, str]:
    """Numeric columns that are boolean (just 0 and 1, not nearly all 0) or categorical (whole numbers of few levels)."""
    if not columns:
        return {}
    asks = []
    for i, x in enumerate(columns.values()):
        v = N.finite(x)
        asks += [F.count(v).alias(f"n{i}"), F.count_if(v == 0).alias(f"z{i}"), F.count_if(v == 1).alias(f"o{i}"), F.bool_and(N.is_integral(v)).alias(f"w{i}"), F.approx_count_distinct(v, 0.05).alias(f"d{i}")]
    found = df.agg(*asks).first()
    out, maybe = {}, []
    for i, (name, x) in enumerate(columns.items()):
        n, zero, one = found[f"n{i}"], found[f"z{i}"], found[f"o{i}"]
        named = not options.boolean_detection_require_name_pattern or _BOOLEAN_NAME.search(name)
        if options.enable_auto_boolean_detection and n >= options.boolean_detection_min_samples and zero and one and zero + one == n and zero / n <= options.boolean_detection_max_zero_ratio and named:
            out[name] = "boolean"
        elif complete and n and found[f"w{i}"] and found[f"d{i}"] <= 1.3 * FEW_LEVELS:
            maybe.append((name, x))
    if maybe:  # by the sketch they have few levels, so the sets are small
        sizes = df.agg(*[F.size(F.collect_set(N.finite(x) + 0.0)).alias(f"k{i}") for i, (_, x) in enumerate(maybe)]).first()
        out |= {name: "categorical" for i, (name, _) in enumerate(maybe) if sizes[f"k{i}"] <= FEW_LEVELS}
    return out


def classify(df: DataFrame, options: ComputeOptions | None = None, complete: bool = True) -> list[ColumnPlan]:
    """A plan for each column of ``df``. ``complete`` False (a stream) leaves numbers of few levels numeric; a forced kind is final."""
    options = options or ComputeOptions()
    forced = options.force_column_types or {}
    fields = {f.name: f.dataType for f in df.schema.fields}
    kinds = {name: forced.get(name) or _by_schema(kind) for name, kind in fields.items()}
    own = {c: N.as_double(F.col(f"`{c}`"), fields[c]) for c, k in kinds.items() if k == "numeric" and c not in forced and isinstance(fields[c], T.NumericType)}
    probed, again = together(
        df.sparkSession,
        lambda: _probe(df, [c for c, k in kinds.items() if k == "text"], options.inference) if options.infer_strings else {},
        lambda: _few_levels(df, own, options, complete),
    )
    kinds = {c: probed.get(c, "categorical") if k == "text" else k for c, k in kinds.items()}
    numbers = {c: N.as_double(F.col(f"`{c}`"), fields[c]) for c, k in kinds.items() if k == "numeric"}
    plans = []
    for name, kind in fields.items():
        c, final = F.col(f"`{name}`"), again.get(name, kinds[name])
        text = isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
        if final == "numeric":
            values = numbers[name]
        elif final == "boolean":
            values = c if isinstance(kind, T.BooleanType) else B.from_text(c) if text else B.from_number(N.as_double(c, kind))
        elif final == "datetime":
            values = parse_time(c) if text else F.timestamp_seconds(c) if isinstance(kind, T.NumericType) else c.cast("timestamp")
        else:
            values = as_text(c, kind)
        plans.append(ColumnPlan(name, final, values, kind.simpleString(), name in again))
    return plans


def select_columns(df: DataFrame, wanted: list[str] | None) -> DataFrame:
    """The wanted columns in the table's order; unknown names are passed over, and if none is known all columns stay."""
    keep = [c for c in df.columns if c in set(wanted or df.columns)]
    return df.select(*[F.col(f"`{c}`") for c in keep]) if keep else df


def unique_names(names: list[str]) -> list[str]:
    """Names with suffixes _1, _2 … for repeated ones, none of which is taken."""
    taken, out = set(names), []
    for name in names:
        new, k = name, 0
        while new in out or (k and new in taken):
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out
