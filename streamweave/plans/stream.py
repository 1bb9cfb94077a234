"""The record stream: a DataFrame whose record order is a value.

Order carries meaning in a record stream, and Spark has none; so a stream names hidden columns that give it. Sorting adds
hidden keys, reversing flips their directions; rows only move when an operator or a sink needs them in order.

NULL is an absent field, ``''`` an empty one; typed columns are never empty.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "_o:"


def q(name: str) -> str:
    """A column name that may hold dots or blanks, quoted."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


@dataclasses.dataclass(frozen=True)
class Stream:
    df: DataFrame
    #: Hidden columns and whether they ascend.
    order: tuple[tuple[str, bool], ...] = ()

    # -- making and leaving streams

    @staticmethod
    def of(df: DataFrame, *keys: str) -> Stream:
        """A stream in the order of key columns; without any, in the order in which the rows are scanned."""
        if keys:
            return Stream(df.withColumns({f"{HIDDEN}{k}": col(k) for k in keys}), tuple((f"{HIDDEN}{k}", True) for k in keys))
        return Stream(df.withColumn(f"{HIDDEN}scan", F.monotonically_increasing_id()), ((f"{HIDDEN}scan", True),))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def rows(self) -> DataFrame:
        """The visible columns, in no order."""
        return self.df.select(*map(col, self.columns))

    def sorted(self) -> DataFrame:
        """The visible columns as rows in order."""
        return self.df.orderBy(*self.by()).select(*map(col, self.columns)) if self.order and not self.as_scanned() else self.rows()

    def as_scanned(self) -> bool:
        """Whether the rows still lie as they were scanned, and that is their order: then nothing needs to be sorted."""
        if self.order != ((f"{HIDDEN}scan", True),):
            return False
        plan = self.df._jdf.queryExecution().executedPlan().toString()
        return not re.search(r"Exchange|Join|Sort|Window|Union|Coalesce|Cartesian|LogicalRDD|Scan ExistingRDD", plan)

    # -- order

    def by(self, reverse: bool = False) -> list[Column]:
        return [col(c).asc_nulls_last() if up != reverse else col(c).desc_nulls_first() for c, up in self.order]

    def first_key(self) -> Column:
        """The order as one comparable value; only for orders that all ascend or all descend."""
        return F.struct(*[col(c) for c, _ in self.order])

    @property
    def uniform(self) -> bool:
        return len({up for _, up in self.order}) <= 1

    def window(self, *groups: str, reverse: bool = False):
        w = Window.partitionBy(*map(col, groups)) if groups else Window.partitionBy()
        return w.orderBy(*self.by(reverse)) if self.order else w

    def least(self) -> Callable[[str], Column]:
        """An aggregate of the first position in a group."""
        key = self.first_key()
        return (F.min if not self.order or self.order[0][1] else F.max)(key)

    # -- columns

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def has(self, *names: str) -> bool:
        return set(names) <= set(self.columns)

    def with_df(self, df: DataFrame) -> Stream:
        return dataclasses.replace(self, df=df)

    def select(self, columns: Iterable) -> Stream:
        """New visible columns (names or Columns); the order stays."""
        return self.with_df(self.df.select(*[col(c) if isinstance(c, str) else c for c in columns], *map(col, self.hidden)))

    def with_columns(self, new: dict[str, Column]) -> Stream:
        return self.with_df(self.df.select(
            *[new[c].alias(c) if c in new else col(c) for c in self.columns], *[v.alias(k) for k, v in new.items() if k not in self.columns], *map(col, self.hidden)
        ))

    def where(self, condition: Column) -> Stream:
        return self.with_df(self.df.where(condition))

    def ordered_by(self, keys: list[tuple[Column, bool]], name: str) -> Stream:
        """Sorted by keys first, then as before."""
        taken = {c for c in self.hidden}
        out, order = {}, []
        for i, (k, up) in enumerate(keys):
            n = f"{HIDDEN}{name}{i}"
            while n in taken or n in out:
                n += "'"
            out[n] = k
            order.append((n, up))
        return Stream(self.df.withColumns(out), (*order, *self.order))


# -- values


def is_text(s: Stream, name: str) -> bool:
    return isinstance(s.dtype(name), T.StringType)


def is_number(s: Stream, name: str) -> bool:
    return isinstance(s.dtype(name), T.NumericType)


#: The shapes of numbers in text.
INT_TEXT = r"^[-+]?(?:0|[1-9][0-9]*)$"
HEX_TEXT = r"^[-+]?0[xX][0-9a-fA-F]+$"
BIN_TEXT = r"^[-+]?0[bB][01]+$"
OCT_TEXT = r"^[-+]?0o[0-7]+$"
FLOAT_TEXT = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$|^[-+]?(?i:inf|infinity|nan)$"
LEADING_ZERO = r"^[-+]?0[0-9]+$"


def text_long(c: Column) -> Column:
    """The integer that a text writes, or NULL."""
    sign = F.when(c.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(c, r"^[-+]?0[xXbBo]", "")
    return (
        F.when(c.rlike(INT_TEXT), F.expr("1") * c.try_cast("bigint"))
        .when(c.rlike(HEX_TEXT), sign * F.conv(digits, 16, -10).try_cast("bigint"))
        .when(c.rlike(BIN_TEXT), sign * F.conv(digits, 2, -10).try_cast("bigint"))
        .when(c.rlike(OCT_TEXT), sign * F.conv(digits, 8, -10).try_cast("bigint"))
    )


def text_double(c: Column) -> Column:
    """The number that a text writes, or NULL; leading zeros and overflowing integers make text."""
    low = F.lower(c)
    special = (
        F.when(low.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).when(low.rlike(r"^[-+]?nan$"), F.lit(float("nan")))
    )
    plain = F.when(c.rlike(FLOAT_TEXT) & ~c.rlike(LEADING_ZERO) & ~c.rlike(INT_TEXT) & ~low.rlike("inf|nan"), c.try_cast("double"))
    return F.coalesce(text_long(c).cast("double"), plain, special)


def number(s: Stream, name: str) -> Column:
    """A field as a number: as it is if numeric, parsed if text, else NULL."""
    t = s.dtype(name)
    if isinstance(t, T.NumericType):
        return col(name)
    if isinstance(t, T.StringType):
        return text_double(col(name))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")) / 1e6
    return F.lit(None).cast("double")


def text(c: Column) -> Column:
    return c.cast("string")


def present(s: Stream, name: str) -> Column:
    return col(name).isNotNull()


def nonempty(s: Stream, name: str) -> Column:
    """Present and not empty."""
    c = col(name)
    return c.isNotNull() & (c != "") if is_text(s, name) else c.isNotNull()


def all_present(s: Stream, names: Iterable[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & present(s, n)
    return out


def matcher(pattern: str):
    """A regex given plain, in quotes, or in quotes with a trailing i."""
    flags = 0
    if pattern.startswith('"') and pattern.endswith('"i'):
        pattern, flags = pattern[1:-2], re.IGNORECASE
    elif len(pattern) > 1 and pattern.startswith('"') and pattern.endswith('"'):
        pattern = pattern[1:-1]
    return re.compile(pattern, flags)


def java_regex(pattern: str) -> str:
    m = matcher(pattern)
    return ("(?i)" if m.flags & re.IGNORECASE else "") + m.pattern


def java_replacement(text: str) -> str:
    r"""``\1`` as ``$1``, other signs as they are."""
    return re.sub(r"\\([0-9])", r"$\1", text.replace("$", r"\$"))
