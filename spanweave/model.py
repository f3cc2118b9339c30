"""Which columns of a DataFrame are its intervals, and the rules that all operators share."""

import inspect
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """Column names: a unique ``idx``, group columns ``by`` (none: all rows are one group), ``start``, ``end`` and, where an operator reads it, a boolean ``strand``.

    The columns ``carry``, of types that have an order, stay beside the id in the results, so that rows needn't be joined to them again.
    """

    idx: str = "idx"
    by: tuple[str, ...] = ("grp",)
    start: str = "s"
    end: str = "e"
    strand: str | None = None
    carry: tuple[str, ...] = ()

    def id(self) -> Column:
        """The id, with the carried columns after it in one comparable value."""
        return F.struct(F.col(self.idx).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(self.carry)]) if self.carry else F.col(self.idx)

    def with_carry(self, *names: str) -> "Spec":
        return replace(self, carry=names)

    def with_strand(self, name: str) -> "Spec":
        return replace(self, strand=name)

    def group(self) -> Column:
        """The group as one comparable column."""
        if not self.by:
            return F.lit(0)
        return F.col(self.by[0]) if len(self.by) == 1 else F.struct(*self.by)


SPEC = Spec()


def framed(df: DataFrame, spec: Spec, degenerate: bool = False, **more: Column) -> DataFrame:
    """``df`` as ``i``, ``g``, ``s``, ``e`` and the columns ``more``.

    Rows with a null id, group, start or end are left out, and so are those with ``end <= start``
    unless ``degenerate``: no operator gives them a meaning.
    """
    out = df.select(
        spec.id().alias("i"),
        spec.group().alias("g"),
        F.col(spec.start).cast("long").alias("s"),
        F.col(spec.end).cast("long").alias("e"),
        *[c.alias(k) for k, c in more.items()],
    )
    # Of several group columns none may be null.
    named = [F.col("g")[x].isNotNull() for x in spec.by] if len(spec.by) > 1 else [F.col("g").isNotNull()]
    valid = (F.col("i.id") if spec.carry else F.col("i")).isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()
    for x in named:
        valid = valid & x
    return out.where(valid if degenerate else valid & (F.col("s") < F.col("e")))


def ungrouped(df: DataFrame, spec: Spec, *columns: str) -> DataFrame:
    """``df`` with ``g`` replaced by the group columns, and the other columns as they are."""
    groups = [F.col("g")[x].alias(x) for x in spec.by] if len(spec.by) > 1 else [F.col("g").alias(x) for x in spec.by]
    return df.select(*groups, *columns)


def same_groups(a: Spec, b: Spec) -> None:
    """Raises ValueError unless both sides are grouped, by as many columns, or neither is."""
    if len(a.by) != len(b.by):
        raise ValueError(f"the sides are grouped by {len(a.by)} and {len(b.by)} columns")


def floor_div(x: Column, width: int | Column) -> Column:
    """Exact floor division of longs, negative ones included."""
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    return F.call_function("div", x - F.pmod(x, width), width)


def carrying(operator):
    """An operator whose results have the carried columns of its specs (``spec``, and ``other`` for the right side) after ``idx`` and ``idx2``."""
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(*args, **options):
        given = signature.bind(*args, **options)
        given.apply_defaults()
        out = operator(*args, **options)
        for name, spec in (("idx", given.arguments["spec"]), ("idx2", given.arguments.get("other"))):
            if spec is not None and spec.carry and name in out.columns:
                at = out.columns.index(name)
                value = F.col(name)
                parts = [value["id"].alias(name), *[value[f"c{k}"].alias(c) for k, c in enumerate(spec.carry)]]
                out = out.select(*out.columns[:at], *parts, *out.columns[at + 1 :])
        return out

    return run
