"""Formulas: sums and products of terms and factors, that become columns of a design."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Levels that a factor may be given from a table; each is a column of the design.
MOST_LEVELS = 1000


@dataclass(frozen=True)
class Atom:
    """A variable, a level of a factor, or a named function of columns."""

    name: str
    level: object = None
    #: What makes the column where it isn't the variable itself.
    made: Callable[[], Column] | None = field(default=None, compare=False)

    @property
    def label(self) -> str:
        return self.name if self.level is None else f"{self.name}_{self.level}"

    def column(self) -> Column:
        if self.level is not None:
            return F.when(F.col(self.name).eqNullSafe(F.lit(self.level)), 1.0).otherwise(0.0)
        return self.made() if self.made else F.col(self.name).cast("double")


#: A product of atoms with their powers, or None for a product of different levels of one factor, which is 0 everywhere.
Product = tuple[tuple[Atom, int], ...]


def _times(a: Product, b: Product) -> Product | None:
    powers: dict[Atom, int] = {}
    for atom, n in (*a, *b):
        powers[atom] = 1 if atom.level is not None else powers.get(atom, 0) + n
    levels = [atom.name for atom in powers if atom.level is not None]
    if len(levels) != len(set(levels)):
        return None
    return tuple(sorted(powers.items(), key=lambda x: x[0].label))


@dataclass(frozen=True)
class Contrast:
    """A weighted sum of products: one column."""

    parts: tuple[tuple[float, Product], ...]

    @property
    def label(self) -> str:
        word = lambda p: "*".join(a.label if n == 1 else f"{a.label}**{n}" for a, n in p) or "1"
        return "".join(("-" if w < 0 else "+" if k else "") + ("" if abs(w) == 1 else f"{abs(w):g}*") + word(p) for k, (w, p) in enumerate(self.parts)) or "0"

    def column(self) -> Column:
        one = lambda p: reduce(lambda x, y: x * y, [a.column() for a, n in p for _ in range(n)], F.lit(1.0))
        return reduce(lambda x, y: x + y, [w * one(p) for w, p in self.parts], F.lit(0.0))

    def __mul__(self, other: Contrast) -> Contrast:
        sums: dict[Product, float] = {}
        for v, a in self.parts:
            for w, b in other.parts:
                p = _times(a, b)
                if p is not None:
                    sums[p] = sums.get(p, 0.0) + v * w
        return Contrast(tuple((w, p) for p, w in sums.items() if w))


@dataclass(frozen=True)
class Formula:
    """An ordered list of columns. + joins two, - takes away the columns of the second, * multiplies each by each.

    A product keeps each column once, in the order of the labels; columns that are 0 everywhere, as of two
    levels of one factor, go.
    """

    terms: tuple[Contrast, ...]

    def __add__(self, other: Formula) -> Formula:
        return Formula(self.terms + other.terms)

    def __sub__(self, other: Formula) -> Formula:
        return Formula(tuple(t for t in self.terms if t not in other.terms))

    def __mul__(self, other: Formula) -> Formula:
        made = {t for a in self.terms for b in other.terms if (t := a * b).parts}
        return Formula(tuple(sorted(made, key=lambda t: t.label)))

    def __iter__(self) -> Iterator[Contrast]:
        return iter(self.terms)

    @property
    def names(self) -> list[str]:
        """Labels; a repeated one has its place added."""
        seen: list[str] = []
        for t in self.terms:
            seen.append(t.label if t.label not in seen else f"{t.label}#{len(seen)}")
        return seen

    def columns(self) -> list[Column]:
        return [t.column().alias(name) for t, name in zip(self.terms, self.names)]

    def subs(self, old: str, new: Formula) -> Formula:
        """The variable `old` replaced by the one column of `new`."""
        [put] = new.terms

        def swapped(t: Contrast) -> Contrast:
            out = Contrast(())
            for w, p in t.parts:
                factors = [put if a.name == old and a.level is None else Contrast(((1.0, ((a, 1),)),)) for a, n in p for _ in range(n)]
                made = reduce(lambda x, y: x * y, factors, Contrast(((w, ()),)))
                out = Contrast(out.parts + made.parts)
            return out

        return Formula(tuple(swapped(t) for t in self.terms))


#: The constant.
I = Formula((Contrast(((1.0, ()),)),))  # noqa: E741


def term(name: str, made: Callable[[], Column] | None = None) -> Formula:
    """A numeric variable, or a named function of columns."""
    return Formula((Contrast(((1.0, ((Atom(name, None, made), 1),)),)),))


@dataclass(frozen=True)
class Factor(Formula):
    """The indicators of a variable's levels."""

    name: str = ""
    levels: tuple[object, ...] = ()

    @property
    def main_effect(self) -> Formula:
        """Each level less the last one."""
        last = ((Atom(self.name, self.levels[-1]), 1),)
        return Formula(tuple(Contrast(((1.0, ((Atom(self.name, v), 1),)), (-1.0, last))) for v in self.levels[:-1]))

    def level(self, value: object) -> Formula:
        if value not in self.levels:
            raise ValueError(f"{self.name} has no level {value!r}")
        return Formula((self.terms[self.levels.index(value)],))

    def stratify(self, variable: str) -> Formula:
        """A slope of the variable for each level."""
        return Formula(tuple(t * term(variable).terms[0] for t in self.terms))


def factor(name: str, levels: Sequence[object]) -> Factor:
    if len(set(levels)) != len(levels):
        raise ValueError("levels repeat")
    return Factor(tuple(Contrast(((1.0, ((Atom(name, v), 1),)),)) for v in levels), name, tuple(levels))


def factor_of(df: DataFrame, name: str, most: int = MOST_LEVELS) -> Factor:
    """A factor with the values that the column has, in order; null is no level. More than `most` are refused: each is a column of the design."""
    found = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has more than {most} values")
    return factor(name, sorted(found))


def from_frame(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> Formula:
    """The columns of a table: text and booleans as factors, others as terms."""
    names = [c for c in df.columns if c not in drop and (not keep or c in keep)]
    discrete = lambda c: isinstance(df.schema[c].dataType, (StringType, BooleanType))
    return reduce(lambda a, b: a + b, [factor_of(df, c) if discrete(c) else term(c) for c in names], Formula(()))


def natural_spline(variable: str, knots: Sequence[float], order: int = 3, intercept: bool = False) -> Formula:
    """Powers of a variable up to the order, then truncated powers beyond each knot."""
    x = term(variable)
    out = [reduce(lambda a, b: a * b, [x] * k) for k in range(1, order + 1)]
    beyond = lambda k: lambda: F.when(F.col(variable) > k, F.pow(F.col(variable).cast("double") - k, F.lit(order))).otherwise(0.0)
    out += [term(f"{variable}_{order}_{k:g}", beyond(k)) for k in knots]
    return reduce(lambda a, b: a + b, ([I] if intercept else []) + out)
