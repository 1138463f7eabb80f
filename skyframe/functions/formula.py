"""Scalar functions as SQL expressions, so Catalyst sees all of them and no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class Formula:
    """f('a', 'b') is the Column of the expression over SQL expressions a and b; f.sql('a', 'b') its text.

    In the text `{0}`, `{1}` are the arguments; other formulas are used by their sql().
    """

    def __init__(self, doc: str, text: str):
        self.__doc__, self.text = doc, " ".join(text.split())

    def sql(self, *args: str | float) -> str:
        wrapped = [str(a) if re.fullmatch(r"-?[\w.]+", str(a)) else f"({a})" for a in args]
        return re.sub(r"\{(\d+)\}", lambda m: wrapped[int(m[1])], self.text)

    def __call__(self, *args: str | float) -> Column:
        return F.expr(self.sql(*args))
