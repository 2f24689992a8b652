"""Functions that say what they take and give, so that a catalog can offer them by type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    """A named function of Columns. takes: semantic types of its arguments; gives: that of its value. Null in any argument
    gives null, whatever `of` would make of it."""

    name: str
    takes: tuple[str, ...]
    gives: str
    of: Callable[..., Column]

    def __call__(self, *arguments: Column) -> Column:
        if len(arguments) != len(self.takes):
            raise TypeError(f"{self.declaration} got {len(arguments)} arguments")
        missing = F.lit(False)
        for a in arguments:
            missing = missing | a.isNull()
        return F.when(~missing, self.of(*arguments))

    @property
    def declaration(self) -> str:
        return f"{self.name}({', '.join(self.takes)}): {self.gives}"
