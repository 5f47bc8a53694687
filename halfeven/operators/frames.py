"""The dialect's operators on DataFrames: expressions are dialect text, types and rounding are the dialect's.

    Frame(lineitem).where("l_quantity < 24.00").group("l_returnflag", "SUM(l_extendedprice * (1.00 - l_discount)) AS revenue").df

Every step is one lazy DataFrame over the one before; Catalyst sees a plain nested plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.session import Engine


class Frame:
    def __init__(self, df: DataFrame, key: str | None = None):
        self.df, self.key = df, key

    def _run(self, text: str, key: str | None = None, **tables: Frame) -> Frame:
        engine = Engine(self.df.sparkSession)
        for name, frame in {"t": self, **tables}.items():
            engine.register(name, frame.df, frame.key)
        return Frame(engine.session().query(text), key)

    def select(self, *items: str) -> Frame:
        return self._run(f"SELECT {', '.join(items)} FROM t")

    def distinct(self, item: str) -> Frame:
        return self._run(f"SELECT DISTINCT {item} FROM t")

    def where(self, condition: str, **tables: Frame) -> Frame:
        """Rows for which the condition is true; it may hold subqueries over the named tables."""
        return self._run(f"SELECT * FROM t WHERE {condition}", self.key, **tables)

    def aggregate(self, item: str, having: str | None = None) -> Frame:
        return self._run(f"SELECT {item} FROM t" + (f" HAVING {having}" if having else ""))

    def group(self, key: str, item: str, having: str | None = None) -> Frame:
        return self._run(f"SELECT {key}, {item} FROM t GROUP BY {key}" + (f" HAVING {having}" if having else ""))

    def join(self, other: Frame, on: str, items: list[str], how: str = "INNER") -> Frame:
        """Items and condition name the sides `t` and `o`; `how` is INNER or LEFT."""
        return self._run(f"SELECT {', '.join(items)} FROM t {how} JOIN o ON {on}", o=other)

    def order(self, name: str, descending: bool = False, limit: int | None = None) -> Frame:
        """Nulls come first upwards and last downwards; ties follow the key, in the same direction."""
        return self._run(f"SELECT * FROM t ORDER BY {name} {'DESC' if descending else 'ASC'}" + (f" LIMIT {limit}" if limit is not None else ""), self.key)
