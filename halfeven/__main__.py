"""Runs a script from standard input: rows as tab-separated text and their number, up to the first error."""

from __future__ import annotations

import sys

from .errors import EngineError
from .plans.parser import Parser
from .plans.session import Engine, Session
from .sources.tables import KEYS, read


def statements(text: str) -> list[str]:
    """Cuts at semicolons outside quotes."""
    out, quoted, begin = [], False, 0
    for k, c in enumerate(text):
        quoted ^= c == "'"
        if c == ";" and not quoted:
            out.append(text[begin:k])
            begin = k + 1
    return [s for s in [*out, text[begin:]] if s.strip()]


def run(session: Session, text: str, out=sys.stdout) -> bool:
    for statement in statements(text):
        try:
            if Parser(statement).peek()[1] in ("select", "show", "explain", "analyze"):
                n = 0
                for row in session.stream(statement):
                    print("\t".join("NULL" if v is None else str(v) for v in row), file=out)
                    n += 1
                print(f"ROWS {n}", file=out)
            else:
                changed = session.execute(statement)
                print("OK" if changed is None else f"OK {changed}", file=out)
        except EngineError as e:
            print(f"ERROR {e}", file=out)
            return False
    return True


def main() -> int:
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.getOrCreate())
    for folder in sys.argv[1:]:  # folders of Parquet tables to read
        for name, key in KEYS.items():
            engine.register(name, read(engine.spark, folder, name), key)
    return 0 if run(engine.session(), sys.stdin.read()) else 1


if __name__ == "__main__":
    sys.exit(main())
