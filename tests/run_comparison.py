"""Run queries against their SQL: python -m tests.run_comparison [sf] [name...]."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry

from .comparing import TESTDATA, connect, differences
from .session import make_session


def main() -> int:
    scale, names = (sys.argv[1:] or ["0.01"])[0], sys.argv[2:]
    folder = str(TESTDATA / f"sf{scale}")
    spark, connection = make_session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            found = differences(queries[name], sql[name], spark, folder, connection)
        except Exception as error:  # show every failure of a run, not only the first
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n     ")
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
