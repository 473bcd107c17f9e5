"""Command line: create the result store's tables, or show how.

    python -m tabgauge.sources.migrate PATH [--dry-run]
"""

from __future__ import annotations

import sys

from tabgauge.session import session
from tabgauge.sources.store import JdbcResultStore, ResultStore


def main(args: list[str] | None = None) -> list[str]:
    args = sys.argv[1:] if args is None else args
    dry, paths = "--dry-run" in args, [a for a in args if not a.startswith("--")]
    spark = session("migrate")
    store = ResultStore(spark, paths[0]) if paths else JdbcResultStore.from_env(spark)
    if store is None:
        raise SystemExit("give a folder, or set POSTGRES_PASSWORD")
    done = store.ensure_schema(dry_run=dry)
    print("\n".join(done) or "nothing to do")
    return done


if __name__ == "__main__":
    main()
