"""``python -m skein``: lists the registered queries, or shows the rows of one over a folder of tables."""

from __future__ import annotations

import argparse

from skein.plans import catalog
from skein.session import build_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("query", nargs="?", choices=sorted(catalog.queries()), metavar="query")
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--rows", type=int, default=20)
    asked = parser.parse_args(arguments)
    if asked.query is None:
        print("\n".join(sorted(catalog.queries())))
        return
    catalog.queries()[asked.query](build_session(), asked.folder).show(asked.rows, truncate=False)


if __name__ == "__main__":
    main()
