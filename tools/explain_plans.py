"""Print the physical plan summary of registered queries (no Spark UI).

usage: python tools/explain_plans.py [--sf DIR] [--full] [names...]
Default: the bench's headline queries at sf0.01. Prints the operator tree of
``explain("formatted")``, the number of shuffles and broadcasts, and every
scan's pushed filters and read schema (``--full`` prints everything).
"""

from __future__ import annotations

import argparse
import contextlib
import io
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import bench
    from lotline.plans import registry
    from lotline.session import get_spark

    spark = get_spark("lotline-explain", master="local[8]", shuffle_partitions=8)
    registry.load_all()
    for name in a.names or bench.HEADLINE:
        df = registry.QUERIES[name](spark, a.sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        print(f"===== {name}")
        if a.full:
            print(text)
            continue
        tree = text.split("\n\n")[0]
        print(tree)
        print("  shuffles:", tree.count("Exchange") - tree.count("BroadcastExchange"),
              " broadcasts:", tree.count("BroadcastExchange"))
        for line in text.splitlines():
            if line.startswith(("PushedFilters", "ReadSchema")):
                print("  " + line[:160])


if __name__ == "__main__":
    main()
