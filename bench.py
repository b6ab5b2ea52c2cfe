"""Headline timings: prints one JSON line.

The gazetteer tables are inputs and are written before the clock starts; every query then
computes its own text and resolution layers. Results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.fixtures import Fixtures
from checks.queries import QUERIES
from checks.run import session

HEADLINE = ("b05_language_routing", "c01_alias_lookup", "c24_tag_spans", "i10_text_tables", "c09_nearest_place", "c11_places_within_km",
            "c14_first_polygon", "c21_line_distance", "c13_nearest_same_name", "k04_rebuilt_aliases", "j13_beam_search", "j17_resolved_mentions")
GAZETTEER = ("vocab", "words", "locales", "regions", "groups", "patterns")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    base = Fixtures(spark, sf_dir)
    for name in GAZETTEER:
        getattr(base, name)
    times: dict[str, float] = {}
    for name in HEADLINE:
        fx = Fixtures(spark, sf_dir)
        fx.__dict__.update({n: base.__dict__[n] for n in GAZETTEER})
        start = time.time()
        QUERIES[name](fx).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
