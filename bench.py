"""Headline jobs, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from contract import views as v
from esquina.operators import address, crossing, names, search
from esquina.plans.batch import geocode_table
from esquina.session import local_session
from esquina.sources.tables import street_docs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores)
    streets, crossings = v.streets(spark, sf_dir), v.intersections(spark, sf_dir)
    jobs = {
        "e1_suggest": lambda: names.suggest(v.suggest_requests(spark, sf_dir), streets),
        "e2_search_suggest": lambda: search.search_suggest(v.suggest_requests(spark, sf_dir), street_docs(streets)),
        "e3_geocode_address": lambda: address.geocode_addresses(v.address_requests(spark, sf_dir), streets),
        "e4_geocode_crossing": lambda: crossing.geocode_intersections(
            v.intersection_requests(spark, sf_dir), streets, crossings
        ),
        "e5_batch": lambda: geocode_table(v.address_requests(spark, sf_dir), streets),
    }
    seconds: dict[str, float] = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    requests = {
        "e3_geocode_address": v.address_requests(spark, sf_dir).count(),
        "e4_geocode_crossing": v.intersection_requests(spark, sf_dir).count(),
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "requests_per_sec": {k: round(n / seconds[k], 1) for k, n in requests.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
