"""``python -m wardline check PATH KEY``: the contract of a landed folder of JSON rows, as JSON; exit 0 if it holds, 1 if
not, 2 on any error. ``python -m wardline land INCOMING OUT``: lands what has arrived, once. ``python -m wardline ingest STORE
CLIENT VERSION``: executes the store's active run, or a new one, against a source; CLIENT and VERSION are ``module:function``,
of which the first makes a client and the second gives the source's version; exit 0 if the run is published, 1 if it
ended otherwise, 3 if another executor has it."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wardline.functions import json_fields as jf
from wardline.operators import audit
from wardline.plans import control
from wardline.plans.ingest import Ingestion, paged_source
from wardline.sources import landing
from wardline.streaming import landing_stream


def ingest(spark: SparkSession, folder: str, client: str, version: str) -> int:
    module, _, function = version.partition(":")
    clock = lambda: dt.datetime.now(dt.timezone.utc)
    engine = Ingestion(control.Store(spark, folder), paged_source(client, getattr(importlib.import_module(module), function)), clock)
    try:
        run = engine.execute(engine.store.active() or engine.store.create(clock()))
    except control.StateConflict as e:
        print(json.dumps({"status": str(e)}))
        return 3
    print(json.dumps({"run": run.run_id, "status": run.status, "failure": run.failure, "attempts": run.attempts} | run.expected))
    return 0 if run.status == control.COMPLETED else 1


def main(args: list[str]) -> int:
    if len(args) != {"check": 3, "land": 3, "ingest": 4}.get(args[0] if args else "", 0):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        spark = SparkSession.builder.appName("wardline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args[0] == "ingest":
            return ingest(spark, *args[1:])
        if args[0] == "land":
            print(json.dumps({"batches": landing_stream.land(spark, args[1], args[2])}))
            return 0
        rows = landing.read(spark, args[1]).select(jf.required_text(jf.fields(F.col("payload")), args[2]).alias("key"))
        verdict = audit.contract_verdict(rows, "key").collect()[0]
        print(json.dumps(verdict.asDict()))
        return 0 if verdict.holds else 1
    except Exception as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)[:500]}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
