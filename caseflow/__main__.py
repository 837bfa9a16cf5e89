"""``python -m caseflow ingest|report``: exit 0 when done, 1 on failure, 2 on an alert that was asked to fail."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from caseflow.operators.cleaning import analytic_view
from caseflow.operators.drift import SchemaDriftError
from caseflow.operators.filters import Analysis, AnalyticFilters, InvalidFilterError
from caseflow.operators.reliability import previous_run
from caseflow.plans import report as R
from caseflow.plans.ingest import ingest
from caseflow.session import session
from caseflow.sources.readers import read_capacity, read_history, read_population, read_processed, read_vaccination


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="caseflow")
    p.add_argument("--today", type=datetime.date.fromisoformat, default=datetime.date.today())
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("files", nargs="+")
    i.add_argument("--out", required=True)
    i.add_argument("--baseline", required=True)
    i.add_argument("--accept-drift", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("cases")
    r.add_argument("--out", required=True)
    r.add_argument("--uf")
    r.add_argument("--classification", type=int)
    r.add_argument("--population", default="/nonexistent")
    r.add_argument("--capacity", default="/nonexistent")
    r.add_argument("--vaccination", default="/nonexistent")
    r.add_argument("--fail-on-alert", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    try:
        if args.command == "ingest":
            done = ingest(spark, args.files, args.out, args.baseline, args.today, args.accept_drift)
            print(f"{sum(r['rows_kept'] for r in done['reports'].values())} rows, {len(done['findings'])} findings")
            return 0
        references = {"population": read_population(spark, args.population), "capacity": read_capacity(spark, args.capacity), "vaccination": read_vaccination(spark, args.vaccination)}
        a = Analysis(analytic_view(read_processed(spark, args.cases)), args.today, filters=AnalyticFilters(args.uf, args.classification), references=references)
        history = os.path.join(args.out, "history.jsonl")
        previous = previous_run(read_history(spark, history), a.filters.uf, a.filters.classification) if os.path.exists(history) else None
        built = R.build(a, previous=previous)
        print(R.write(built, args.out)["md"])
        return 2 if args.fail_on_alert and built["alerts"]["disparados"] else 0
    except (SchemaDriftError, InvalidFilterError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
