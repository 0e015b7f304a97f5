"""Command line: the audited app's requests, answered by Spark, printed as JSON.

    python -m eventlens data      --paths P... --start 2025-11-01 --end 2025-11-30 [--out DIR | --page 1 --page-size 100]
    python -m eventlens query     --paths P... --start ... --end ... --body '{"filters": {...}, "page": 2}'
                                  [--chart-field username]
    python -m eventlens columns   --paths P... --start ... --end ... [--columns a b]
    python -m eventlens filtered-columns --paths P... --start ... --end ... --body '{...}'
    python -m eventlens download  --paths P... --start ... --end ... --body '{...}' --format csv --out DIR
    python -m eventlens sync      --landing DIR --table DIR --checkpoint DIR

Only bounded results are printed: a total, one page, chart series, facet
lists (<= 1000 values per column). Row-level output goes to files.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date, datetime

from eventlens.dataset import EventSet
from eventlens.functions.time import default_range, iso_string
from eventlens.operators.filters import FilterSpec
from eventlens.plans.request import QueryRequest, run_request
from eventlens.schema import COLUMN_LABELS, TIME_COLUMN
from eventlens.session import build_session
from eventlens.sources.sinks import export_path, write_parquet


def _rows(df) -> list[dict]:
    if TIME_COLUMN in df.columns and dict(df.dtypes)[TIME_COLUMN] == "bigint":
        df = df.withColumn(TIME_COLUMN, iso_string(TIME_COLUMN))
    return [r.asDict(recursive=True) for r in df.collect()]


def _default(v):
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return str(v)


def _events(spark, args) -> EventSet:
    start, end = default_range(date.fromisoformat(args.end) if args.end else None)
    return EventSet.load(spark, args.paths, args.start or start, args.end or end, merge_schema=args.merge_schema)


def _facets_json(values_df, counts_df=None) -> dict:
    out: dict[str, dict] = {}
    for r in values_df.orderBy("column_name", "value_rank").collect():
        out.setdefault(r.column_name, {"values": []})["values"].append(r.value)
    if counts_df is not None:
        for r in counts_df.collect():
            out.setdefault(r.column_name, {"values": []}).update(
                available=r.available_values, total=r.total_values, countLabel=r.count_label
            )
    return out


def cmd_data(spark, args) -> dict:
    ev = _events(spark, args)
    if args.out:  # every row, to files
        return {"path": write_parquet(ev.rows, export_path(args.out, "parquet")), "total": ev.total()}
    page = ev.page(page=args.page, page_size=args.page_size)
    return {"data": _rows(page.rows), "total": page.total, "page": page.page, "pageSize": page.page_size}


def cmd_query(spark, args) -> dict:
    ev = _events(spark, args)
    res = run_request(ev, QueryRequest.from_body(json.loads(args.body or "{}")), chart_field=args.chart_field)
    out = {"data": _rows(res.page.rows), "total": res.page.total, "page": res.page.page,
           "pageSize": res.page.page_size, "start": res.page.start, "end": res.page.end}
    if res.chart is not None:
        out["chart"] = [r.asDict() for r in res.chart.orderBy(*[c for c in ("series_rank", "bucket_ms") if c in res.chart.columns]).collect()]
    return out


def cmd_columns(spark, args) -> dict:
    ev = _events(spark, args)
    columns = [c for c in (args.columns or ev.columns) if c != TIME_COLUMN]
    meta = {m["name"]: m for m in ev.column_metadata()}
    facets = _facets_json(ev.column_values(columns, prelimit=args.prelimit))
    return {
        "columns": {c: {"type": meta[c]["type"], "values": facets.get(c, {}).get("values", [])} for c in columns},
        "columnLabels": COLUMN_LABELS,
    }


def cmd_filtered_columns(spark, args) -> dict:
    ev = _events(spark, args)
    panel = ev.facet_panel(FilterSpec.from_request(json.loads(args.body or "{}")), args.columns, approx=args.approx)
    columns = _facets_json(panel.values, panel.counts)
    types = {m["name"]: m["type"] for m in ev.column_metadata()}
    return {"columns": {c: {"type": types[c], **found} for c, found in columns.items()}}


def cmd_download(spark, args) -> dict:
    ev = _events(spark, args)
    spec = FilterSpec.from_request(json.loads(args.body or "{}"))
    path = export_path(args.out, args.format)
    write = ev.export_csv if args.format == "csv" else ev.export_parquet
    return {"path": write(spec, path, single_file=args.single_file)}


def cmd_sync(spark, args) -> dict:
    from eventlens.streaming.refresh import landing_schema, refresh

    schema = landing_schema(spark, args.landing, args.recursive)
    return refresh(spark, args.landing, args.table, args.checkpoint, schema, recursive=args.recursive).as_dict()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="eventlens", description=__doc__.splitlines()[0])
    parser.add_argument("--master", default=None, help="Spark master (default: from spark-submit / local[*])")
    sub = parser.add_subparsers(dest="command", required=True)

    def ranged(name):
        p = sub.add_parser(name)
        p.add_argument("--paths", nargs="+", required=True)
        p.add_argument("--start", default=None, help="ISO date (default: 7 days before --end)")
        p.add_argument("--end", default=None, help="ISO date (default: today, UTC)")
        p.add_argument("--merge-schema", action="store_true")
        return p

    rows = ranged("data")
    rows.add_argument("--out", default=None, help="folder for all rows; without it one sorted page is printed")
    rows.add_argument("--page", type=int, default=1)
    rows.add_argument("--page-size", type=int, default=None)
    q = ranged("query")
    q.add_argument("--body", default="{}")
    q.add_argument("--chart-field", default=None)
    c = ranged("columns")
    c.add_argument("--columns", nargs="*")
    c.add_argument("--prelimit", action="store_true", help="per-task cut before the shuffle (unique-id columns)")
    f = ranged("filtered-columns")
    f.add_argument("--body", default="{}")
    f.add_argument("--columns", nargs="*")
    f.add_argument("--approx", action="store_true", help="exact values via the per-task cut, estimated counts")
    d = ranged("download")
    d.add_argument("--body", default="{}")
    d.add_argument("--format", choices=["csv", "parquet"], default="csv")
    d.add_argument("--out", required=True)
    d.add_argument("--single-file", action="store_true")
    s = sub.add_parser("sync")
    s.add_argument("--landing", required=True)
    s.add_argument("--table", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--recursive", action="store_true")

    args = parser.parse_args(argv)
    spark = build_session(master=args.master)
    handler = {
        "data": cmd_data,
        "query": cmd_query,
        "columns": cmd_columns,
        "filtered-columns": cmd_filtered_columns,
        "download": cmd_download,
        "sync": cmd_sync,
    }[args.command]
    try:
        json.dump(handler(spark, args), sys.stdout, default=_default)
        sys.stdout.write("\n")
    except ValueError as exc:
        json.dump({"error": str(exc)}, sys.stdout)
        sys.stdout.write("\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
