"""Command line: inspect, compare, schema, detectors, config, report. Exit codes: 0, 1 (--fail-on reached), 2 (error)."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dqlens")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("inspect")
    one.add_argument("source")
    two = sub.add_parser("compare")
    two.add_argument("reference")
    two.add_argument("current")
    for x in (one, two):
        x.add_argument("--config")
        x.add_argument("--target")
        x.add_argument("--output", action="append", default=[])
        x.add_argument("--fail-on", choices=("info", "warning", "high", "critical"))
    one.add_argument("--nrows", type=int)
    one.add_argument("--time-column")
    s = sub.add_parser("schema")
    s.add_argument("source")
    s.add_argument("--stream-state", action="store_true", help="one mergeable pass instead of full inference")
    r = sub.add_parser("report")
    r.add_argument("report")
    r.add_argument("--output", required=True)
    sub.add_parser("detectors")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("init", "validate"))
    c.add_argument("path", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    from . import build_config, compare, inspect, inspect_schema, load
    from .config import DETECTORS, Config
    from .findings import SEVERITIES, Report

    a = build_parser().parse_args(argv)
    try:
        if a.command == "detectors":
            print("\n".join(DETECTORS))
        elif a.command == "config":
            if a.action == "init":
                text = json.dumps(dataclasses.asdict(Config()), indent=2)
                print(text) if not a.path else open(a.path, "w").write(text)
            else:
                build_config(a.path)
                print("valid")
        elif a.command == "schema":
            if a.stream_state:
                from .streaming.profile import profile, state

                print(json.dumps([r.asDict() for r in profile(state(load(a.source).df)).collect()], indent=2, default=str))
            else:
                print(json.dumps(inspect_schema(a.source), indent=2))
        elif a.command == "report":
            with open(a.report, encoding="utf-8") as f:
                Report.from_json(f.read()).save(a.output)
        else:
            if a.command == "inspect":
                report = inspect(a.source, config=a.config, target=a.target, time_column=a.time_column, nrows=a.nrows)
            else:
                report = compare(a.reference, a.current, config=a.config, target=a.target)
            for f in report.findings:
                print(f"{f.severity:8} {f.code:32} {', '.join(f.columns)}: {f.observation}")
            for path in a.output:
                report.save(path)
            if a.fail_on and any(f.rank >= SEVERITIES.index(a.fail_on) for f in report.findings):
                return 1
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
