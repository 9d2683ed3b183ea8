"""python -m moundworks.cli STEP: the steps of plans/build.py, ``check`` (exit code 1 on an error) and ``ingest``.

Ingesting needs a client that fetches; the command line has none of its own (``ingest`` takes module:function), so that
nothing here opens a connection by itself.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from .plans.build import STEPS, Workspace
from .session import session
from .settings import Settings
from .sources.ingest import Manifest, ingest, refresh, run_failures, run_summary
from .sources.readers import candidate_days


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="moundworks", description=__doc__)
    p.add_argument("step", nargs="+", help=", ".join([*STEPS, "check", "ingest pitches", "ingest refresh", "ingest status"]))
    p.add_argument("--data-root", help="folder of raw, lake and models")
    p.add_argument("--start", type=date.fromisoformat)
    p.add_argument("--end", type=date.fromisoformat)
    p.add_argument("--loader", help="module:function that loads a day and returns its number of rows")
    p.add_argument("--manifest", default="manifest.db")
    return p


def shown(result: object) -> str:
    if isinstance(result, DataFrame):
        return f"{result.count()} rows"
    if isinstance(result, dict):
        return json.dumps({k: f"{v.count()} rows" if isinstance(v, DataFrame) else v for k, v in result.items()}, indent=1, default=str)
    return str(result)


def loader(name: str) -> Callable[[date], int]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, work: Workspace | None = None) -> int:
    args = parser().parse_args(argv)
    step = " ".join(args.step)
    settings = Settings.load(**({"data_root": args.data_root} if args.data_root else {}))
    if step not in STEPS and step != "check" and not step.startswith("ingest "):
        print(f"no step {step!r}")
        return 2
    work = work or Workspace(session("moundworks"), settings)
    if step == "check":
        outcomes, bad = work.check()
        for o in outcomes:
            print(f"{'ok' if o.passed else o.severity}: {o.name}" + "".join(f"\n  {r}" for r in o.samples))
        return int(bad)
    if step in ("ingest pitches", "ingest refresh", "ingest status"):
        manifest = Manifest(args.manifest)
        if step == "ingest status":
            runs = manifest.frame(work.spark)
            print(shown({"summary": [tuple(r) for r in run_summary(runs).collect()], "failures": [tuple(r) for r in run_failures(runs).collect()]}))
            return 0
        if not args.loader:
            print("--loader is needed")
            return 2
        load = loader(args.loader)
        if step == "ingest refresh":
            print(refresh(args.end or date.today(), load, manifest, settings.refresh_days))
        else:
            days = [r.day for r in candidate_days(work.spark, str(args.start), str(args.end or date.today())).collect()]
            print(ingest(days, load, manifest))
        return 0
    if step not in STEPS:
        print(f"no step {step!r}")
        return 2
    print(shown(STEPS[step](work)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
