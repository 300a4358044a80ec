"""Stages from the command line: python -m tabulon all --documents DIR --questions FILE --terms FILE --out DIR"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from tabulon.plans.pipelines import STAGES, Settings, run
from tabulon.session import local_session, ship


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tabulon")
    parser.add_argument("stages", nargs="*", default=["all"], help=f"all, or some of {', '.join(STAGES)}")
    for f in dataclasses.fields(Settings):
        if f.name != "options":
            kind = int if isinstance(f.default, int) else str
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=kind(os.environ.get(f"TABULON_{f.name.upper()}", f.default)))
    given = vars(parser.parse_args(arguments))
    stages = given.pop("stages")
    spark = local_session()
    ship(spark)
    print(json.dumps(run(spark, Settings(**given), *stages), default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
