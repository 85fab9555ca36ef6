"""Runs programs: ``python -m rulespan [--naive] [--trace] [--stats] [file ...]``; without files, lines from the terminal."""

from __future__ import annotations

import argparse
import sys

from .operators.program import Program
from .plans.parser import ProgramError
from .session import local_session


def balanced(text: str) -> bool:
    """Whether all parentheses outside strings and comments are closed."""
    from .plans.parser import TOKEN

    depth = at = 0
    while at < len(text) and (m := TOKEN.match(text, at)):
        depth += bool(m["open"]) - bool(m["close"])
        at = m.end()
    return depth <= 0 and at == len(text)


def loop(program: Program, lines, out) -> None:
    """Reads commands, each as soon as it is closed; errors are shown and the loop goes on."""
    held = ""
    for line in lines:
        held += line
        if not held.strip() or not balanced(held):
            continue
        try:
            for text in program.run(held):
                print(text, file=out, flush=True)
        except ProgramError as e:
            print(f"error: {e}", file=out, flush=True)
        held = ""


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rulespan", description=__doc__)
    p.add_argument("files", nargs="*")
    p.add_argument("--naive", action="store_true", help="join all rows in every step")
    p.add_argument("--trace", action="store_true", help="keep what rules did, for prove")
    p.add_argument("--stats", action="store_true", help="count matches and print them at the end")
    p.add_argument("--cores", default="*")
    o = p.parse_args(args)
    spark = local_session("rulespan", o.cores)
    spark.sparkContext.setLogLevel("ERROR")
    program = Program(spark, naive=o.naive, trace=o.trace, stats=o.stats)
    if not o.files:
        loop(program, sys.stdin, sys.stdout)
    for path in o.files:
        with open(path, encoding="utf-8") as f:
            try:
                for text in program.run(f.read()):
                    print(text)
            except ProgramError as e:
                print(f"{path}: {e}", file=sys.stderr)
                return 1
    if o.stats:
        print("\n".join(program.stats_lines()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
