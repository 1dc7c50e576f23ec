"""python -m boxwood.cli [options] MESH...: builds a tree over meshes (.obj, .obj.bz2, .blob, .parquet) and writes it.

-h: this help. -n N: threads. -m D: depth, 8 unless set. -o: the tree as text
on standard output. --to: packed binary, to kdtree.binary. --graphviz, --graphvizAccm: to
output.dot (Accm: counts summed along paths). --csv: stamps (microseconds) to standard
error; --csv-header: the names of their columns, and nothing else. -v: each split. -q: no report. --rdtsc is taken as --seconds:
microseconds in either case. --superfluous-prescans has no effect. --builder NAME: hybrid,
levels or tasks. --costs STEP,BOX,BONUS: 15,20,0 unless set. An unknown option is reported and passed over.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from boxwood.functions.sah import Costs
from boxwood.plans.tree import BUILDERS, build
from boxwood.schema import DEPTH
from boxwood.sources import meshes, sinks
from boxwood.storage import released, written
from boxwood.timings import csv_header

_FLAGS = {"-h", "-o", "-v", "-q", "--csv", "--csv-header", "--to", "--graphviz", "--graphvizAccm", "--seconds", "--rdtsc", "--superfluous-prescans"}
_VALUES = {"-n", "-m", "--builder", "--costs"}


def parse(args: list[str]) -> tuple[set[str], dict[str, str], list[str], list[str]]:
    """(flags, values, paths, unknown options)"""
    flags, values, paths, unknown = set(), {}, [], []
    rest = iter(args)
    for x in rest:
        if x in _VALUES:
            if (value := next(rest, None)) is None:
                raise SystemExit(f"{x} needs a value")
            values[x] = value
        elif x in _FLAGS:
            flags.add(x)
        elif x.startswith("-"):
            unknown.append(x)
        else:
            paths.append(x)
    for name in ("-n", "-m"):
        if name in values and (not values[name].isdigit() or int(values[name]) < 1):
            raise SystemExit(f"{name} takes a whole number from 1")
    if values.get("--builder", "hybrid") not in BUILDERS:
        raise SystemExit(f"--builder is one of {', '.join(BUILDERS)}")
    costs_of(values)
    return flags, values, paths, unknown


def costs_of(values: dict[str, str]) -> Costs:
    if "--costs" not in values:
        return Costs()
    try:
        step, box, bonus = map(float, values["--costs"].split(","))
    except ValueError:
        raise SystemExit("--costs takes three numbers: step,box,bonus") from None
    return Costs(step, box, bonus)


def main(args: list[str]) -> int:
    flags, values, paths, unknown = parse(args)
    for x in unknown:
        print(f"unknown option {x}", file=sys.stderr)
    depth = int(values.get("-m", DEPTH))
    if "--csv-header" in flags and "-h" not in flags:
        print(csv_header(depth), file=sys.stderr)
        return 0
    if "-h" in flags or not paths:
        print(__doc__)
        return 0 if "-h" in flags else 1
    now = lambda: time.perf_counter_ns() // 1000
    began = now()
    spark = SparkSession.builder.master(f"local[{values.get('-n', 1)}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    boxes = written(meshes.load(spark, paths))  # Spark reads when something asks: here, so that the stamp tells when the meshes are loaded
    loaded = now()
    tree = build(boxes, max_depth=depth, costs=costs_of(values), builder=values.get("--builder", "hybrid"), superfluous_prescans="--superfluous-prescans" in flags)
    built = now()
    if "-o" in flags:
        for r in sinks.tree_text(tree).orderBy("ord").toLocalIterator():
            print(r["line"])
    if "--to" in flags:
        sinks.write_manta(tree, "kdtree.binary")
    if flags & {"--graphviz", "--graphvizAccm"}:
        sinks.write_graphviz(tree, "output.dot", "--graphvizAccm" in flags)
    if "-v" in flags:
        for r in sinks.split_trace(tree).orderBy("level", "node").toLocalIterator():
            print(f"{r['level']} [@ {r['t']} {r['axis']} {r['edge']} {r['tri']}: {r['na']}:{r['nb']} = {r['sah']}", file=sys.stderr)
    if "--csv" in flags:
        print(tree.timings.csv_row(depth, int(values.get("-n", 1)), began, loaded, loaded, built), file=sys.stderr)
    if not flags & {"-q", "--csv"}:
        for r in tree.timings.report().collect():
            print(f"{r['phase']}: {r['times']} x {r['mean_us']:.0f} us", file=sys.stderr)
    released(boxes)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
