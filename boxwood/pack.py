"""python -m boxwood.pack [MESH.obj]... > MESH.blob: packs OBJ meshes, or the one on standard input, with their corners.

Standard input and the packed mesh pass through the folder of spark.checkpoint.dir, which executors share.
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from boxwood.sources import meshes
from boxwood.sources.ranges import local
from boxwood.storage import shared_dir


def main(args: list[str]) -> int:
    if "-h" in args:
        print(__doc__)
        return 0
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    with tempfile.TemporaryDirectory(dir=local(shared_dir(spark))) as folder:
        if not args:
            args = [os.path.join(folder, "in.obj")]
            with open(args[0], "wb") as f:
                shutil.copyfileobj(sys.stdin.buffer, f)
        out = os.path.join(folder, "out.blob")
        meshes.write_blob(meshes.read_obj_triangles(spark, args), out)
        with open(out, "rb") as f:
            shutil.copyfileobj(f, sys.stdout.buffer)
    sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
