"""python -m tsumugi versions | build SOURCE OUT [VERSION] | fetch URL OUT VERSION."""

from __future__ import annotations

import argparse
import tempfile
from pathlib import Path

from .schema import FORMAT_VERSION


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tsumugi")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("versions", help="format version, and that of Spark")
    build = commands.add_parser("build", help="source JSON to a folder of tables")
    build.add_argument("source")
    fetch = commands.add_parser("fetch", help="the same from the first JSON file of a .tgz, kept in the cache root")
    fetch.add_argument("source")
    for p, need in ((build, "?"), (fetch, None)):
        p.add_argument("out")
        p.add_argument("version", nargs=need, **({"default": ""} if need else {}))
    chosen = parser.parse_args(args)
    if chosen.command == "versions":
        import pyspark

        print(f"format {FORMAT_VERSION}\nspark {pyspark.__version__}")
        return
    from pyspark.sql import SparkSession

    from .plans.build import build_indexes
    from .sources.install import SourceCache, download, json_in_archive, resolved_cache_dir

    spark = SparkSession.builder.appName("tsumugi").getOrCreate()
    if chosen.command == "build":
        build_indexes(spark, chosen.source, chosen.out, chosen.version)
        return
    cache = SourceCache(resolved_cache_dir() / "tsumugi", "source.json", chosen.version)
    data = cache.load(lambda: json_in_archive(download(chosen.source)))
    with tempfile.TemporaryDirectory() as d:  # read by the driver's own file system: fetch is for a single machine
        path = Path(d) / "source.json"
        path.write_bytes(data)
        build_indexes(spark, str(path), chosen.out, chosen.version)


if __name__ == "__main__":
    main()
