"""Command line: python -m gridloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from gridloom.plans import commands
from gridloom.plans.config import cast_option
from gridloom.sources.paths import Location


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom", description="Tiled raster and vector processing on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *places: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for place in places:
            p.add_argument(place)
        return p

    def area(p: argparse.ArgumentParser) -> None:
        p.add_argument("--zoom", type=lambda s: [int(x) for x in s.split(",")])
        p.add_argument("--bounds", type=lambda s: [float(x) for x in s.split(",")])

    p = add("execute", "run a process", "config")
    area(p)
    p.add_argument("--mode", choices=["continue", "overwrite"], default="continue")
    p.add_argument("--tile", type=lambda s: tuple(int(x) for x in s.split(",")))
    p.add_argument("--retries", type=int, default=0)
    p = add("convert", "convert a raster or vector", "source", "target")
    area(p)
    p.add_argument("--pyramid", default="geodetic")
    p.add_argument("--format", dest="output_format")
    p.add_argument("--ratio", type=float, default=1.0)
    p.add_argument("--offset", type=float, default=0.0)
    p.add_argument("--dtype")
    p.add_argument("--method", default="nearest")
    p = add("cp", "copy tiles", "source", "target")
    area(p)
    p.add_argument("--overwrite", action="store_true")
    area(add("rm", "remove tiles", "path"))
    p = add("index", "index a tile directory", "path", "out")
    p.add_argument("--kind", choices=["GeoJSON", "TXT", "VRT"], default="GeoJSON")
    p.add_argument("--zoom", type=int)
    p = add("sync", "copy files that a folder lacks or has otherwise", "source", "target")
    p.add_argument("--compare", choices=["length", "sha256"], default="length")
    p = add("serve", "serve a process's tiles over HTTP", "config")
    p.add_argument("--port", type=int, default=5000)
    p.add_argument("--mode", choices=["memory", "readonly", "continue", "overwrite"], default="continue")
    add("create", "start a new process", "folder")
    add("formats", "list formats")
    add("processes", "list built-in processes")
    add("stac", "write a STAC item", "path")
    for name in ("exists", "ls", "read_text", "read_json", "read_yaml", "size"):
        add(name, f"{name.replace('_', ' ')} of a path", "path")
    add("option", "show how a value is read", "value")
    return top


def main(args: list[str] | None = None) -> int:
    a = vars(parser().parse_args(args))
    name = a.pop("command")
    if name == "formats":
        print(json.dumps(commands.available_formats(), indent=2))
        return 0
    if name == "processes":
        print(json.dumps(commands.processes(), indent=2))
        return 0
    if name == "option":
        print(repr(cast_option(a["value"])))
        return 0
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if name in ("exists", "ls", "read_text", "read_json", "read_yaml", "size"):
        at = Location(a["path"], spark)
        found = getattr(at, name)()
        print("\n".join(map(str, found)) if name == "ls" else found)
        return 0 if found is not False else 1
    if name == "stac":
        from gridloom.plans.engine import open_process

        print(json.dumps(open_process(spark, a["path"], "readonly").write_stac(), indent=2))
        return 0
    if name == "create":
        commands.create(a["folder"])
        return 0
    found = getattr(commands, name)(spark, **a)
    if isinstance(found, int):
        print(f"{found} {'files' if name == 'sync' else 'tiles'}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
