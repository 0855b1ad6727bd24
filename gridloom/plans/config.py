"""Configuration of a process: parsing, checks, and what holds at each zoom."""

from __future__ import annotations

import enum
import hashlib
import json
import os
import re
import warnings
from dataclasses import dataclass, field
from typing import Any

import yaml

from gridloom.functions import geometry as G
from gridloom.functions.bounds import Bounds, clip
from gridloom.functions.pyramid import Pyramid
from gridloom.functions.zooms import ZoomLevels
from gridloom.operators.process import BUILT_IN, check_parameters, load_function
from gridloom.sources.paths import expand_env


class ConfigError(ValueError):
    """A configuration that can't be used."""


class Mode(enum.Enum):
    MEMORY = "memory"
    READONLY = "readonly"
    CONTINUE = "continue"
    OVERWRITE = "overwrite"


#: Keys of a configuration; others are parameters of the process.
KEYS = {"pyramid", "output", "zoom_levels", "process", "baselevels", "input", "config_dir", "area", "area_crs", "bounds", "bounds_crs", "process_parameters"}
#: Keys of older configurations and where they went.
MOVED = {"process_file": "process", "process_zoom": "zoom_levels", "process_zooms": "zoom_levels", "process_bounds": "bounds", "input_files": "input"}
#: Resampling below and above the base levels.
LOWER = ("nearest", "first", "last", "mode", "average", "bilinear", "cubic", "min", "max", "sum", "med", "q1", "q3", "rms")
HIGHER = ("nearest", "first", "last", "mode", "average", "bilinear", "cubic", "min", "max", "med", "q1", "q3")
_ZOOM = re.compile(r"^\s*zoom\s*(<=|>=|=|<|>)\s*(\d+)\s*$")


@dataclass(frozen=True)
class ProcessConfig:
    """A parsed configuration."""

    pyramid: Pyramid
    output: dict[str, Any]
    zoom_levels: ZoomLevels
    process: Any = None
    input: dict[str, Any] = field(default_factory=dict)
    baselevels: dict[str, Any] | None = None
    area: dict | None = None
    bounds: Bounds | None = None
    process_parameters: dict[str, Any] = field(default_factory=dict)
    config_dir: str | None = None
    raw: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def parse(cls, source: dict | str, env: dict[str, str] | None = None) -> ProcessConfig:
        """From a mapping, or a YAML file."""
        raw, folder = raw_config(source, env)
        for old, new in MOVED.items():
            if old in raw:
                warnings.warn(f"{old} is now called {new}", DeprecationWarning, stacklevel=2)
                raw[new] = raw.pop(old)
        for need in ("pyramid", "output", "zoom_levels"):
            if need not in raw:
                raise ConfigError(f"the configuration lacks {need}")
        extra = {k: v for k, v in raw.items() if k not in KEYS}
        if extra:
            warnings.warn(f"taken as process parameters: {', '.join(sorted(extra))}", stacklevel=2)
        params = {**(raw.get("process_parameters") or {}), **extra}
        try:
            pyramid, zooms = Pyramid.of(raw["pyramid"]), ZoomLevels.of(raw["zoom_levels"])
            bounds = Bounds.of(raw["bounds"]) if raw.get("bounds") is not None else None
            area = area_of(raw["area"], folder) if raw.get("area") is not None else None
        except (KeyError, TypeError, ValueError) as e:
            raise ConfigError(str(e)) from e
        output = dict(raw["output"])
        if "format" not in output or "path" not in output:
            raise ConfigError("the output needs format and path")
        return cls(pyramid, output, zooms, raw.get("process"), dict(raw.get("input") or {}), checked_baselevels(raw.get("baselevels"), zooms), area, bounds, params, raw.get("config_dir", folder), raw)

    @property
    def output_pyramid(self) -> Pyramid:
        """The output's own metatiling and buffer over the process's grid; 0 buffer unless it is given."""
        o = self.output
        found = Pyramid(self.pyramid.grid, int(o.get("tile_size", self.pyramid.tile_size)), int(o.get("metatiling", self.pyramid.metatiling)), int(o.get("pixelbuffer", 0)))
        if found.metatiling > self.pyramid.metatiling:
            raise ConfigError("output metatiles must not be larger than process metatiles")
        return found

    @property
    def function(self):
        if self.process is None:
            raise ConfigError("the configuration has no process")
        source = self.process
        if isinstance(source, str) and source in BUILT_IN:
            return BUILT_IN[source]
        if isinstance(source, str) and source.endswith(".py") and not os.path.isabs(source) and self.config_dir:
            source = os.path.join(self.config_dir, source)
        return load_function(source)

    def effective_bounds(self) -> Bounds:
        """The configured bounds within the pyramid's, or those; the buffer may reach over a global grid's sides."""
        total = self.pyramid.grid.bounds
        return clip(self.bounds, total) if self.bounds else total

    def effective_area(self) -> Bounds | None:
        """The box of the area within the bounds; None if they don't meet."""
        found = self.effective_bounds()
        if self.area:
            xs, ys = zip(*[(p["x"], p["y"]) for r in self.area["rings"] for p in r])
            found = found.intersection(Bounds(min(xs), min(ys), max(xs), max(ys)))
        return found

    def input_at(self, zoom: int) -> dict[str, Any]:
        """Flat name -> source of the inputs at a zoom, groups joined by slashes."""
        return flattened(at_zoom(self.input, zoom))

    def params_at(self, zoom: int) -> dict[str, Any]:
        return {k: v for k, v in (at_zoom(self.process_parameters, zoom) or {}).items()}

    def processing_levels(self) -> ZoomLevels:
        """Zooms that the function runs at; the others are resampled from these."""
        if not self.baselevels:
            return self.zoom_levels
        low, high = self.baselevels["min"], self.baselevels["max"]
        return ZoomLevels(tuple(z for z in self.zoom_levels if low <= z <= high))

    def overview_levels(self) -> ZoomLevels:
        return self.zoom_levels.difference(self.processing_levels())

    def check(self) -> None:
        """That the function's parameters and inputs fit at every zoom."""
        for zoom in self.processing_levels():
            if getattr(self.function, "plan", False):
                continue
            check_parameters(self.function, [*{k.split("/")[0] for k in self.input_at(zoom)}, *self.params_at(zoom)])

    def raw_at(self, zoom: int) -> dict[str, Any]:
        return {**self.raw, "input": at_zoom(self.input, zoom), "process_parameters": self.params_at(zoom)}


def raw_config(source: dict | str, env: dict[str, str] | None = None) -> tuple[dict, str | None]:
    env = dict(os.environ) if env is None else env
    folder = None
    if isinstance(source, str):
        folder = os.path.dirname(os.path.abspath(source))
        with open(source) as f:
            source = yaml.safe_load(f)
    if not isinstance(source, dict):
        raise ConfigError("a configuration is a mapping or a YAML file's path")
    return resolved_env(source, env), folder


def resolved_env(value, env: dict[str, str]):
    if isinstance(value, dict):
        return {k: resolved_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved_env(v, env) for v in value]
    return expand_env(value, env) if isinstance(value, str) else value


def checked_baselevels(value: dict | None, zooms: ZoomLevels) -> dict | None:
    """min and max default to the zooms' own; lower and higher are resampling names, of those that are there."""
    if value is None:
        return None
    out = {"min": int(value.get("min", zooms.min)), "max": int(value.get("max", zooms.max)), "lower": value.get("lower", "nearest"), "higher": value.get("higher", "nearest")}
    if out["min"] > out["max"]:
        raise ConfigError("baselevels: min must not exceed max")
    for side, names in (("lower", LOWER), ("higher", HIGHER)):
        if out[side] not in names:
            raise ConfigError(f"baselevels: {side} can't be {out[side]!r}, only {', '.join(names)}")
    if out["min"] <= zooms.min and out["max"] >= zooms.max:
        raise ConfigError("baselevels must leave some zoom levels to resample")
    return out


def zoom_condition(text: str, zoom: int) -> bool | None:
    """Whether a condition like ``zoom<=5`` holds; None if the text isn't one."""
    m = _ZOOM.match(text)
    if not m:
        return None
    n = int(m[2])
    return {"=": zoom == n, "<": zoom < n, "<=": zoom <= n, ">": zoom > n, ">=": zoom >= n}[m[1]]


def at_zoom(value, zoom: int):
    """``value`` with mappings of conditions resolved; what has no condition that holds is None and is left out of its mapping."""
    if not isinstance(value, dict):
        return value
    told = {k: zoom_condition(k, zoom) if isinstance(k, str) else None for k in value}
    if value and all(v is not None for v in told.values()):
        return next((at_zoom(value[k], zoom) for k, v in told.items() if v), None)
    if any(v is not None for v in told.values()):
        raise ConfigError(f"conditions and names are mixed: {sorted(map(str, value))}")
    out = {k: at_zoom(v, zoom) for k, v in value.items()}
    return {k: v for k, v in out.items() if v is not None}


def flattened(tree: dict | None, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in (tree or {}).items():
        name = f"{prefix}{k}"
        if isinstance(v, dict) and not {"path", "format"} & set(v):
            out |= flattened(v, f"{name}/")
        else:
            out[name] = v
    return out


def unflattened(flat: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, v in flat.items():
        *groups, last = name.split("/")
        at = out
        for g in groups:
            at = at.setdefault(g, {})
        at[last] = v
    return out


def area_of(value, folder: str | None = None) -> dict:
    """An area from well-known text, GeoJSON, bounds or a GeoJSON file."""
    if isinstance(value, str) and value.endswith((".geojson", ".json")):
        with open(value if os.path.isabs(value) or not folder else os.path.join(folder, value)) as f:
            value = json.load(f)
    return G.parse(value)


def bounds_from_options(pyramid: Pyramid, wkt_geometry: str | None = None, point: tuple[float, float] | None = None, bounds=None, zoom: int | None = None) -> Bounds | None:
    """A geometry goes before a point (whose tile it is), and that before bounds."""
    if wkt_geometry:
        g = G.parse(wkt_geometry)
        xs, ys = zip(*[(p["x"], p["y"]) for r in g["rings"] for p in r])
        return Bounds(min(xs), min(ys), max(xs), max(ys))
    if point is not None:
        t = pyramid.tile_from_point(zoom or 0, *point)
        return pyramid.without_pixelbuffer().tile_bounds(t.zoom, t.row, t.col)
    return Bounds.of(bounds) if bounds is not None else None


def zooms_from(process: ZoomLevels, init) -> ZoomLevels:
    """The zooms of a run, which must be among the process's."""
    if init is None:
        return process
    found = ZoomLevels.of(init)
    if any(z not in process for z in found):
        raise ConfigError(f"zooms {list(found)} aren't all among {list(process)}")
    return found


def config_hash(value) -> str:
    return hashlib.sha224(yaml.safe_dump(json.loads(json.dumps(value, default=str)), sort_keys=True).encode()).hexdigest()


def input_key(value, name: str) -> str:
    """A name that tells an input's definition."""
    return f"{name}-{config_hash(value)[:12]}"


def cast_option(text: str):
    """A command line's value as null, a truth value, a number, or text."""
    low = text.lower()
    if low in ("none", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
