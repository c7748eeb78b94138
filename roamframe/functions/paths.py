"""Functions of path columns: arrays of steps, oldest first (see ``route.path_entry``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_path(path: Column) -> Column:
    """Newest step first."""
    return F.reverse(path)


def subpath(path: Column, from_end: int = 0, length: int | None = None) -> Column:
    """The path without its last ``from_end`` steps, or the last ``length`` of what is left."""
    left = F.greatest(F.size(path) - from_end, F.lit(0))
    if length is None:
        return F.slice(path, F.lit(1), left)
    return F.slice(path, F.greatest(left - length, F.lit(0)) + 1, F.least(left, F.lit(length)))


def path_vertices(path: Column) -> Column:
    """The vertices, newest first."""
    return F.filter(F.reverse(path), lambda s: s["t"] == "v")


def path_edges(path: Column) -> Column:
    """The edges, newest first."""
    return F.filter(F.reverse(path), lambda s: s["t"] == "e")


def vertex_ids(path: Column) -> Column:
    """Ids of the vertices, oldest first."""
    return F.transform(F.filter(path, lambda s: s["t"] == "v"), lambda s: s["vid"])


def _edge_key(step: Column) -> Column:
    return F.struct(step["label"].alias("label"), step["src"].alias("src"), step["dst"].alias("dst"))


def cyclic_path(path: Column, max_search: int | None = None) -> Column:
    """The newest edge that occurs twice, or null; a bounded search looks at the last max_search + 1 edges."""
    edges = F.transform(path_edges(path), _edge_key)
    if max_search is not None:
        edges = F.slice(edges, 1, max_search + 1)
    repeated = F.filter(edges, lambda e: F.size(F.filter(edges, lambda x: x == e)) > 1)
    return F.when(F.size(repeated) > 0, F.get(repeated, F.lit(0)))


def as_path(steps: Sequence[Column]) -> Column:
    return F.array(*steps)


def add_to_path(path: Column, step: Column) -> Column:
    return F.array_append(path, step)


def same_path(a: Column, b: Column) -> Column:
    """Equality by value."""
    return a.eqNullSafe(b)


def has_path(columns: Sequence[str]) -> bool:
    return "path" in columns


def followed_forward(step: Column) -> Column:
    return step["fwd"]


def text(path: Column) -> Column:
    """A compact printed form: ids with -label-> between them."""
    shown = F.transform(path, lambda s: F.when(s["t"] == "v", s["vid"].cast("string")).when(s["t"] == "e", F.concat(F.when(s["fwd"], "-").otherwise("<-"), s["label"], F.when(s["fwd"], "->").otherwise("-"))).otherwise(s["value"]))
    return F.concat_ws(" ", shown)
