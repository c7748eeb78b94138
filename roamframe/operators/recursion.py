"""Recursive traversals: one level-synchronous loop, and thin wrappers over it.

A level is one run of the step over the distinct frontier elements, joined back to the
frontier rows.  Depth-first pre-order is reproduced, where asked for, by Dewey keys: the
array of child ordinals from the start element down.  Sibling cuts act inside one list of
siblings, so they too are decided level by level.  Every loop has a bound; reaching it raises.

Instructions are structs of booleans: emit the element, go to its children, go on with its
siblings, restart the path at it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.plans.ranking import positioned
from roamframe.plans.scratch import stored
from roamframe.route import Route, Step

Predicate = Callable[[Column, Column], Column]


class TooDeep(RuntimeError):
    """A traversal was still going at its bound."""


def instruction(emit: bool, children: bool, siblings: bool, reset: bool = False) -> Column:
    return F.struct(F.lit(emit).alias("emit"), F.lit(children).alias("children"), F.lit(siblings).alias("siblings"), F.lit(reset).alias("reset"))


def emit_and_continue() -> Column:
    return instruction(True, True, True)


def emit_() -> Column:
    return instruction(True, False, True)


def emit_and_chain() -> Column:
    return instruction(True, True, False)


def emit_and_cut() -> Column:
    return instruction(True, False, False)


def continue_() -> Column:
    return instruction(False, True, True)


def chain() -> Column:
    return instruction(False, True, False)


def ignore() -> Column:
    return instruction(False, False, True)


def cut_() -> Column:
    return instruction(False, False, False)


def reset_path(inner: Column) -> Column:
    """The instruction, with the path restarting at the element, for its later siblings too."""
    return F.struct(inner["emit"].alias("emit"), inner["children"].alias("children"), inner["siblings"].alias("siblings"), F.lit(True).alias("reset"))


def _children(frontier: DataFrame, route: Route, step: Step, how: str = "inner") -> DataFrame:
    """frontier rows with each child of their element as ``__child``; a ``left`` join keeps those without, ``__parent`` tells."""
    ids = Route(route.graph, frontier.select("vid").distinct().withColumn("__s0", F.col("vid")), "vertex", ("__s0",))
    found = step(ids).df.select(F.col("__s0").alias("__of"), F.col("vid").alias("__child"))
    return frontier.join(found, F.col("vid") == F.col("__of"), how).withColumn("__parent", F.col("__of").isNotNull()).drop("__of")


def _least_of_siblings(rows: DataFrame, value: Column, name: str, level: int, scope: Sequence[str]) -> DataFrame:
    """``rows`` with the least ``value`` of their list of siblings."""
    if level:
        return rows.withColumn(name, F.min(value).over(W.partitionBy(F.slice("__dewey", 1, level), *scope)))
    if scope:
        return rows.join(rows.groupBy(*scope).agg(F.min(value).alias(name)), [*scope])
    # all start rows are siblings: one number, not one task
    return rows.withColumn(name, F.lit(rows.agg(F.min(value)).first()[0]).cast("bigint"))


def descend(
    route: Route,
    step: Step,
    control: Predicate | None = None,
    expand: Predicate | None = None,
    emit: Predicate | None = None,
    paths: bool = False,
    ordered: bool = False,
    max_levels: int = 200,
    max_silent_levels: int | None = None,
    on_silent: Callable[[Column, Column, Column], Column] | None = None,
    stop_quietly: bool = False,
    keep_repeats: bool = True,
    leaves: bool = False,
) -> Route:
    """Walk from the route's vertices along ``step`` and give the elements met, start included.

    ``control(path, element)`` gives an instruction; the path is the array of ids above the
    element.  ``expand`` and ``emit`` are plain conditions for the same two decisions.  With
    ``paths`` the result is values: the path including the element.  With ``ordered`` it has
    depth-first order, siblings by id.  A branch that has emitted nothing for more than ``max_silent_levels``
    levels ends there, or goes on where ``on_silent(path, element, levels)`` holds.  ``keep_repeats`` False gives paths as ordered sets: an
    element that closes a cycle is not written twice.  ``leaves`` gives only elements without any children, told
    level by level from the join that finds the children.
    """
    ordered = ordered or control is not None
    start = route.df
    carried = [c for c in route.carried if c not in ("path",)]
    kept = list(dict.fromkeys([*carried, *(["__dewey"] if ordered else []), "vid"]))
    if ordered:
        if route.order:
            start = positioned(start, [F.col(c) for c in route.order], "__n", ())
        else:
            start = positioned(start, [F.col("vid")], "__n", ())
        start = start.withColumn("__dewey", F.array("__n")).drop("__n")
    kind = dict(route.graph.v.dtypes)["vid"]
    # Parquet, not a checkpoint: a checkpoint keeps what the optimizer derived of its plan, and that grows with every level
    frontier = stored(start.withColumn("__path", F.array().cast(f"array<{kind}>")).withColumn("__silent", F.lit(0)), "level")
    out: DataFrame | None = None
    for level in range(max_levels + 1):
        if frontier.isEmpty():
            break
        if level == max_levels:
            if stop_quietly:
                break
            raise TooDeep(f"still going after {max_levels} levels; bound the traversal or raise max_levels")
        path, element = F.col("__path"), F.col("vid")
        if control is not None:
            nothing = F.array().cast(f"array<{kind}>")
            place = F.element_at("__dewey", -1)
            told = _least_of_siblings(frontier.withColumn("__i", control(path, element)), F.when(F.col("__i.reset"), place), "__reset", level, route.scope)
            # siblings after a reset come with an empty path
            told = told.withColumn("__path", F.when(place > F.col("__reset"), nothing).otherwise(path)).withColumn("__i", control(path, element))
            told = told.withColumn("__path", F.when(F.col("__i.reset"), nothing).otherwise(path))
            told = _least_of_siblings(told, F.when(~F.col("__i.siblings"), place), "__cut", level, route.scope)
            frontier = told.filter(F.col("__cut").isNull() | (place <= F.col("__cut"))).drop("__cut", "__reset")
            emits, expands = F.col("__i.emit"), F.col("__i.children")
        else:
            emits = F.lit(True) if emit is None else F.coalesce(emit(path, element), F.lit(False))
            expands = F.lit(True)
        if expand is not None:
            expands = expands & F.coalesce(expand(path, element), F.lit(False))
        grown = F.array_append(path, element)
        if not keep_repeats:
            grown = F.when(F.array_contains(path, element), path).otherwise(grown)
        here = frontier.withColumn("__emits", emits).withColumn("__expands", expands).withColumn("__next", grown)
        here = here.withColumn("__silent", F.when(F.col("__emits"), 0).otherwise(F.col("__silent") + 1))
        if max_silent_levels is not None:
            goes_on = F.lit(False) if on_silent is None else F.coalesce(on_silent(F.col("__next"), element, F.col("__silent")), F.lit(False))
            here = here.withColumn("__expands", F.col("__expands") & ((F.col("__silent") <= max_silent_levels) | goes_on))
        if leaves:
            family = stored(_children(here.select(*kept, "__next", "__silent", "__emits", "__expands"), route, step, "left"), "family")
            found = family.filter(~F.col("__parent") & F.col("__emits")).withColumn("__emit", F.col("__next"))
            below = family.filter(F.col("__parent") & F.col("__expands"))
        else:
            found = here.filter("__emits").withColumn("__emit", F.col("__next"))
            below = _children(here.filter("__expands"), route, step)
        found = found.withColumn("__level", F.lit(level)).select(*dict.fromkeys([*kept, "__emit", "__level"]))
        out = found if out is None else out.unionByName(found)
        if ordered:
            n = F.row_number().over(W.partitionBy("__dewey", *route.scope).orderBy("__child")).cast("long")
            below = below.withColumn("__dewey", F.array_append("__dewey", n))
        keep = [*carried, *(["__dewey"] if ordered else [])]
        frontier = below.select(*keep, F.col("__child").alias("vid"), F.col("__next").alias("__path"), "__silent")
        if not leaves or ordered:
            frontier = stored(frontier, "level")
    order = ("__dewey",) if ordered else ()
    keep = [*carried, *order, "__level"]
    if paths:
        return Route(route.graph, out.select(*keep, F.col("__emit").alias("value")), "value", route.scope, order)
    return Route(route.graph, out.select(*keep, "vid"), "vertex", route.scope, order)


def _gate(depth: int | None, path_pred, element_pred, pred, cycles: bool) -> Predicate:
    """Whether to go to the children of an element."""

    def test(path: Column, element: Column) -> Column:
        out = F.lit(True)
        if depth is not None:
            out = out & (F.size(path) < depth)
        if not cycles:
            out = out & ~F.array_contains(path, element)
        for p, args in ((path_pred, (path,)), (element_pred, (element,)), (pred, (path, element))):
            if p is not None:
                out = out & p(*args)
        return out

    return test


def all_(route: Route, step: Step, depth: int | None = None, path_pred=None, element_pred=None, pred=None, **more) -> Route:
    """Every element reachable, once per path; a repeat on a path is given and not followed."""
    return descend(route, step, expand=_gate(depth, path_pred, element_pred, pred, False), **more)


def all_with_cycles(route: Route, step: Step, depth: int | None = None, path_pred=None, element_pred=None, pred=None, **more) -> Route:
    """As ``all_`` without the cycle check; a bound or predicate has to end it."""
    return descend(route, step, expand=_gate(depth, path_pred, element_pred, pred, True), **more)


def all_paths(route: Route, step: Step, depth: int | None = None, path_pred=None, element_pred=None, pred=None, **more) -> Route:
    """The paths to every element, as ordered sets."""
    return descend(route, step, expand=_gate(depth, path_pred, element_pred, pred, False), paths=True, keep_repeats=False, **more)


def all_paths_with_cycles(route: Route, step: Step, depth: int | None = None, path_pred=None, element_pred=None, pred=None, **more) -> Route:
    return descend(route, step, expand=_gate(depth, path_pred, element_pred, pred, True), paths=True, **more)


def deepest(route: Route, step: Step, **more) -> Route:
    """The elements without children; those that only a bound cut off don't count."""
    return all_(route, step, leaves=True, **more)


def deepest_paths(route: Route, step: Step, **more) -> Route:
    return all_paths(route, step, leaves=True, **more)


def all_paths_to(route: Route, hit: Callable[[Column], Column], step: Step, paths: bool = True, **more) -> Route:
    """Every path that ends where ``hit`` holds, going no further there."""
    gate = _gate(None, None, None, None, False)
    return descend(route, step, expand=lambda p, e: gate(p, e) & ~F.coalesce(hit(e), F.lit(False)), emit=lambda p, e: hit(e), paths=paths, **more)


def search(route: Route, hit: Callable[[Column], Column], step: Step, **more) -> Route:
    """The ends of ``all_paths_to``, one per path."""
    return all_paths_to(route, hit, step, paths=False, **more)


def _cycling(route: Route, step: Step, paths: bool, complete: bool, more: dict) -> Route:
    closed = lambda p, e: (F.size(p) > 0) & (e == F.element_at(p, 1))
    if complete:
        return descend(route, step, emit=lambda p, e: F.when(F.size(p) > 0, closed(p, e)).otherwise(False), expand=lambda p, e: ~F.array_contains(p, e), paths=paths, **more)

    def control(p: Column, e: Column) -> Column:
        back = F.when(F.size(p) > 0, e == F.element_at(p, 1)).otherwise(F.lit(False))
        return F.when(back, emit_and_cut()).when(F.array_contains(p, e), ignore()).otherwise(continue_())

    return descend(route, step, control=control, paths=paths, **more)


def all_cycles(route: Route, step: Step, complete: bool = True, **more) -> Route:
    """The elements that close a path on its start; ``complete`` False stops a list of siblings at the first."""
    return _cycling(route, step, False, complete, more)


def all_cycle_paths(route: Route, step: Step, complete: bool = True, **more) -> Route:
    """The closed paths, start repeated at the end."""
    return _cycling(route, step, True, complete, more)
