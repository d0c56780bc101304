"""Review of annotations: an audited state machine, point edits and guards, as folds over event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import let
from glyphmill.operators.ordered import cuts_of, range_of

# States, legal transitions, and actions that count as human work.
STATES = ("proposed", "needs_point_review", "needs_mask_review", "accepted", "rejected", "merged")
TRANSITIONS = {
    ("proposed", "open_points"): "needs_point_review",
    ("proposed", "open_mask"): "needs_mask_review",
    ("needs_point_review", "confirm_points"): "needs_mask_review",
    ("needs_point_review", "reject"): "rejected",
    ("needs_point_review", "merge"): "merged",
    ("needs_mask_review", "accept"): "accepted",
    ("needs_mask_review", "back_to_points"): "needs_point_review",
    ("accepted", "reopen"): "needs_point_review",
    ("rejected", "reopen"): "needs_point_review",
    ("merged", "reopen"): "needs_point_review",
}
TERMINAL = ("accepted", "rejected", "merged")
UNRESOLVED = ("proposed", "needs_point_review", "needs_mask_review")
POINT_ACTIONS = ("point_add", "point_move", "point_delete", "point_label_toggle", "mask_reject_manual_box")
PROPOSED, ADDED, MOVED = "molmo", "human_added", "human_moved"
UNDO_LIMIT = 20


def next_state(state: Column, action: Column) -> Column:
    """State after an action, null if the action is illegal there."""
    table = F.create_map(*[F.lit(x) for (s, a), to in TRANSITIONS.items() for x in (f"{s}|{a}", to)])
    return F.try_element_at(table, F.concat_ws("|", state, action))


#: Events of one key that are sorted in one array, and entries of a log that a step of the audit holds.
BLOCK_ROWS, PIECE = 1_000_000, 512
#: For each action, where each state goes, by number; -1 where the action is illegal.
MOVES = {a: [STATES.index(TRANSITIONS[s, a]) if (s, a) in TRANSITIONS else -1 for s in STATES] for a in dict.fromkeys(a for _, a in TRANSITIONS)}
MERGED = STATES.index("merged")


def _moves(action: Column) -> Column:
    """Where an action takes each state, null for an unknown action."""
    return F.try_element_at(F.create_map(*[x for a, to in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, to)))]), action)


def _logs(events: DataFrame, key: str, order: list[str], action: str, cuts: list, *more: Column) -> DataFrame:
    """Rows (key, block, log): the events of a key in a range of time, in order."""
    block = F.coalesce(range_of(F.col(order[0]), cuts), F.lit(0)) if cuts else F.lit(0)
    entry = F.struct(*order, F.col(action).alias("__a"), *more)
    return events.groupBy(key, block.alias("__block")).agg(F.array_sort(F.collect_list(entry)).alias("__log"))


def _moved(s: Column, e: Column) -> Column:
    """Where an event takes (to, legal, reopened, merged, into)."""
    to = F.get(_moves(e["__a"]), s["to"])
    legal = F.coalesce(to >= 0, F.lit(False))
    merges = legal & (to == MERGED)
    return F.struct(
        F.when(legal, to).otherwise(s["to"]).alias("to"),
        (s["legal"] + legal.cast("long")).alias("legal"),
        (s["reopened"] + (legal & (e["__a"] == "reopen")).cast("long")).alias("reopened"),
        F.when(legal, merges).otherwise(s["merged"]).alias("merged"),
        F.when(merges, e["__into"]).when(legal, F.lit(None)).otherwise(s["into"]).alias("into"),
    )


def _from(state: int) -> Column:
    return F.struct(F.lit(state).alias("to"), F.lit(0).cast("long").alias("legal"), F.lit(0).cast("long").alias("reopened"), F.lit(False).alias("merged"), F.lit(None).cast("string").alias("into"))


def _composed(log: Column) -> Column:
    """What a log does to each of the states: an array of (to, legal, reopened, merged, into) by the state before it.

    Such maps compose: the log after another one starts where that one ends.
    """
    return F.aggregate(log, F.array(*map(_from, range(len(STATES)))), lambda acc, e: F.transform(acc, lambda s: _moved(s, e)))


def replay(events: DataFrame, key: str, order: list[str], action: str = "action", start: str = "proposed", into: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Final state of each instance: illegal actions change nothing and are counted.

    An action maps the six states to states, and such maps compose: a log is
    cut into ranges of time of about ``block_rows`` events of all keys, a range
    of a key's log is reduced to one map, and a key's maps are applied in
    order.  So a key's log is spread over tasks, and what meets for a key is a
    row for each range.  Events of one time stay in one range.

    ``into`` is the column with the instance that a merge names; the result has
    it as ``merged_into_id`` while the instance is merged, and reopening clears it.
    """

    def step(acc: Column, part: Column) -> Column:
        s = F.get(part["map"], acc["to"])
        return F.struct(
            s["to"].alias("to"), (acc["n"] + part["n"]).alias("n"), (acc["legal"] + s["legal"]).alias("legal"), (acc["reopened"] + s["reopened"]).alias("reopened"),
            F.when(s["to"] == MERGED, F.when(s["merged"], s["into"]).otherwise(acc["into"])).alias("into"),
        )

    cuts = cuts_of(events, order[0], block_rows or BLOCK_ROWS)
    logs = _logs(events, key, order, action, cuts, (F.col(into).cast("string") if into else F.lit(None).cast("string")).alias("__into"))
    n = F.size("__log").cast("long")
    if cuts:
        part = F.struct(F.col("__block").alias("block"), n.alias("n"), _composed(F.col("__log")).alias("map"))
        maps = logs.select(key, part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("maps"))
        zero = F.struct(F.lit(STATES.index(start)).alias("to"), *[F.lit(0).cast("long").alias(c) for c in ("n", "legal", "reopened")], F.lit(None).cast("string").alias("into"))
        done = maps.select(key, F.aggregate("maps", zero, step).alias("r")).withColumn("n", F.col("r.n"))
    else:  # one range: no other state than the first is possible
        done = logs.select(key, F.aggregate("__log", _from(STATES.index(start)), _moved).alias("r"), n.alias("n"))
    name = F.get(F.array(*map(F.lit, STATES)), F.col("r.to")).alias("state")
    counts = {"n_legal": F.col("r.legal"), "n_illegal": F.col("n") - F.col("r.legal"), "n_reopened": F.col("r.reopened")}
    return done.select(key, name, *[c.cast("int").alias(k) for k, c in counts.items()], *([F.col("r.into").alias("merged_into_id")] if into else []))


def human_touched(log: Column, of_detail: Callable[[Column], Column] = lambda d: d) -> Column:
    """Any point action in a log of (action, detail) structs, or points confirmed; opening doesn't count.

    ``of_detail`` gives the action that the detail of a state change names.
    """
    return F.coalesce(F.exists(log, lambda e: e["action"].isin(*POINT_ACTIONS) | ((e["action"] == "state_change") & (of_detail(e["detail"]) == "confirm_points"))), F.lit(False))


def positive_points(points: Column) -> Column:
    return F.filter(points, lambda p: p["label"] == 1)


def can_accept(points: Column, mask: Column, state: Column | None = None, log: Column | None = None) -> Column:
    """A positive point and a mask; with a state and a log also the right state and a human action."""
    ok = (F.size(positive_points(points)) > 0) & mask.isNotNull()
    if state is not None:
        ok = ok & (state == "needs_mask_review")
    return ok & human_touched(log) if log is not None else ok


def unresolved(state: Column) -> Column:
    return state.isin(*UNRESOLVED)


def display_order(state: Column) -> Column:
    """Place of a state in lists of instances, 9 for an unknown one."""
    order = ("needs_point_review", "needs_mask_review", "proposed", "accepted", "rejected", "merged")
    table = F.create_map(*[F.lit(x) for k, s in enumerate(order) for x in (s, k)])
    return F.coalesce(F.try_element_at(table, state), F.lit(9))


def resolve_click(nearest: Column, selected: Column, selected_exists: Column, add_mode: Column) -> Column:
    """What a click means: select or deselect the point it hits, move the selected one, add one, or nothing."""
    return (
        F.when(nearest.isNotNull() & (nearest == selected), "deselect")
        .when(nearest.isNotNull(), "select")
        .when(selected.isNotNull() & F.coalesce(selected_exists, F.lit(False)), "move")
        .when(F.coalesce(add_mode, F.lit(False)), "add")
        .otherwise("none")
    )


def edited_points(edits: DataFrame, key: str, order: str) -> DataFrame:
    """State of each point after its edits (action, x, y): place, label, source, first place before any move, and whether it is there.

    A proposed point that is moved remembers where it was first and becomes
    human_moved; an added one is human_added, with label 0 if it was added as
    negative; toggling flips the label.
    """
    log = F.array_sort(F.collect_list(F.struct(order, "action", "x", "y")))

    def step(p: Column, e: Column) -> Column:
        a, made = e["action"], ("propose", "add", "add_negative")
        moved = a == "move"
        return F.struct(
            F.when(a.isin(*made, "move"), e["x"]).otherwise(p["x"]).alias("x"),
            F.when(a.isin(*made, "move"), e["y"]).otherwise(p["y"]).alias("y"),
            F.when(a == "toggle", 1 - p["label"]).when(a.isin(*made), (a != "add_negative").cast("int")).otherwise(p["label"]).alias("label"),
            F.when(a == "propose", PROPOSED).when(a.isin("add", "add_negative"), ADDED).when(moved & (p["source"] == PROPOSED), MOVED).otherwise(p["source"]).alias("source"),
            F.when(moved & (p["source"] == PROPOSED), p["x"]).otherwise(p["original_x"]).alias("original_x"),
            F.when(moved & (p["source"] == PROPOSED), p["y"]).otherwise(p["original_y"]).alias("original_y"),
            F.when(a == "delete", False).when(a.isin(*made), True).otherwise(p["present"]).alias("present"),
        )

    none = F.lit(None)
    zero = F.struct(none.cast("double").alias("x"), none.cast("double").alias("y"), F.lit(1).alias("label"), none.cast("string").alias("source"), none.cast("double").alias("original_x"), none.cast("double").alias("original_y"), F.lit(False).alias("present"))
    return edits.groupBy(key).agg(log.alias("__log")).select(key, F.aggregate("__log", zero, step).alias("__p")).select(key, "__p.*")


def undo_stack(log: DataFrame, key: str, order: str, limit: int = UNDO_LIMIT) -> DataFrame:
    """Current state and the undo and redo stacks after a log of (action, state), where ``state`` is what an edit leaves.

    An edit pushes the state before it to undo, without the oldest beyond the
    limit, and clears redo; undo and redo push the current state to the other
    stack and bring back the last one of their own.
    """
    entries = F.array_sort(F.collect_list(F.struct(order, "action", "state")))
    empty = F.array().cast("array<string>")

    def top(a: Column) -> Column:
        return F.try_element_at(a, F.lit(-1))

    def pop(a: Column) -> Column:
        return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))

    def capped(a: Column) -> Column:
        return F.slice(a, F.greatest(F.size(a) - limit, F.lit(0)) + 1, F.lit(limit))

    def step(s: Column, e: Column) -> Column:
        undo, redo = (e["action"] == "undo") & (F.size(s["undo"]) > 0), (e["action"] == "redo") & (F.size(s["redo"]) > 0)
        edit, now = ~e["action"].isin("undo", "redo"), F.array(s["state"])
        return F.struct(
            F.when(edit, e["state"]).when(undo, top(s["undo"])).when(redo, top(s["redo"])).otherwise(s["state"]).alias("state"),
            F.when(edit, capped(F.concat(s["undo"], now))).when(undo, pop(s["undo"])).when(redo, F.concat(s["undo"], now)).otherwise(s["undo"]).alias("undo"),
            F.when(edit, empty).when(undo, F.concat(s["redo"], now)).when(redo, pop(s["redo"])).otherwise(s["redo"]).alias("redo"),
        )

    zero = F.struct(F.lit(None).cast("string").alias("state"), empty.alias("undo"), empty.alias("redo"))
    return log.groupBy(key).agg(entries.alias("log")).select(key, F.aggregate("log", zero, step).alias("s")).select(key, "s.*")


#: Events of a log that stand for themselves, and the one that goes before an accept.
LOGGED, ACCEPTED = ("point_add", "point_move", "point_delete", "point_label_toggle", "mask_reject_manual_box"), "mask_accept"


def audit(events: DataFrame, key: str, order: list[str], action: str = "action", start: str = "proposed", block_rows: int | None = None, full: bool = False) -> DataFrame:
    """The state_change events of each instance's log: (key, *order, from, to, action), a row for each legal action.

    ``full`` adds the log's other events, with ``event`` and ``seq``, their
    place among those of one action: a row for each point action, and one of
    mask_accept before each accept; ``from`` and ``to`` are null there.

    Ranges of a key's log are reduced to maps, as in ``replay``; each range
    then starts from the state that those before it lead to, in its own task.
    """
    no = F.lit(None).cast("string")
    row = lambda e, before, to, event, seq: F.struct(*[e[c].alias(c) for c in order], before.alias("from"), to.alias("to"), e["__a"].alias("action"), F.lit(event).alias("event"), F.lit(seq).alias("seq"))
    sample = F.struct(*order, F.lit("").alias("from"), F.lit("").alias("to"), F.col(action).alias("action"), F.lit("").alias("event"), F.lit(0).alias("seq"))
    kind = f"array<{events.select(sample.alias('c')).schema['c'].dataType.simpleString()}>"
    names = F.array(*map(F.lit, STATES))

    def entry(acc: Column, e: Column) -> Column:
        to = F.get(_moves(e["__a"]), acc["state"])
        legal = F.coalesce(to >= 0, F.lit(False))
        change = lambda seq: row(e, F.get(names, acc["state"]), F.get(names, to), "state_change", seq)
        made = F.when(legal, F.array(change(0)).cast(kind))
        if full:
            made = F.when(legal & (e["__a"] == "accept"), F.array(row(e, no, no, ACCEPTED, 0), change(1)).cast(kind)).when(e["__a"].isin(*LOGGED), F.array(F.struct(*[e[c].alias(c) for c in order], no.alias("from"), no.alias("to"), e["__a"].alias("action"), e["__a"].alias("event"), F.lit(0).alias("seq"))).cast(kind)).otherwise(made)
        return F.struct(F.when(legal, to).otherwise(acc["state"]).alias("state"), F.when(made.isNotNull(), F.concat(acc["rows"], made)).otherwise(acc["rows"]).alias("rows"))

    def piece(acc: Column, part: Column) -> Column:
        # rows of a piece are put together on their own, so that a long log isn't copied at each step
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("rows")), entry)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["rows"], F.array(i["rows"])).alias("rows")))

    logs = _logs(events, key, order, action, cuts_of(events, order[0], block_rows or BLOCK_ROWS), no.alias("__into"))
    maps = logs.select(key, F.struct(F.col("__block").alias("block"), _composed(F.col("__log")).alias("map")).alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("maps"))
    at = F.struct(F.lit(STATES.index(start)).alias("state"), F.array().cast("array<struct<block:int,state:int>>").alias("starts"))
    walked = F.aggregate("maps", at, lambda acc, p: F.struct(F.get(p["map"], acc["state"])["to"].alias("state"), F.concat(acc["starts"], F.array(F.struct(p["block"].alias("block"), acc["state"].alias("state")))).cast("array<struct<block:int,state:int>>").alias("starts")))
    starts = maps.select(F.col(key).alias("__key"), F.inline(walked["starts"])).select("__key", F.col("block").alias("__of"), F.col("state").alias("__start"))
    begun = logs.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("__log") - 1) / PIECE).cast("int")), lambda k: F.slice("__log", k * PIECE + 1, PIECE))
    done = F.aggregate(pieces, F.struct(F.col("__start").alias("state"), F.array().cast(f"array<{kind}>").alias("rows")), piece)
    rows = begun.select(key, F.inline(F.flatten(done["rows"])))
    return rows if full else rows.drop("event", "seq")


#: Actions of a session that edit points, and how many positive points they add.
EDITS = ("add_positive", "add_negative", "move", "delete_positive", "delete_negative")


def edit_session(events: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """(key, state, n_positive, has_mask, mask_source) after a session on each instance.

    ``activate`` opens a proposed instance for its mask if it has one, else for
    its points.  An edit of points in mask review drops back to the points, and
    then, like ``confirm_points``, predicts anew: with a positive point there is
    a mask of source sam3_auto, without one the mask goes, and mask review
    drops back.  ``manual_box`` gives a mask of source human_box.  Other
    actions are those of the state machine; ``accept`` needs a positive point
    and a mask, ``confirm_points`` a positive point.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("done"))))

    def step(s: Column, e: Column) -> Column:
        a = e["done"]
        edit = a.isin(*EDITS)
        n = F.greatest(s["n_positive"] + F.when(a == "add_positive", 1).when(a == "delete_positive", -1).otherwise(0), F.lit(0))
        mask = s["mask_source"].isNotNull()
        opened = F.when(mask, "open_mask").otherwise("open_points")
        allowed = F.when(a == "accept", (n > 0) & mask).when(a == "confirm_points", n > 0).otherwise(F.lit(True))
        meant = F.when((a == "activate") & (s["state"] == "proposed"), opened).when(edit & (s["state"] == "needs_mask_review"), "back_to_points").when(allowed, a)
        to = F.coalesce(next_state(s["state"], meant), s["state"])
        again = edit | ((a == "confirm_points") & (to != s["state"]))
        source = F.when(a == "manual_box", F.lit("human_box")).when(again & (n > 0), F.lit("sam3_auto")).when(again, F.lit(None).cast("string")).otherwise(s["mask_source"])
        back = again & (n == 0) & (to == "needs_mask_review")
        return F.struct(F.when(back, "needs_point_review").otherwise(to).alias("state"), n.alias("n_positive"), source.alias("mask_source"))

    zero = F.struct(F.lit("proposed").alias("state"), F.lit(0).alias("n_positive"), F.lit(None).cast("string").alias("mask_source"))
    folded = events.groupBy(key).agg(log.alias("log")).select(key, F.aggregate("log", zero, step).alias("s"))
    return folded.select(key, "s.state", "s.n_positive", F.col("s.mask_source").isNotNull().alias("has_mask"), "s.mask_source")
