"""Conversation structure repair by prefix-doubling path ranking (operator 11).

A conversation's rows, by turn, become one whose role initials read ``(s?(ua)+)?`` at least cost; among the cheapest
edits those whose audit, a letter for each edit, is least.  ``ranking`` does the cost DP and the ranking on lanes.

Rows are sorted once, globally, and from then on known by ``at``, their place.  A conversation that lies in one
partition is solved there, lane after lane.  One that spans partitions (at most one for each border) first gives a
4 x 4 matrix of least costs for each of its partitions; their products, from the last to the first, give each
partition the cost of what follows, and its least path for each state before it gives the state it hands on.  So a
conversation of any length is spread over tasks, and none holds more of it than its partition's roles and flags.

Defined cases: a null text or role is one space; a null ``conv_id`` is one conversation of its own; rows that tie in
``turn`` are ordered by role and a hash of the text; repeated rows stay and are duplicates; an empty or unknown role has
no place in the pattern, so its row is rewritten or goes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import key_of, partitions, saved
from linkwork.llm.ranking import BATCH, ENDS, INSERT, LABELS, LANE, NEVER, STATES, D, K, Paths, R, matrices

SPACES = " \t\n\x0b\x0c\r"
#: Rows gathered before the lanes of finished runs are worked on.
BUFFER = 1 << 16


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a row's checksum names."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """``at, key, turn, role, text, code, blank, extra, a, b``: rows in order, with what the DP asks of them.

    ``code`` is 1, 2, 3 for the initials s, u, a, else 0; ``extra`` marks a truncated text; ``a``, ``b`` hash role and text.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(key_of("conv_id").alias("key"), "turn", shown("role").alias("role"), shown("text").alias("text"))
    said = F.rtrim("text", F.lit(SPACES))
    hashed = [F.xxhash64(F.lit(i), "role", "text").alias(c) for i, c in enumerate("ab")]
    rows = rows.select(
        "*",
        F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(1), F.lit("u"), F.lit(2), F.lit("a"), F.lit(3)), F.left("role", F.lit(1))), F.lit(0)).alias("code"),
        (said == "").alias("blank"),
        (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("extra"),
        *hashed,
        F.monotonically_increasing_id().alias("salt"),  # copies of a row are alike in any order
    )
    order = ["key", F.col("turn").asc_nulls_first(), "role", "a", "b", "salt"]
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("salt")
    return saved(rows.select(F.monotonically_increasing_id().alias("at"), "*"), "repair-rows")


def _part(at: str = "at") -> Column:
    return F.shiftright(at, 33)


def faults(rows: DataFrame) -> DataFrame:
    """``at, key, part, turn, code, blank, duplicate, truncated``: each row's first fault."""
    # first of its kind in a partition, then in the conversation: a hot row is one row a partition by then
    seen = rows.groupBy("key", "a", "b", _part().alias("part")).agg(F.min("at").alias("at")).groupBy("key", "a", "b").agg(F.min("at").alias("at"))
    light = rows.select("at", "key", _part().alias("part"), "turn", "code", "blank", "extra")
    light = light.join(seen.select("at", F.lit(True).alias("fresh")), "at", "left")
    again = ~F.col("blank") & F.col("fresh").isNull()
    cut = ~F.col("blank") & ~again & F.col("extra")
    light = light.select("at", "key", "part", "turn", "code", "blank", again.alias("duplicate"), cut.alias("truncated"))
    return saved(light, "repair-faults")


class _Runs:
    """Rows of whole runs, a run being one conversation's rows in one partition, cut into lanes."""

    def __init__(self, c: dict[str, np.ndarray]):
        self.c = c
        new = np.ones(len(c["at"]), dtype=bool)
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["part"][1:] != c["part"][:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(new)))
        per = -(-self.sizes // LANE)
        self.run = np.repeat(np.arange(len(per)), per)
        self.nth = np.arange(len(self.run)) - np.repeat(np.cumsum(per) - per, per)
        self.per = per
        self.lane = self.starts[self.run] + self.nth * LANE
        self.n = np.minimum(self.sizes[self.run] - self.nth * LANE, LANE)

    def batches(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """Lanes in batches of bounded size."""
        at = 0
        while at < len(which):
            wide = np.maximum.accumulate(self.n[which[at: at + BATCH]] + 1)
            many = int(np.searchsorted(wide * np.arange(1, len(wide) + 1), BATCH, side="right"))
            yield which[at: at + max(many, 1)]
            at += max(many, 1)

    def block(self, lanes: np.ndarray) -> tuple[np.ndarray, ...]:
        """``code, extra, must, n`` of some lanes, side by side."""
        n = self.n[lanes]
        at = self.lane[lanes][:, None] + np.arange(n.max())[None, :]
        inside = np.arange(n.max())[None, :] < n[:, None]
        at = np.where(inside, at, 0)
        c = self.c
        return c["code"][at], c["truncated"][at].astype(np.int64), (c["blank"] | c["duplicate"])[at], n

    def costs(self) -> np.ndarray:
        """The matrix of each lane."""
        out = np.empty((len(self.n), STATES, STATES), dtype=np.int64)
        for lanes in self.batches(np.arange(len(self.n))):
            out[lanes] = matrices(*self.block(lanes))
        return out


def _product(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.minimum((first[:, :, None] + then[None, :, :]).min(axis=1), NEVER)


def _ahead(matrix: np.ndarray, go: np.ndarray) -> np.ndarray:
    """Cost to go before a stretch, from the one behind it."""
    return np.minimum((matrix + go[None, :]).min(axis=1), NEVER)


def _run_matrices(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``key, part, matrix, first, last``: a row for each run."""
    runs = _Runs(c)
    lanes = runs.costs()
    begins = np.cumsum(runs.per) - runs.per
    rows = []
    for i, at in enumerate(runs.starts):
        whole = lanes[begins[i]]
        for j in range(1, runs.per[i]):
            whole = _product(whole, lanes[begins[i] + j])
        end = at + runs.sizes[i] - 1
        rows.append((int(c["key"][at]), int(c["part"][at]), whole.ravel().tolist(), int(c["code"][at]), int(c["code"][end])))
    return pa.RecordBatch.from_pylist([dict(zip(("key", "part", "matrix", "first", "last"), r)) for r in rows])


def _solved(c: dict[str, np.ndarray], paths_only: bool) -> tuple[_Runs, dict[str, np.ndarray] | np.ndarray]:
    """Edits of every row, or the state behind each run for each state before it."""
    runs = _Runs(c)
    head = runs.starts
    given = c["exits"][head]  # a matrix row per run; NEVER in all places: the conversation ends here
    ends = (given >= NEVER).all(axis=1)
    exits = np.where(ends[:, None], ENDS[None, :], given)[runs.run]
    last = ends[runs.run] & (runs.nth == runs.per[runs.run] - 1)
    entry = c["entry"][head][runs.run].copy()
    several = np.flatnonzero(runs.per[runs.run] > 1)
    if len(several):
        cost = runs.costs()
        for lane in several[::-1]:  # from the last lane of a run to its first
            if runs.nth[lane] + 1 < runs.per[runs.run[lane]]:
                then = exits[lane + 1]
                if last[lane + 1]:  # rows may be inserted behind the last lane
                    then = np.minimum(then, np.array([2, 2, 1, 0]) * INSERT)
                exits[lane] = _ahead(cost[lane + 1], then)
    lone = np.flatnonzero(runs.per[runs.run] == 1)
    lone = lone[np.argsort(runs.n[lone], kind="stable")]
    out = {k: np.zeros(len(c["at"]), dtype=np.int64) for k in ("label", "state", "inserted", "first", "behind", "behind_first")}
    maps = np.tile(np.arange(STATES), (len(runs.starts), 1))
    for group in (lone, several):
        for lanes in runs.batches(group):
            paths = Paths(*runs.block(lanes), exits[lanes], last[lanes])
            after = np.stack([paths.after(np.full(len(lanes), q)) for q in range(STATES)], axis=1)
            if paths_only:
                for i, lane in enumerate(lanes):
                    maps[runs.run[lane]] = after[i][maps[runs.run[lane]]]
                continue
            for i, lane in enumerate(lanes):
                if runs.nth[lane] + 1 < runs.per[runs.run[lane]]:
                    entry[lane + 1] = after[i][entry[lane]]
            edits = paths.edits(entry[lanes])
            n = runs.n[lanes]
            inside = np.arange(n.max())[None, :] < n[:, None]
            at = (runs.lane[lanes][:, None] + np.arange(n.max())[None, :])[inside]
            for k in ("label", "state", "inserted", "first"):
                out[k][at] = edits[k][:, :-1][inside]
            end = runs.lane[lanes] + n - 1
            out["behind"][end] = edits["inserted"][np.arange(len(n)), n]
            out["behind_first"][end] = edits["first"][np.arange(len(n)), n]
    return runs, (maps if paths_only else out)


def _run_maps(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    runs, maps = _solved(c, True)
    head = runs.starts
    return pa.record_batch([pa.array(c["key"][head]), pa.array(c["part"][head]), pa.array(maps.tolist(), pa.list_(pa.int64()))], names=["key", "part", "states"])


LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True


def _row_edits(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``at, key, edit, due, inserted, first, behind, behind_first, cost, illegal`` for each row."""
    runs, e = _solved(c, False)
    before = np.concatenate([[0], c["code"][:-1]])
    before[runs.starts] = c["before"][runs.starts]
    illegal = (before >= 0) & ~LEGAL[np.maximum(before, 0), c["code"]]
    own = np.select([e["label"] == D, e["label"] == K, e["label"] == R], [3, c["truncated"], 2 + c["truncated"]])
    cost = own + INSERT * (e["inserted"] + e["behind"])
    due = np.where(e["state"] == 2, 3, 2)
    edit = pa.array(np.char.mod("%c", LABELS[e["label"]]))
    small = [pa.array(x.astype(np.int32)) for x in (due, e["inserted"], e["first"], e["behind"], e["behind_first"])]
    return pa.record_batch(
        [pa.array(c["at"]), pa.array(c["key"]), edit, *small, pa.array(cost.astype(np.int64)), pa.array(illegal)],
        names=["at", "key", "edit", "due", "inserted", "first", "behind", "behind_first", "cost", "illegal"],
    )


def _by_runs(light: DataFrame, schema: str, work) -> DataFrame:
    """``work`` over whole runs: rows dealt by partition, in order, a run never torn."""
    fields = ["at", "key", "part", "code", "blank", "duplicate", "truncated"] + [c for c in ("exits", "entry", "before") if c in light.columns]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(fields[:7])}
        c["code"] = c["code"].astype(np.int64)
        if "exits" in fields:
            i = fields.index("exits")
            rows = batch.column(i)
            c["exits"] = np.full((batch.num_rows, STATES), NEVER)
            some = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                c["exits"][some] = rows.take(pa.array(some)).flatten().to_numpy().reshape(-1, STATES)
            c["entry"] = batch.column(i + 1).fill_null(0).to_numpy().astype(np.int64)
            c["before"] = batch.column(i + 2).fill_null(-1).to_numpy().astype(np.int64)
        return c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            rows += batch.num_rows
            if rows < BUFFER:
                continue
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            other = np.flatnonzero((c["key"] != c["key"][-1]) | (c["part"] != c["part"][-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last run may go on
            if cut:
                yield work({k: v[:cut] for k, v in c.items()})
            held, rows = [{k: v[cut:] for k, v in c.items()}], len(c["at"]) - cut
            rows = rows if cut else 0  # a long run: gather as much again before the next look
        if held and len(held[0]["at"]):
            yield work({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    dealt = light.select(*fields).repartition(partitions(light.sparkSession), "part").sortWithinPartitions("part", "at")
    return dealt.mapInArrow(run, schema)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cost to go behind each run of a conversation and the initial before it; a row per partition it spans."""
    pdf = pdf.sort_values("part", ascending=False)
    go, out = None, []
    for matrix in pdf["matrix"]:
        out.append(None if go is None else go.tolist())
        go = np.minimum(ENDS, np.array([2, 2, 1, 0]) * INSERT) if go is None else go
        go = _ahead(np.array(matrix).reshape(STATES, STATES), go)
    pdf = pdf.assign(exits=out, before=pdf["last"].shift(-1, fill_value=-1))
    return pdf[["key", "part", "exits", "before"]]


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """State before each run of a conversation."""
    pdf = pdf.sort_values("part")
    state, out = 0, []
    for states in pdf["states"]:
        out.append(state)
        state = int(states[state])
    return pdf.assign(entry=out)[["key", "part", "entry"]]


def edits(light: DataFrame) -> DataFrame:
    """What happens to each row of ``faults``: ``at, key, edit, due, inserted, first, behind, behind_first, cost, illegal``.

    ``edit`` is D, K or R; ``due`` the role of an R row (2 user, 3 assistant); ``inserted`` rows come before it, the first
    in role ``first``, the next in the other; ``behind`` likewise after a conversation's last row.
    """
    ranges = light.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    spans = saved(ranges.where("lo < hi").select("key"), "repair-spans")  # at most one for each border of partitions
    bounds = None
    if not spans.isEmpty():
        wide = light.join(F.broadcast(spans), "key")
        runs = saved(_by_runs(wide, "key long, part long, matrix array<long>, first long, last long", _run_matrices), "repair-runs")
        ahead = runs.groupBy("key").applyInPandas(_exits, "key long, part long, exits array<long>, before int")
        ahead = saved(ahead, "repair-exits")  # at most two rows for each partition
        known = wide.join(F.broadcast(ahead), ["key", "part"]).withColumn("entry", F.lit(0))
        states = _by_runs(known, "key long, part long, states array<long>", _run_maps)
        entry = states.groupBy("key").applyInPandas(_entries, "key long, part long, entry int")
        bounds = saved(ahead.join(entry, ["key", "part"]), "repair-bounds")
    if bounds is None:
        nothing = {"exits": F.lit(None).cast("array<long>"), "before": F.lit(None).cast("int"), "entry": F.lit(None).cast("int")}
        known = light.withColumns(nothing)
    else:
        known = light.join(F.broadcast(bounds), ["key", "part"], "left")
    kind = "at long, key long, edit string, due int, inserted int, first int, behind int, behind_first int, cost long, illegal boolean"
    return saved(_by_runs(known, kind, _row_edits), "repair-edits")


def _inserted_rows(count: Column, first: Column) -> Column:
    """Roles of inserted rows, alternating."""
    role = lambda i: F.when((first + i) % 2 == 0, "user").otherwise("assistant")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), role)


class Repair:
    """``rows`` and ``faults`` of the damaged table, ``edits`` of each row."""

    def __init__(self, rows: DataFrame, light: DataFrame, todo: DataFrame):
        self.rows, self.faults, self.edits = rows, light, todo

    def script(self) -> DataFrame:
        """``key, at, audit, messages``: each row's letters and what stands for it, an array of ``role, text``."""
        empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
        texts = self.rows.select("at", "role", "text")
        both = self.edits.drop("cost", "illegal").join(texts, "at")
        role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(F.col("due") == 2, "user").otherwise("assistant"))
        own = F.when(F.col("edit") != "D", F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
        before, behind = (_inserted_rows(F.col(a), F.col(b)) for a, b in (("inserted", "first"), ("behind", "behind_first")))
        audit = F.concat(F.repeat(F.lit("I"), F.col("inserted")), F.col("edit"), F.repeat(F.lit("I"), F.col("behind")))
        return both.select("key", "at", audit.alias("audit"), F.concat(empty(before), own, empty(behind)).alias("messages"))

    def conversations(self) -> DataFrame:
        """``key, gaps, blank, duplicate, truncated, illegal, cost`` of each conversation that has rows."""
        turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counted = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
        light = self.faults.groupBy("key").agg(*counted)
        gaps = self.faults.groupBy("key").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))
        todo = self.edits.groupBy("key").agg(F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"))
        return light.join(gaps, "key").join(todo, "key")


def repair(turns: DataFrame) -> Repair:
    """Repair ``conv_id, turn, role, text``."""
    rows = placed(turns)
    light = faults(rows)
    return Repair(rows, light, edits(light))
