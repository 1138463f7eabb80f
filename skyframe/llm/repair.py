"""Repair of the turn structure of conversations by Knuth's lightest derivation.

A repaired conversation has the role initials `(s?(ua)+)?`. Derivations are deductions over items (i, state): what is left
from row i on can be repaired from this state of the pattern. One antecedent gives the item of the row before by an edit
(keep, rerole, delete) or of the same row by an insertion. An item's value is (cost, audit), audit being the initials of
the edits in order, and an edit adds its cost and puts its initial before the audit. The agenda pops the lightest item
first; a popped value is final, and the work ends when the goal items are popped. Two facts make that right:

- an edit never makes a value lighter in the order (cost, rows covered, audit): it adds to the cost or covers a row more;
- edits keep the order of two values of the same item, as both get the same cost and initial.

A long conversation is cut into stretches of rows. A stretch has a table of items (state before, state after), found by
the same agenda; tables of neighbours are put together by deductions with two antecedents, whose costs add and whose
audits are strung together. That keeps the order too: two different audits of equal cost over the same rows are never
prefixes of each other, since a longer one would add insertions only, which cost.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skyframe.llm.common import BLANKS, staged, sums_before, without

#: The pattern's states by the last initial: none yet, s, u, a. It may end in the first and the last.
STATES, LAST = ("", "s", "u", "a"), ("", "a")
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Value = tuple[int, int, str]  # cost, rows covered, audit
Row = tuple[str, int, int]  # initial; 1 if truncated, 0 if sound, -1 if it has to go; how many


def lightest(axioms: Iterable[tuple[Hashable, Value]], deduce: Callable, goal: Hashable = None) -> dict[Hashable, Value]:
    """Values of all items that are popped until the goal is; without a goal, of all items. deduce(item, value, final) gives
    (item, value) of each deduction that the popped item completes; functions must be monotone and superior."""
    agenda = [(value, item) for item, value in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Value] = {}
    while agenda and (goal is None or goal not in final):
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        for head, weight in deduce(item, value, final):
            if head not in final:
                heapq.heappush(agenda, (weight, head))
    return final


def _edits(rows: list[Row]) -> Callable:
    """The deductions over items (i, state): from what is left after row i to what is left before it."""
    before: dict[str, list[tuple[str, str]]] = {q: [] for q in STATES}  # by the state reached: (state, initial)
    for (p, x), q in STEPS.items():
        before[q].append((p, x))

    def deduce(item: tuple[int, str], value: Value, final: dict) -> Iterator[tuple[tuple[int, str], Value]]:
        (i, q), (cost, covered, audit) = item, value
        for p, x in before[q]:
            if x != "s":
                yield (i, p), (cost + INSERT, covered, "I" + audit)
        if i:
            initial, fault, n = rows[i - 1]
            yield (i - 1, q), (cost + DELETE * n, covered + n, "D" * n + audit)
            if fault >= 0:
                worse = TRUNCATED * fault
                for p, x in before[q]:
                    if x == initial:
                        yield (i - 1, p), (cost + KEEP + worse, covered + 1, "K" + audit)
                    if x != "s":
                        yield (i - 1, p), (cost + REROLE + worse, covered + 1, "R" + audit)

    return deduce


def repair(rows: list[Row]) -> tuple[int, str]:
    """Least cost and its ASCII-least audit. A row that need not go comes once, rows that have to go may come as a number."""
    goal = (0, "")
    cost, _, audit = lightest([((len(rows), q), (0, 0, "")) for q in LAST], _edits(rows), goal)[goal]
    return cost, audit


Table = dict[tuple[str, str], Value]


def stretch(rows: list[Row]) -> Table:
    """The lightest repair of the rows for each (state before, state after)."""
    out: Table = {}
    for q in STATES:
        found = lightest([((len(rows), q), (0, 0, ""))], _edits(rows))
        out |= {(p, q): found[0, p] for p in STATES if (0, p) in found}
    return out


def joined(tables: list[Table]) -> Table:
    """Tables of neighbouring stretches as one. Items are (from stretch, to stretch, state before, state after); a pair of
    neighbours whose states meet deduces the item over both."""
    while len(tables) > 1:
        pairs = []
        for left, right in zip(tables[::2], tables[1::2], strict=False):
            axioms = [((side, p, q), v) for side, t in (("left", left), ("right", right)) for (p, q), v in t.items()]

            def deduce(item: tuple, value: Value, final: dict) -> Iterator[tuple[tuple, Value]]:
                side, p, q = item
                for r in STATES if side in ("left", "right") else ():
                    a, b = (item, ("right", q, r)) if side == "left" else (("left", r, p), item)
                    if a in final and b in final:
                        (c, m, x), (d, n, y) = final[a], final[b]
                        yield ("both", a[1], b[2]), (c + d, m + n, x + y)

            pairs.append({k[1:]: v for k, v in lightest(axioms, deduce).items() if k[0] == "both"})
        tables = pairs + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


class _Text:
    """The hash of a repaired text that comes row by row."""

    def __init__(self, audit: str):
        self.audit, self.hash, self.state, self.lines = iter(audit), hashlib.sha256(), "", 0

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" * bool(self.lines) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def rows(self, role: str, text: str, n: int) -> None:
        """n equal rows, with the insertions before each."""
        while n:
            edit = next(self.audit)
            n -= edit != "I"
            self.edit(edit, role, text)

    def edit(self, edit: str, role: str, text: str) -> None:
        if edit == "D":
            return
        self.state = "s" if edit == "K" and not self.state and role[:1] == "s" else "a" if self.state == "u" else "u"
        self.put(ROLES[self.state] if edit in "IR" else role, "" if edit == "I" else text)

    def end(self) -> str:
        for edit in self.audit:
            self.edit(edit, "", "")
        return self.hash.hexdigest()


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, n): distinct rows after damage and how often each is there; a row that is dropped has n = 0
    and no turn, role or text. The damage goes by crc32 of `conv:turn`, modulo 20; a null reads as one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    there = kind != 0
    new_role = F.when(kind == 4, "user").otherwise(known(role))
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text))
    rows = conversations.select(
        F.col(conv).alias("conv"), F.when(there, F.col(turn).cast("long")).alias("turn"), F.when(there, new_role).alias("role"),
        F.when(there, new_text).alias("text"), F.when(kind == 3, 2).when(there, 1).otherwise(0).cast("long").alias("n"),
    )
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _units(rows: list[dict]) -> list[Row]:
    out: list[Row] = []
    for r in rows:
        if r["fault"] < 2:
            out.append((r["initial"], r["fault"], 1))
        if gone := r["n"] - (r["fault"] < 2):
            out.append(("", -1, gone))
    return out


def _counts(rows: list[dict]) -> dict[str, int]:
    """Blank, duplicate and truncated rows, and the adjacent rows whose initials are no legal pair."""
    ends = zip(rows, rows[1:], strict=False)
    return {
        "blank": sum(r["n"] for r in rows if r["fault"] == 2),
        "duplicate": sum(r["n"] - (r["fault"] < 2) for r in rows if r["fault"] != 2),
        "truncated": sum(r["fault"] == 1 for r in rows),
        "illegal": sum(r["n"] - 1 for r in rows) + sum(a["initial"] + b["initial"] not in PAIRS for a, b in ends),
    }


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_OUT = f"k string, gaps long, {_COUNTS}, cost long, audit string, repaired_sha256 string"
_TABLE = f"k string, stretch long, first string, last string, {_COUNTS}, cells array<struct<p: string, q: string, cost: long, rows: long, audit: string>>"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _short(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """A whole conversation at once."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        k = rows[0]["k"]
        rows = sorted((r for r in rows if r["n"]), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
        seen: set[tuple[str, str]] = set()
        for r in rows:
            r["fault"] = 3 if r["fault"] < 2 and (r["role"], r["text"]) in seen else r["fault"]
            seen.add((r["role"], r["text"]))
        turns = {r["turn"] for r in rows} - {None}
        cost, audit = repair(_units(rows))
        text = _Text(audit)
        for r in rows:
            text.rows(r["role"], r["text"], r["n"])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return _arrow([{"k": k, "gaps": gaps, **_counts(rows), "cost": cost, "audit": audit, "repaired_sha256": text.end()}], schema)

    return run


def _one_stretch(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
        cells = [{"p": p, "q": q, "cost": c, "rows": n, "audit": a} for (p, q), (c, n, a) in stretch(_units(rows)).items()]
        ends = {"first": rows[0]["initial"], "last": rows[-1]["initial"]}
        return _arrow([{"k": rows[0]["k"], "stretch": rows[0]["stretch"], **ends, **_counts(rows), "cells": cells}], schema)

    return run


def _neighbours(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["stretch"])
        table = joined([{(c["p"], c["q"]): (c["cost"], c["rows"], c["audit"]) for c in r["cells"]} for r in rows])
        counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        counts["illegal"] += sum(a["last"] + b["first"] not in PAIRS for a, b in zip(rows, rows[1:], strict=False))
        cells = [{"p": p, "q": q, "cost": c, "rows": n, "audit": a} for (p, q), (c, n, a) in table.items()]
        own = {"k": rows[0]["k"], "stretch": rows[0]["above"], "first": rows[0]["first"], "last": rows[-1]["last"]}
        return _arrow([own | counts | {"cells": cells}], schema)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of k and pos, the audit first: the hash of each repaired text, whose rows only pass through."""
    k, text = None, None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["k"] != k:
                if text:
                    done.append({"k": k, "repaired_sha256": text.end()})
                k, text = r["k"], _Text(r["audit"])
            else:
                text.rows(r["role"], r["text"], r["n"])
        if done:
            yield pa.RecordBatch.from_pylist(done)
    if text:
        yield pa.RecordBatch.from_pylist([{"k": k, "repaired_sha256": text.end()}])


def _long(rows: DataFrame, span: int, fan: int) -> DataFrame:
    """Conversations of any length, in stretches of `span` distinct rows; tables of `fan` neighbours meet in a group."""
    rows = rows.filter("n > 0")
    per_turn = staged(rows.groupBy("k", "turn").agg(F.count("*").alias("m")), "turns")
    gaps = per_turn.groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    before = sums_before(per_turn, ["k"], "turn", "m").select(F.col("k").alias("k_of"), F.col("turn").alias("turn_of"), "before")
    placed = rows.join(before.hint("merge"), (F.col("k") == F.col("k_of")) & F.col("turn").eqNullSafe(F.col("turn_of")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("k", "turn").orderBy("role", "text")) - 1
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = staged(placed.select("k", place.cast("long").alias("pos"), "role", "text", "n", "fault", "initial", said.alias("said")), "placed")
    firsts = placed.groupBy("k", "said").agg(F.min("pos").alias("first_pos")).withColumnsRenamed({"k": "k_of", "said": "said_of"})
    known = placed.join(firsts.hint("merge"), (F.col("k") == F.col("k_of")) & (F.col("said") == F.col("said_of")))
    fault = F.when((F.col("fault") < 2) & (F.col("pos") > F.col("first_pos")), 3).otherwise(F.col("fault"))
    known = known.select("k", "pos", "initial", fault.alias("fault"), "n", F.floor(F.col("pos") / span).alias("stretch"))
    kind = to_arrow_schema(StructType.fromDDL(_TABLE))
    tables = staged(known.groupBy("k", "stretch").applyInArrow(_one_stretch(kind), _TABLE), "stretches")
    most = tables.agg(F.max("stretch")).first()[0] or 0
    while most:
        above = tables.withColumn("above", F.floor(F.col("stretch") / fan))
        tables, most = staged(above.groupBy("k", "above").applyInArrow(_neighbours(kind), _TABLE), "stretches"), most // fan
    ends = F.filter("cells", lambda c: (c["p"] == "") & c["q"].isin(*LAST))
    best = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"], c["audit"])))
    found = tables.select("k", "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))
    none = F.lit(None)
    audits = found.select("k", F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("long").alias("n"), "audit")
    texts = audits.unionByName(placed.select("k", "pos", "role", "text", "n", none.cast("string").alias("audit")))
    hashes = texts.repartition("k").sortWithinPartitions("k", "pos").mapInArrow(_hashed, "k string, repaired_sha256 string")
    out = found.join(gaps.hint("merge"), "k").join(hashes.hint("merge"), "k")
    return out.select("k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    span: int = 512, fan: int = 32, whole_bytes: int = 8_000_000,
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation that had
    rows before the damage.

    Rows go by turn, nulls first; different rows of one turn by role, then text, in the order of their bytes. Repeated rows
    of a turn are repeats of one row. Nulls in role and text read as one space (a null in the key of the damage too), a null
    conversation is one conversation. A role's initial is its first character; an empty role has none and can't be kept.
    A turn must be a whole number. Faults: 0 none, 1 truncated, 2 blank, 3 duplicate.

    Conversations of at most `span` distinct rows and `whole_bytes` of text are repaired in one group each. Longer ones are
    numbered by turn in stretches, repaired in stretches of `span` rows whose tables meet `fan` at a time, and hashed as a
    sorted stream; the audit of a conversation, a character per edit, is held as one string as it is one value.
    """
    k = F.when(F.col("conv").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))).alias("k")
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1)
    rows = damaged(conversations, conv, turn, role, text)
    rows = staged(rows.select(k, "conv", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "damaged")
    sizes = rows.groupBy("k").agg(F.first("conv").alias("conv"), F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    long = (F.col("rows") > span) | (F.col("bytes") > whole_bytes)
    sizes = staged(sizes.select("k", "conv", long.alias("long")), "sizes")
    many = sizes.filter("long").select("k")
    some = many.limit(1).count() > 0
    short = without(rows, "k", many) if some else rows
    out = short.groupBy("k").applyInArrow(_short(to_arrow_schema(StructType.fromDDL(_OUT))), _OUT)
    if some:
        out = out.unionByName(_long(rows.join(many.hint("merge"), "k", "left_semi"), span, fan))
    ids = sizes.select(F.col("k").alias("k_of"), F.col("conv").alias(conv))
    return out.join(ids.hint("merge"), F.col("k") == F.col("k_of")).drop("k", "k_of", "long").select(conv, *(c.split()[0] for c in _OUT.split(", ")[1:]))
