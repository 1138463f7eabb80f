"""Repair of conversations against a search over all short edit scripts, and long conversations against short ones."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from skyframe.llm import queries, repair

KIND = "conv_id long, turn long, role string, text string, k string, n int, fault int, audit string"
SF = "/root/testdata/sf0.01"


@functools.cache
def brute(rows):
    """rows: (initial, fault) with fault 0, 1 or -1 -> (cost, audit), by trying every edit script with up to two insertions in a gap."""
    best = None

    def go(i, state, cost, audit, gap):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if gap < 2:
            go(i, "a" if state == "u" else "u", cost + 2, audit + "I", gap + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if fault >= 0:
                if (state, initial) in repair.STEPS:
                    go(i + 1, repair.STEPS[state, initial], cost + fault, audit + "K", 0)
                go(i + 1, "a" if state == "u" else "u", cost + 2 + fault, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def plain(rows):
    """conv -> result, row by row; the repair by the dynamic program over prefixes that keeps the least (cost, audit)."""
    out, convs = {}, {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = convs.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in here:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in here} - {None}
        held = {"": (0, "", ())}
        for (_, role, text), fault in zip(here, faults, strict=True):
            new = {}
            for p, (cost, audit, lines) in list(held.items()):
                starts = [(p, cost, audit, lines)]
                q = "a" if p == "u" else "u"
                starts.append((q, cost + 2, audit + "I", (*lines, f"{repair.ROLES[q]}:")))
                for p2, c, a, ls in starts:
                    found = [(p2, c + 3, a + "D", ls)]
                    if fault not in ("blank", "duplicate"):
                        c += fault == "truncated"
                        if (p2, role[:1]) in repair.STEPS:
                            found.append((repair.STEPS[p2, role[:1]], c, a + "K", (*ls, f"{role}:{text}")))
                        q = "a" if p2 == "u" else "u"
                        found.append((q, c + 2, a + "R", (*ls, f"{repair.ROLES[q]}:{text}")))
                    for q, *value in found:
                        new[q] = min(new.get(q, tuple(value)), tuple(value))
            held = new
        ends = [held[q] for q in ("", "a") if q in held] + [(c + 2, a + "I", (*ls, "assistant:")) for q, (c, a, ls) in held.items() if q == "u"]
        cost, audit, lines = min(ends)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_lightest_is_the_least_of_all_scripts():
    rng = random.Random(1)
    for _ in range(400):
        rows = tuple((rng.choice("suatx"), rng.choice([0, 0, 1, -1])) for _ in range(rng.randint(0, 5)))
        units = [(x, f, 1) for x, f in rows]
        assert repair.repair(units) == brute(rows)
        whole = repair.joined([repair.stretch(units[i : i + 2]) for i in range(0, len(units), 2)]) if rows else {("", ""): (0, 0, "")}
        assert min(v[::2] for (p, q), v in whole.items() if p == "" and q in ("", "a")) == brute(rows)


def odd_rows(seed, n_rows, convs, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", " \n", "", None, "Why?\t", "é!", "x ", "a. b", " "]
    row = lambda: (rng.choice(convs), rng.choice(turns), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts), "k", 1, 1, "a")
    return [row() for _ in range(n_rows)]


def check(spark, rows, **more):
    got = repair.repair_damaged(spark.createDataFrame(rows, KIND), **more).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_odd_rows(spark):
    rows = odd_rows(2, 1500, [*range(150), None], [None, -3, 0, 1, 2, 3, 7, 2**60])
    rows += [(900 + i, 0, "user", "gone.", "k", 1, 1, "a") for i in range(60)] + [(1, 5, "user", "w" * 300_000, "k", 1, 1, "a")]
    check(spark, rows)
    check(spark, [])


def test_long_conversations_in_stretches(spark):
    """A conversation that holds most rows, with repeats within a turn and across turns."""
    rows = odd_rows(3, 2500, [7, 7, 7, None, 8], [None, *range(700)]) + [(7, 5, "user", "again.", "k", 1, 1, "a")] * 500
    rows += [(9, t, "user" if t % 2 else "assistant", f"turn {t}.", "k", 1, 1, "a") for t in range(300)]
    check(spark, rows, span=16, fan=3)
    check(spark, rows, span=7, fan=2, whole_bytes=300)


def test_query_and_sql(spark):
    got = queries.op11_conversation_repair(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    out = con.execute(queries.ORACLES["op11_conversation_repair"])
    names = [d[0] for d in out.description]
    order = [names.index(c) for c in got[0].asDict()]
    assert {r[order[0]]: tuple(r[i] for i in order[1:]) for r in out.fetchall()} == want
    assert sum(v[5] for v in want.values()) > 0


@pytest.mark.parametrize("audit, want", [("", ""), ("I", "user:"), ("IKR", "user:\nassistant:x.\nuser:x.")])
def test_text_of_an_audit(audit, want):
    text = repair._Text(audit)
    for _ in range(len(audit.replace("I", ""))):
        text.rows("assistant", "x.", 1)
    assert text.end() == hashlib.sha256(want.encode()).hexdigest()
