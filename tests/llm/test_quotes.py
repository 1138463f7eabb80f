"""Quotation linking and reply order against brute force, and the SQL twins."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skyframe.llm import queries, quotes

SF = "/root/testdata/sf0.01"


def norm(x):
    return re.sub(r"[\x20\x09-\x0d]+", " ", x).strip().lower()


def brute(rows):
    """(conv, turn, body) -> (passages, linked, depth, parent), one message at a time."""
    said, out, parsed = defaultdict(set), {}, {}
    for conv, turn, _, text, *_ in rows:
        lines = []
        for x in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?(.*)", x, re.S)
            lines.append((m[1].count(">"), m[2]) if m else (0, x))
        body = "\n".join(x for d, x in lines if d == 0)
        parsed[conv, turn, text or ""] = lines, body
        if conv is not None and turn is not None:
            said[conv, turn] |= {norm(y) for y in (body, *body.split("\n"))} - {""}
    for (conv, turn, _), (lines, body) in parsed.items():
        passages, held = [], None
        for d, x in lines:
            held = held if held and held[0] == d else (passages.append(held := (d, [])) or held)
            held[1].append(x)
        passages = [p for p in passages if p[0]]
        linked, parents = 0, []
        for d, texts in passages:
            origin = None
            for asked in ([norm("\n".join(texts))], [norm(t) for t in texts]):
                met = [t for (c, t), held in said.items() if c == conv and turn is not None and t < turn and held & ({*asked} - {""})]
                origin = origin if origin is not None else max(met, default=None)
            linked += origin is not None
            parents += [origin] if d == 1 and origin is not None else []
        out[conv, turn, body] = len(passages), linked, max((d for d, _ in lines), default=0), max(parents, default=None)
    return out


ROWS = [
    (1, 0, "a", "Alpha first\nline two", "x", 1), (1, 1, "b", "> alpha   FIRST\n> line two\nBeta", "x", 1), (1, 2, "a", "Gamma on its own", "x", 1), (1, 3, "c", ">> alpha first\n>> line two\n> beta\nDelta", "x", 1),
    (1, 4, "b", "> gamma on\n> its own\nEpsilon", "x", 1), (1, 5, "a", "> > gamma on its own\n> nobody said this\nZeta", "x", 1), (1, 6, "a", "> line two\nEta", "x", 1), (1, 7, "a", "> delta\nTheta", "x", 1),
    (1, 7, "a", "> delta\nIota", "x", 1), (1, 5000, "a", "> beta\nafter many turns", "x", 1), (2, 0, "a", None, "x", 1), (2, 1, "a", "", "x", 1), (2, 2, "a", "> \n>", "x", 1), (3, 0, "a", "word " * 40_000, "x", 1),
    (3, 1, "b", "> " + "word " * 40_000 + "\nlong", "x", 1), (None, 0, "a", "> a", "x", 1), (4, None, "a", "> a\nb", "x", 1), (2, 1, "a", "", "x", 1),
]
SCHEMA = "conv_id long, turn long, role string, text string, position string, key int"


def test_links_equal_brute_force(spark):
    out = quotes.link_quotes(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = {(r["conv_id"], r["turn"], r["text"]): (r["n_passages"], r["n_linked"], r["max_depth"], r["parent_turn"]) for r in out}
    assert len(out) == len(got) and got == brute(ROWS)
    for conv in (1, 2, 3):
        rows = sorted((r["position"], r["turn"]) for r in out if r["conv_id"] == conv)
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1)) and [t for _, t in rows] == sorted(t for _, t in rows)


def test_null_conversations_and_turns_link_to_nothing(spark):
    """Messages that quote what was said, in a null conversation, at a null turn, and in a conversation with both."""
    rows = [(None, 0, "a", "hello there"), (None, 1, "b", "> hello there\nyes"), (1, None, "a", "hello there"), (1, 3, "b", "> hello there\nno"), (1, None, "b", "> hello there\n> no\nwhy"), (1, 4, "c", "> no\n>> hello there\nso")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"], r["text"]): (r["n_passages"], r["n_linked"], r["max_depth"], r["parent_turn"]) for r in out}
    assert got == brute(rows) and got[None, 1, "yes"] == (1, 0, 1, None) and got[1, 4, "so"] == (2, 1, 2, 3)


def test_reply_order_keeps_threads_together(spark):
    linked = quotes.link_quotes(spark.createDataFrame(ROWS, SCHEMA))
    ordered = quotes.reply_order(linked).collect()
    assert len(ordered) == 15  # without the null conversation and the null turn
    threads = {r["turn"]: r["thread"] for r in ordered if r["conv_id"] == 1}
    assert threads == {0: 0, 1: 0, 2: 2, 3: 0, 4: 2, 5: 5, 6: 0, 7: 0, 5000: 0}
    places = [r["turn"] for r in sorted((r for r in ordered if r["conv_id"] == 1), key=lambda r: r["place"])]
    assert places == [0, 1, 3, 6, 7, 7, 5000, 2, 4, 5]
    chats = {(r["conv_id"], r["part"]): [m["content"] for m in r["messages"]] for r in quotes.chats(quotes.reply_order(linked), most=4).collect()}
    assert chats[1, 0] == ["Alpha first\nline two", "Beta", "Delta", "Eta"] and chats[1, 2] == ["Gamma on its own", "Epsilon", "Zeta"][-len(chats[1, 2]):]


def test_hot_conversation_in_stretches(spark, monkeypatch):
    """Stretches of a few turns give what one stretch gives: chains that cross them, and a passage that all say."""
    monkeypatch.setattr(quotes, "SPAN", 8)
    rows = [(9, k, "a", f"> said {k - 1}\n> thanks\nsaid {k}\nthanks" if k else "said 0\nthanks") for k in range(120)] + [(9, 200, "a", "> said 3\nlate")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quotes.link_quotes(df)
    got = {(r["conv_id"], r["turn"], r["text"]): (r["n_passages"], r["n_linked"], r["max_depth"], r["parent_turn"]) for r in linked.collect()}
    assert got == brute([(*r, None) for r in rows])
    assert sorted((r["position"], r["turn"]) for r in linked.collect()) == [(k + 1, k) for k in range(120)] + [(121, 200)]
    assert {r["thread"] for r in quotes.reply_order(linked).collect()} == {0}
    assert [r["place"] for r in quotes.reply_order(linked).orderBy("turn").collect()] == list(range(1, 122))


@pytest.mark.parametrize("name", ["op3_quotation_linking", "quoted_mail_chats"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    linked = quotes.link_quotes(none)
    assert linked.count() == 0 and quotes.chats(quotes.reply_order(linked)).count() == 0
    assert linked.filter(F.col("position") > 0).count() == 0
