"""Quotation linking, in DataFrame functions only.

A line's quote level is the number of '>' that lead it. Runs of lines of one level are quoted passages; their
normalised text is hashed and looked up among what earlier messages of the conversation say themselves: whole
bodies and single lines. Messages come back without quotes, each with the message it answers, and are put in reply
order: a message and all that answers it, directly or not, stay together. Turns are counted in stretches, so that the
messages of one hot conversation are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import staged, sums_before

SPAN = 4096
#: Leading quote marks with blanks between them, and one blank after them.
MARKS = r"^((?:[ \t]*>)*)[ \t]?"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _lines(text: Column) -> Column:
    """array<struct<depth, line>> of a text."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("depth"), F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "").alias("line")))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n_passages, n_linked, max_depth, parent_turn, position), a row per message.

    text is the message without its quotes; parent_turn the latest earlier message of the conversation that a
    level-1 passage quotes (null: it quotes none); position counts the conversation's messages from 1 so that a
    message follows what it answers. Null text is empty. Rows equal in conversation, turn and text are one
    message (the least role is kept); other rows that share a turn are messages of their own. Messages with
    a null conversation or turn keep their place in the output and link to nothing.
    """
    m = messages.groupBy(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("raw")).agg(F.min(role).alias("role"))
    m = m.withColumn("lines", _lines(F.col("raw"))).withColumn("key", F.xxhash64("conv", "turn", "raw"))
    own = F.filter("lines", lambda x: x["depth"] == 0)
    m = m.withColumn("body", F.array_join(F.transform(own, lambda x: x["line"]), "\n"))
    said = m.filter(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode(F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", "\n")), normalised))).alias("norm")).filter(F.col("norm") != "")

    quoted = m.filter(F.exists("lines", lambda x: x["depth"] > 0)).select("conv", "turn", "key", F.posexplode("lines").alias("pos", "x")).select("conv", "turn", "key", "pos", "x.*").filter("depth > 0")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("conv", "turn", "key", "depth").orderBy("pos"))
    passages = (
        quoted.withColumn("island", island).groupBy("conv", "turn", "key", "depth", "island")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("held"))
        .withColumn("texts", F.transform("held", lambda x: x["line"]))
        .withColumn("norms", F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("kind"), normalised(F.array_join("texts", "\n")).alias("norm"))), F.transform("texts", lambda x: F.struct(F.lit(1).alias("kind"), normalised(x).alias("norm"))))))
    )
    asked = passages.select("conv", "turn", "key", "depth", "island", F.explode("norms").alias("n")).select("conv", "turn", "key", "depth", "island", "n.kind", "n.norm").filter("norm != ''")

    both = said.select("conv", "turn", F.md5("norm").alias("hash"), F.col("turn").alias("said_turn")).unionByName(asked.select("conv", "turn", F.md5("norm").alias("hash"), "key", "depth", "island", "kind"), allowMissingColumns=True)
    far = messages.filter(F.floor(F.col(turn).cast("long") / SPAN) != 0).limit(1).count() > 0
    hits = _last_said(both, far).filter(F.col("kind").isNotNull())
    links = hits.groupBy("conv", "turn", "key", "depth", "island").agg(F.max(F.when(F.col("kind") == 0, F.col("origin"))).alias("whole"), F.max("origin").alias("part"))
    linked = links.withColumn("origin", F.coalesce("whole", "part")).groupBy("conv", "turn", "key").agg(
        F.count("origin").alias("n_linked"), F.max(F.when(F.col("depth") == 1, F.col("origin"))).alias("parent_turn")
    )
    counted = passages.groupBy("conv", "turn", "key").agg(F.count("*").alias("n_passages"), F.max("depth").alias("max_depth"))
    out = m.select("conv", "turn", "key", "role", "body")
    for side in (counted, linked):
        s = side.withColumnsRenamed({"conv": "c2", "turn": "t2", "key": "k2"}).hint("merge")
        out = out.join(s, F.col("conv").eqNullSafe(F.col("c2")) & F.col("turn").eqNullSafe(F.col("t2")) & (F.col("key") == F.col("k2")), "left").drop("c2", "t2", "k2")
    out = out.withColumn("stretch", F.floor(F.col("turn") / SPAN))
    sizes = m.groupBy("conv", F.floor(F.col("turn") / SPAN).alias("stretch")).agg(F.count("*").alias("n"))
    before = sums_before(sizes, ["conv"], "stretch", "n").toDF("c2", "s2", "before")
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "stretch").orderBy("turn", "body", "key")))
    out = out.join(before.hint("merge"), F.col("conv").eqNullSafe(F.col("c2")) & F.col("stretch").eqNullSafe(F.col("s2")))
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("body").alias(text),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_depth", F.lit(0)).alias("max_depth"), "parent_turn", (F.col("before") + F.col("nth")).cast("int").alias("position"),
    )


def _last_said(both: DataFrame, far: bool) -> DataFrame:
    """both with `origin`, the latest turn before its own in which its conversation said its hash; only stretches of turns meet in one task.

    `far`: there are turns beyond the first stretch, so one stretch may have to take over what those before it said.
    """
    cut = both.withColumn("stretch", F.floor(F.col("turn") / SPAN))
    near = Window.partitionBy("conv", "hash", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    if not far:
        return cut.withColumn("origin", F.max("said_turn").over(near))
    ahead = Window.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.filter("said_turn IS NOT NULL AND stretch IS NOT NULL").groupBy("conv", "hash", "stretch").agg(F.max("said_turn").alias("last"))
    # A stretch that only asks has no row of its own: its carry comes from all stretches that either say or ask.
    met = cut.filter("stretch IS NOT NULL").select("conv", "hash", "stretch").distinct()
    keys = ["conv", "hash", "stretch"]
    carried = met.join(carried.hint("merge"), keys, "left").withColumn("carry", F.max("last").over(ahead)).filter("carry IS NOT NULL").select(*keys, "carry")
    return cut.withColumn("near", F.max("said_turn").over(near)).join(carried.hint("merge"), keys, "left").withColumn("origin", F.coalesce("near", "carry"))


def reply_order(linked: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages of link_quotes() with `thread`, the turn of the first message that they answer, directly or not, and `place`.

    place counts a conversation's messages from 1: threads by their first turn, and in a thread by turn and text, so a message follows
    what it answers and no other thread comes between. Answers name a turn, so messages that share one share its thread: the
    one begun by the latest turn that any of them quotes. Messages with a null conversation or turn are left out. Threads are
    found by doubling: a chain of n answers takes about log2(n) rounds, each written to the shared folder.
    """
    rows = linked.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).withColumnsRenamed({conv: "conv", turn: "turn"})
    up = staged(rows.filter("parent_turn IS NOT NULL").groupBy("conv", "turn").agg(F.max("parent_turn").alias("up")), "reply-up")
    while True:
        further = up.select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), F.col("up").alias("top"))
        step = staged(up.join(further.hint("merge"), (F.col("conv") == F.col("c2")) & (F.col("up") == F.col("t2")), "left").select("conv", "turn", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "reply-up")
        up = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            break
    roots = up.toDF("c2", "t2", "root")
    rows = rows.join(roots.hint("merge"), (F.col("conv") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left").drop("c2", "t2")
    rows = rows.withColumn("thread", F.coalesce("root", "turn")).drop("root").withColumn("stretch", F.floor(F.col("turn") / SPAN))
    sizes = rows.groupBy("conv", "thread", "stretch").agg(F.count("*").alias("n"))
    threads = sums_before(sizes.groupBy("conv", "thread").agg(F.sum("n").alias("n")), ["conv"], "thread", "n").withColumnRenamed("before", "threads_before")
    within = sums_before(sizes, ["conv", "thread"], "stretch", "n").withColumnRenamed("before", "turns_before")
    nth = F.row_number().over(Window.partitionBy("conv", "thread", "stretch").orderBy("turn", text))
    out = rows.withColumn("nth", nth).join(within.hint("merge"), ["conv", "thread", "stretch"]).join(threads.hint("merge"), ["conv", "thread"])
    return out.withColumn("place", F.col("threads_before") + F.col("turns_before") + F.col("nth")).drop("threads_before", "turns_before", "nth", "stretch").withColumnsRenamed({"conv": conv, "turn": turn})


def chats(ordered: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text", place: str = "place", most: int = 1000) -> DataFrame:
    """Reply-ordered conversations without quotes: (conv, part, messages array<struct<role, content>>), `most` messages to a row, from reply_order()."""
    part = F.floor((F.col(place) - 1) / most).cast("int").alias("part")
    held = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return ordered.groupBy(conv, part).agg(F.transform(held, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
