"""Token ids against the tokenizer itself, and packing whatever the partitions."""

import random
from array import array

from pyspark.sql import functions as F

from skyframe.llm import packing, queries
from skyframe.llm.common import sums_before

SCRIPTS = (
    "abcxyzABCsttredllvem", "éüßñçøŉǅ", "абвгдЖЯё", "αβγςΣΩ", "अआकखि्ंँ", "日本語中文", "אבגשלום", "ابجده", "̸́̈‍​ 　´",
    "…—–‘’“”«»¡¿", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "0123456789Ⅷ½²", "\U0001f600\U0001f468İıſK", "\x00\x1c\x1d\x85",
)
MARKS = SCRIPTS[10]


def strings(n, seed):
    """Strings of words in mixed and single scripts, many with marks at their ends, from a pool so that words recur."""
    rng = random.Random(seed)

    def word():
        if rng.random() < 0.5:
            return "".join(rng.choice(rng.choice(SCRIPTS)) for _ in range(rng.randint(1, 3)))
        script = rng.choice(SCRIPTS)
        return "".join(rng.choice(script) for _ in range(rng.randint(1, 4))) + "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 3)))

    pool = [word() for _ in range(4000)]
    return ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  ", ""]) for _ in range(rng.randint(1, 8))) for _ in range(n)]


def test_ids_equal_the_tokenizers_in_any_order():
    from tokenizers import Tokenizer

    texts = strings(50_000, 1) + ["… …?", "” ”)", "’ ’,", "— —!", "क क!"]
    want = [e.ids for e in Tokenizer.from_file(queries.WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    order = list(range(len(texts)))
    for seed in (0, 1):
        random.Random(seed).shuffle(order)
        got = packing.WordEncoder(queries.WORD_BPE, most=20_000)([texts[k].encode() for k in order])
        assert [array("I", x).tolist() for x in got] == [want[k] for k in order]


def test_partitions_change_nothing(spark):
    rows = [(k, x * 40) for k, x in enumerate(strings(3000, 2))] + [(5000, "a " * 9000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(map(tuple, packing.token_pieces(df.repartition(n), queries.WORD_BPE).collect())) for n in (1, 32))
    assert few == many


def test_ids_of_any_type_and_hot_lengths(spark):
    df = spark.range(3000).select(F.col("id").cast("short").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two").otherwise("three").alias("text"))
    out = packing.pack(packing.token_pieces(df, queries.WORD_BPE, capacity=8), 8, cell=16).collect()
    assert len(out) == 3000
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    at = {}
    for seq, offset, length in places:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= 8 and len(at) == -(-2000 // 2)  # three twos do not fit with two threes: 3 + 3 + 2 = 8
    counts = spark.createDataFrame([(7, k, 1 + k % 3) for k in range(100)], "length long, cell long, n long")
    got = {r["cell"]: r["before"] for r in sums_before(counts, ["length"], "cell", "n", span=8).collect()}
    assert got == {k: sum(1 + j % 3 for j in range(k)) for k in range(100)}
