"""The whole pipeline on a small corpus against plain Python, stage by stage as run() goes."""

import re
import zlib
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import decontaminate, queries, toxicity
from skyframe.llm.common import table

SF = "/root/testdata/sf0.01"
LINE = "This notice is part of every page of the archive."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some given documents; exact and near copies, a shared line, benchmark passages; null, empty and long texts; repeated ids; a null id."""
    root = str(tmp_path_factory.mktemp("corpus"))
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(170).collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").orderBy("item_id").limit(8).collect()]
    plain = [t for _, t in given if t and len(t) > 900][:6]
    swap = lambda t, k: " ".join("changed" if n == k else w for n, w in enumerate(t.split(" ")))
    last = max(i for i, _ in given)
    more = [(1_000_000 + k, plain[0]) for k in range(3)] + [(1_000_010 + k, swap(plain[1], 9 * k + 4)) for k in range(3)] + [(1_000_020 + k, f"{plain[2 + k % 2][:40]} {k}\n{LINE}\nwords of page {k}") for k in range(6)]
    more += [(1_000_030 + k, f"{plain[4][: 300 + k]} {k}\n{t[: len(t) // 2].upper()}{t[len(t) // 2 :]}\nthe end of {k}") for k, (_, t) in enumerate(items[:3])]
    more += [(1_000_040, None), (1_000_041, ""), (1_000_042, "far " * 30_000 + "end"), (1_000_043, "one page twice"), (1_000_043, "one page twice"), (None, plain[5] + " without an id"), (None, plain[5] + " without an id")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in given + more], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("gone", F.lit("x")).withColumn("id", F.lit("y")).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    table(spark, SF, "labels").filter(F.col("doc_id") <= last).write.parquet(f"{root}/labels.parquet")
    return root


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_toxic(spark, root, docs):
    score = toxicity.Scorer(toxicity.learn(table(spark, root, "documents"), table(spark, root, "labels")))
    return [r for r, s in zip(docs, score([(t or "").encode() for _, t in docs]), strict=True) if s < 0.5]


def without_lines(docs):
    key, holders = (lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))), defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders[key(x)].add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or keeper.get(key(x), i) == i)) for i, t in docs]


def one_of_each(docs):
    sets = defaultdict(list)
    for i, t in docs:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
            sets[i].append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    rows = [(i, s) for i, held in sets.items() for s in held]
    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(i, t) for i, t in docs if i is None or find(i) == i]


def without_items(docs, items):
    norm = decontaminate.normalise
    wanted = [norm(t) for _, t in items]
    bad = {i for i, t in docs for w in wanted if i is not None and decontaminate.least_distance(w, norm(t)) <= int(0.08 * len(w))}
    return [(i, t) for i, t in docs if i not in bad]


def pieces(docs):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(queries.WORD_BPE), []
    for i, text in docs:
        ids = array("I", [*t.encode(text, add_special_tokens=False).ids, 0])
        out += [(str(i), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return out


def fewest_bins(lengths):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(2048 - n)
    return len(free)


def test_run_equals_plain_python(spark, corpus):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, corpus, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, corpus, "benchmark").collect()]
    stages = [without_toxic(spark, corpus, docs)]
    stages.append(without_lines(stages[-1]))
    stages.append(one_of_each(stages[-1]))
    stages.append(without_items(stages[-1], items))
    at, columns = table(spark, corpus, "documents"), table(spark, corpus, "documents").columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages, strict=False):
        at = corpus_pipeline.staged(stage(spark, at, corpus), name)
        assert at.columns == columns, name
        assert sorted(str((r["doc_id"], r["text"] or "")) for r in at.collect()) == sorted(str((i, t or "")) for i, t in want), name
    sizes = [len(docs), *map(len, stages)]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] and not {1_000_030, 1_000_031, 1_000_032} & {i for i, _ in stages[3]}
    out = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(pieces(stages[3]))
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= 2048
    assert len(bins) == fewest_bins([r["length"] for r in out])


def test_near_copies_are_found_by_similarity(spark):
    """Planted copies by share of changed words: of pairs of 0.8 or more all but one of a hundred at most are found, under 0.8 none."""
    import numpy as np

    from skyframe.llm import simhash

    rng, words, rows, kinds = np.random.default_rng(12), [f"v{k}" for k in range(20_000)], [], {}
    for n in range(400):
        base = [str(w) for w in rng.choice(words, 120)]
        copy = [str(rng.choice(words)) if rng.random() < (0.005, 0.015, 0.022, 0.035)[n % 4] else w for w in base]
        a, b = ({" ".join(t[k : k + 5]) for k in range(116)} for t in (base, copy))
        kinds[n] = len(a & b) / len(a | b)
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [2 * n + 1 not in kept for n, s in kinds.items() if s >= 0.8]
    assert len(near) > 150 and sum(near) / len(near) >= 0.99
    assert all(2 * n + 1 in kept for n, s in kinds.items() if s < 0.8) and all(2 * n in kept for n in kinds)
