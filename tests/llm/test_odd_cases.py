"""Hubs, repeated ids, short items, clashing columns and odd texts, each against brute force."""

import re

import numpy as np
import pytest

from skyframe.llm import components, decontaminate, line_dedup, simhash, topk


def brute_components(links):
    root = {x: x for pair in links for x in pair}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root if find(k) != k}


def test_hubs_change_nothing(spark):
    rng = np.random.default_rng(1)
    links = [(500, k) for k in range(501, 900)] + [(1000 + k, 499) for k in range(300)] + [(499, 2000), (2000, 500)]
    links += [tuple(map(int, rng.integers(3000, 3400, 2))) for _ in range(250)]
    df = spark.createDataFrame(links, "a long, b long")
    want = brute_components([x for x in links if x[0] != x[1]])
    for hub in (8, 10**9):
        assert {r["id"]: r["root"] for r in components.components(df, least_hub=hub).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_fingerprints_that_repeat_ids(spark):
    """An id with several fingerprints joins all that either of them is near to."""
    rng = np.random.default_rng(8)
    near = lambda fp: fp ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    rows = [(3, base[0]), (5, base[0]), (5, base[1]), (9, base[1]), (9, None), (None, base[2])]
    rows += [(int(rng.integers(10, 90)), near(base[int(rng.integers(40))])) for _ in range(60)]
    rows = [(k, (base[3] if fp is None else fp)) for k, fp in rows]
    df = spark.createDataFrame([(k, fp.to_bytes(8, "little")) for k, fp in rows], "id long, fp binary")
    links = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and (x ^ y).bit_count() <= 3]
    prints = {}
    for k, fp in rows:
        prints.setdefault(k, []).append(fp)
    roots = brute_components(links)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["id"] is None else roots.get(r["id"], r["id"])), r["id"]
    assert roots[9] == 3 and sum(len(v) > 1 for v in prints.values()) > 5


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog tonight"), (2, "short one"), (3, "yes"), (4, None), (5, "..."), (6, ""), (1, "another text of the same item id, long enough"), (2, "short one")]


def brute_items(text):
    norm, out = decontaminate.normalise(text or ""), {}
    for k, t in ITEMS:
        item = decontaminate.normalise(t or "")
        if not item:
            continue
        if len(item) < 20:
            if re.search(rf"(^| ){item}( |$)", norm):
                out[k] = 0
        elif (x := edit_distance(item, norm)) <= int(0.08 * len(item)):
            out[k] = min(x, out.get(k, x))
    return out


def test_items_in_odd_documents(spark):
    fox = ITEMS[0][1]
    texts = [
        None, "", "   ", "yes", "Yes!", "yesterday", "a short one.", "shortone", "ashort one", "a sh0rt one", fox, fox[:-2], fox[2:], fox.replace("quick", "quikc"), "x " * 20_000 + fox.upper() + " yes",
        "another text of the same item id, long enough" + fox, fox[:30], "y" * 200_000,
    ]
    rows = [(k, t, "h", k, "g", "i") for k, t in enumerate(texts)] + [(3, "a short one", "h", 0, "g", "i"), (None, fox, "h", 0, "g", "i")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _hit string, distance int, gone string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {}
    for r in decontaminate.contaminated(docs, items).collect():
        assert (r["doc_id"], r["item_id"]) not in got  # a row per id and item
        got[r["doc_id"], r["item_id"]] = r["distance"]
    want = {}
    for k, t, *_ in rows:
        for i, d in brute_items(t).items():
            want[k, i] = min(d, want.get((k, i), d))
    assert got == want and (3, 2) in want and (3, 3) in want and (None, 1) in want
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {k for k, _ in want if k is not None}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)


def test_clashing_columns_of_near_duplicates(spark):
    rows = [(1, "a b c d e f g", "x", 1, "q"), (2, "a b c d e f g", "y", 2, "q"), (None, "a b c d e f g", "z", 3, "q"), (3, None, "w", 4, "q"), (4, "", "v", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, id int, gone string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    with pytest.raises(TypeError):
        simhash.fingerprints(docs, id_col="_gone")


def test_repeated_ids_and_long_vectors_in_top_k(spark):
    rows = [(0, [1.0, 0.0], "s", 1), (0, [0.0, 1.0], "s", 2), (1, [0.5, 0.5], "s", 3), (1, [0.5, 0.5], "s", 3), (2, [0.25] * 300, "s", 4), (3, [0.0, 0.0], "s", 5), (50, [-1.0, 1.0], "s", 6)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int"), "vec_id", "embedding", 256)
    vectors = [(k, np.pad(np.floor(256 * np.array(v)), (0, 300 - len(v)))) for k, v, *_ in rows]
    want = []
    for q in (0, 50):
        met = sorted((-int(a @ b), c) for i, a in vectors if i == q for c, b in vectors if c != q)[:3]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(met, 1)]
    got = topk.top_k(df.filter("id % 50 = 0"), df, 3, candidate_block=2, query_block=1).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_of_odd_texts(spark):
    line = "A line that very many hold, long enough"
    rows = [(k, f"{line}\nown {k}", "n", "d") for k in range(5)] + [(7, None, "n", "d"), (8, "", "n", "d"), (9, "\n\n", "n", "d"), (10, (line + "\n") * 20_000, "n", "d"), (3, f"{line.upper()}", "n", "d"), (None, line, "n", "d")]
    docs = spark.createDataFrame(rows, "doc_id smallint, text string, drops string, row string")
    got = sorted((str(r["doc_id"]), r["kept_text"], r["n_lines"], r["n_dropped"], r["row"]) for r in line_dedup.drop_repeated_lines(docs, keep=("doc_id", "row", "drops")).collect())
    want = []
    for k, t, _, d in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k in (None, 10) or x.strip().lower() != line.lower()]
        want.append((str(k), "\n".join(kept), len(lines), len(lines) - len(kept), d))
    assert got == sorted(want)
