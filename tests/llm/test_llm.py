"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import components, decontaminate, langid, line_dedup, ngram_lm, packing, quality, queries, quotes, simhash, topk, toxicity
from skyframe.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, fp string"
BLANK = r"[^\x20\x09-\x0d]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    line, para = "The same long boiler line here", " ".join(f"w{k} alpha beta" for k in range(400))
    rows = [(1, None), (2, ""), (3, "a"), (4, f"{line}\nown text one\n  {line.upper()} "), (5, f"{line}\nown two"), (6, f"own\n{line}\n{line}"), (7, para), (8, para), (8, para), (9, para + " tail"), (10, "x " * 30_000), (None, f"{line}\nz"), (11, "Ünïcode é  ünï <|endoftext|> \x00 x's, don't!!! 12.5")]
    return spark.createDataFrame([(i, t, None, "s", None, "q", 1, "f") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_round_trip(spark, docs, none):
    out = packing.pack_documents(docs, queries.WORD_BPE).collect()
    t, pieces = tokenizer(), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    for doc, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        ids = array("I", [*t.encode(text or "", add_special_tokens=False).ids, 0])
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        copies = 2 if doc == 8 else 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]) == sorted(want * copies)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, queries.WORD_BPE).count() == 0


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(3)
    for capacity in (16, 100):
        sizes = rng.integers(1, capacity + 1, 400)
        free = []
        for s in sorted(sizes, reverse=True):
            fits = [k for k, f in enumerate(free) if f >= s]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= s
            else:
                free.append(capacity - s)
        rules = packing.best_fit_rules(Counter(sizes.tolist()).items(), capacity)
        last = max(b + -(-(e - f) // c) for _, f, e, b, _, c in rules)
        assert last == len(free) and sum(e - f for _, f, e, *_ in rules) == len(sizes)


def test_word_encoder_equals_the_tokenizer(spark):
    t, encode = tokenizer(), packing.WordEncoder(queries.WORD_BPE)
    texts = [r["text"] or "" for r in table(spark, SF, "documents").limit(200).collect()]
    assert encode([x.encode() for x in texts]) == [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]


def test_line_dedup_equals_brute_force(spark, docs, none):
    found = {(r["doc_id"], r["text"]): r for r in docs.withColumn("k", F.lit(0)).collect()}
    out = line_dedup.drop_repeated_lines(docs).collect()
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for doc, text in found:
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= 20:
                holders[key(x)].add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = []
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if r["doc_id"] is None or gone.get(key(x), r["doc_id"]) == r["doc_id"]]
        want.append((str(r["doc_id"]), "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((str(r["doc_id"]), r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out) == sorted(want)
    assert line_dedup.drop_repeated_lines(none).count() == 0


def fingerprint(text, n=3):
    w = re.findall(BLANK, lower(text or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, docs, none):
    some = table(spark, SF, "documents").filter("doc_id < 300").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    prints = {(r["doc_id"], fingerprint(r["text"])) for r in some.collect()}
    root = {i: i for i, _ in prints if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    held = sorted((i, f) for i, f in prints if i is not None)
    for a, fa in held:
        for b, fb in held:
            if (fa ^ fb).bit_count() <= 3 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    out = simhash.near_duplicates(simhash.fingerprints(some)).select("id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert {(r["id"], int(r["f"], 16)) for r in out} == prints
    assert all(r["component_id"] == (top(r["id"]) if r["id"] is not None else None) for r in out)
    assert simhash.near_duplicates(simhash.fingerprints(none)).count() == 0
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert 7 in kept and 8 not in kept and 9 not in kept and None in kept


def test_hot_buckets_keep_every_link(spark):
    rng = np.random.default_rng(5)
    base = [0] * 150 + [int(x) for x in rng.integers(0, 2**63, 5)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)) for b in base for _ in range(4)})
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "little"))) for i, f in enumerate(prints)], "id long, fp binary")
    whole, cut = (components.components(simhash.links(df, 3, 3, (4,), block=b, most_hot=h)).collect() for b, h in ((10_000, 10), (16, 0)))
    assert sorted(whole) == sorted(cut) and whole


def test_thresholds_keep_the_pigeonhole_sum():
    sample = np.random.default_rng(2).integers(0, 2**63, (500, 1), dtype=np.int64).view(np.uint64)
    for n in (10**3, 10**7, 10**10):
        parts = simhash.plan(sample, n, 3, (3, 4, 5))
        assert sorted(b for p, _ in parts for b in p) == sorted({b for p, _ in parts for b in p})
    parts = simhash.plan(sample, 10**4, 3, (4,))
    assert sum(t + 1 for _, t in parts) == 4


def test_one_of_each_equals_brute_force(spark, none):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(words, 60 + 5 * int(rng.integers(40))))
        texts.append(base)
        for share in (0.005, 0.01, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts.append([str(rng.choice(words)) if rng.random() < share else w for w in base])
        texts.append(base + base[:20] * 30)  # repeats of shingles do not count
    texts += [base[:5], base[:6], [*base[:6], "z"], ["a"], ["a"], [], []]
    ids = rng.permutation(len(texts)).tolist()
    sets = [{" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in texts]
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
            near += 0.6 <= len(a & b) / max(1, len(a | b)) < 0.8
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in zip(ids, texts, strict=True)] + [(None, "a")], "doc_id long, text string")
    got = [r["doc_id"] for r in simhash.one_of_each(df).collect()]
    assert near > 50 and sorted(k for k in got if k is not None) == sorted(k for k in ids if find(k) == k) and got.count(None) == 1
    assert simhash.one_of_each(none).count() == 0
    group = df.filter("doc_id IS NOT NULL").select("doc_id", F.lit(0).alias("root")).toDF("id", "root")
    cut = components.components(simhash.verified(df.toDF("id", "text"), group, 5, block=50))  # hot groups are cut into blocks
    assert {r["id"] for r in cut.collect()} == {k for k, t in zip(ids, texts, strict=True) if t and find(k) != k}


def test_one_of_each_looks_in_partitions_of_fingerprints(spark, monkeypatch):
    """Sets of five and four shingles at a similarity of 0.8 differ in the most bits; their thresholds come from `plan_share`."""
    seen, sign = [], simhash._sign
    monkeypatch.setattr(simhash, "_sign", lambda parts, *a: seen.append(parts) or sign(parts, *a))
    rows = [(2 * n + k, " ".join(f"{n}w{i}" for i in range(9 - k))) for n in range(1500) for k in (0, 1)]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(seen) == 1 and len(seen[0]) > 10 and all(2 * n in kept for n in range(1500))
    assert sum(2 * n + 1 in kept for n in range(1500)) <= 7


def test_thresholds_keep_the_chance_to_miss():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 2**63, (600, 36), dtype=np.int64).view(np.uint64)
    chance = lambda parts: np.prod([1 - sum(comb(len(p), j) * 0.1875**j * 0.8125 ** (len(p) - j) for j in range(t + 1)) for p, t in parts])
    for n in (10**2, 10**5, 10**9):
        assert 1e-5 < chance(simhash.plan_share(sample, n, 0.1875, 1e-3, tuple(range(6, 15)))) <= 1e-3
    assert {t for _, t in simhash.plan_share(sample[:, :8], 10**4, 0.1875, 1e-3, (14,))} == {0, 1}  # too few bits for equality alone
    crowded = sample.copy()
    crowded[:, :10] = 0
    parts = simhash.plan_share(crowded, 10**6, 0.1875, 1e-3, (10,))
    assert min(b for p, _ in parts for b in p) >= 630 and chance(parts) <= 1e-3  # bits that all share are not looked at


def test_components_of_a_path(spark):
    path = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["root"] for r in components.components(path).collect()} == {0}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 256 * rng.integers(0, 2)]) for k in range(60)] + [(60, None), (61, [None] * 6), (62, [float("nan")] * 6), (63, [float("inf")] * 6), (64, [0.5]), (5, [0.0] * 6)]
    df = topk.quantised(spark.createDataFrame(v, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    rows = [(k, np.floor(256 * np.array(x + [0.0] * (6 - len(x))))) for k, x in v if x and None not in x and np.isfinite(x).all()]
    want = []
    for q, a in rows:
        if q % 10 == 0:
            best = sorted((-int(a @ b), c) for c, b in rows if c != q)[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = topk.top_k(df.filter("id % 10 = 0"), df, 5, candidate_block=16, query_block=4).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontamination_equals_brute_force(spark, docs, none):
    rng = np.random.default_rng(6)
    items = [(k, " ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(12))) for k in range(6)] + [(6, None), (7, "short"), (0, "x" * 30)]
    texts = []
    for n in range(40):
        t = list(items[n % 6][1])
        for _ in range(n // 5):
            t[rng.integers(len(t))] = rng.choice(list("ab, "))
        texts.append((n, "lead in text " + "".join(t).title() + ". and more"))
    df, it = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    norm = decontaminate.normalise
    want = {}
    for d, t in texts:
        for i, s in items:
            if s and len(norm(s)) >= 20 and (x := edit_distance(norm(s), norm(t))) <= int(0.08 * len(norm(s))):
                want[d, i] = min(x, want.get((d, i), 99))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(df, it, block_chars=100).collect()}
    assert got == want and 10 < len(want) < 40
    assert decontaminate.without_contaminated(docs, it.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(none, it).count() == 0


def test_quotes_link_and_leave(spark):
    rows = [(1, 0, "user", "Hello   there\nsecond line"), (1, 1, "bot", "> hello there\n> second line\nmy answer"), (1, 2, "user", ">> hello there\n> my answer\nthanks"), (1, 3, "bot", "> never said\nok"), (2, 0, "user", None), (None, 0, "user", "> a"), (1, 3, "bot", "> never said\nok")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert len(got) == 6 and out.count() == 6
    assert got[1, 1]["text"] == "my answer" and got[1, 1]["parent_turn"] == 0
    assert got[1, 2]["text"] == "thanks" and got[1, 2]["parent_turn"] == 1 and got[1, 2]["n_linked"] == 2 and got[1, 2]["max_depth"] == 2
    assert got[1, 3]["parent_turn"] is None and got[1, 3]["n_passages"] == 1 and got[2, 0]["text"] == ""
    chat = quotes.chats(quotes.reply_order(out.filter("conv_id = 1"))).first()["messages"]
    assert [m["content"] for m in chat] == ["Hello   there\nsecond line", "my answer", "thanks", "ok"]
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def held_out_accuracy(rows, column):
    held = [r for r in rows if r["held_out"] and r[column] is not None]
    return sum(r["predicted"] == r[column] for r in held) / len(held)


@pytest.mark.parametrize("f, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers(spark, docs, none, f, label):
    labels = table(spark, SF, "labels")
    scored = f(table(spark, SF, "documents"), labels)
    rows = scored.join(labels, "doc_id").collect()
    assert held_out_accuracy(rows, label) >= 0.9
    odd = f(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert f(none, labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in f(docs, labels.limit(0)).collect())


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    h = toxicity.HIDDEN
    p = {"att": rng.normal(size=(2 * h, h)), "att_v": rng.normal(size=h), "out": rng.normal(size=2 * h), "bias": np.zeros(())}
    for d in "fb":
        p |= {"w" + d: rng.normal(size=(toxicity.INPUTS, 3 * h)) * 0.3, "u" + d: rng.normal(size=(h, 3 * h)) * 0.3, "c" + d: np.zeros(3 * h)}
    x, y = rng.normal(size=(3, 5, toxicity.INPUTS)), np.array([0, 1, 1])
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    loss = lambda: np.mean(np.log1p(np.exp(z := toxicity._logits(p, x, mask))) - y * z)
    g = toxicity._train_step(p, x, mask, y, np.ones(3))
    for k in ("wf", "ub", "att", "att_v", "out", "cb"):
        at = tuple(rng.integers(s) for s in p[k].shape)
        old, eps = p[k][at], 1e-3
        p[k][at] = old + eps
        up = loss()
        p[k][at] = old - eps
        down = loss()
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3)


def test_chunks_cover_the_text():
    for n in (0, 1, 8, 512, 513, 960, 5000):
        cut = quality.chunks(bytes(range(256)) * 20 if n == 5000 else b"a" * n)
        assert sum(len(c) for c in cut) - 64 * (len(cut) - 1) == max(8, n if n != 5000 else 5120)


def test_filters_start_at_every_byte():
    for n in (8, 9, 20, 1000):
        cut = quality.chunks(bytes(n))
        begins = [sum(len(c) for c in cut[:k]) for k in range(len(cut))]
        assert quality._layout(cut)[2].tolist() == [b + k for b, c in zip(begins, cut, strict=True) for k in range(len(c) - 7)]


def test_language_forward_equals_enumeration():
    vocabulary = langid._vocabulary(queries.PIECE_BPE)
    word, start, end, piece, _ = vocabulary.arcs(["▁la", "▁größe"])
    rng = np.random.default_rng(1)
    logp = np.log(rng.random((vocabulary.size, 2)))
    got = langid.log_scores(vocabulary, ["la", "größe"], logp)
    for k, n in ((0, 3), (1, 6)):
        arcs = defaultdict(list)
        for w, s, e, q in zip(word, start, end, piece, strict=True):
            if w == k:
                arcs[s].append((e, q))

        def total(at, k=k, n=n, arcs=arcs):
            return np.ones(2) if at == n else sum((np.exp(logp[q]) * total(e) for e, q in arcs[at]), np.zeros(2))

        assert got[k] == pytest.approx(np.log(total(0)))


def test_languages(spark, docs, none):
    d = table(spark, SF, "documents")
    rows = langid.languages(d, queries.PIECE_BPE).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert {r["lang_pred"] for r in langid.languages(docs, queries.PIECE_BPE).collect()} == {"und"}  # nothing to learn from
    model = langid.fit(d, queries.PIECE_BPE)
    odd = langid.identify(docs, model, queries.PIECE_BPE).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd}[1] == "und" and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.identify(none, model, queries.PIECE_BPE).count() == 0


def test_log_frequency_filter():
    rng = np.random.default_rng(2)
    keys, counts = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)), None
    counts = np.minimum(10**6, (1 / rng.random(len(keys))).astype(np.int64) + 1)
    bits, n = ngram_lm.build_bits(keys, counts)
    f = ngram_lm.LogFilter(bits.tobytes(), np.zeros(1, np.int64), np.array([n]))
    got, true = f.levels(keys), ngram_lm.level(counts)
    assert (got >= true).all() and (got == true).mean() > 0.9
    assert (f.levels(rng.integers(0, 2**63, 100_000).astype(np.uint64)) > 0).mean() < 4 * ngram_lm.FALSE_FIRST


def test_lm_base_is_exact_and_the_model_better(spark, docs, none):
    d = table(spark, SF, "documents").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text").filter("doc_id IS NOT NULL").distinct())
    rows = {r["doc_id"]: r["text"] for r in d.collect()}
    tokens = {k: [*re.findall(BLANK, lower(t or "")), None] for k, t in rows.items()}
    c = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    out = ngram_lm.score(d, d.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1), head=500).collect()
    for r in out:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert ngram_lm.score(none, none).count() == 0 and ngram_lm.score(docs, none).count() == docs.count()


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    whole = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, whole, SF)
        assert out.columns == whole.columns and 0 < out.count() <= whole.count()
        odd = stage(spark, docs, SF)
        assert odd.columns == docs.columns
    lines = corpus_pipeline.drop_lines(spark, whole, SF)
    assert lines.count() == whole.count() and lines.filter("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.pack(spark, docs, SF).count() >= docs.count()


def test_queries_return_the_contracts_columns(spark):
    want = {
        "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op2_toxicity": "doc_id held_out score predicted", "op4_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op7_language_id": "doc_id held_out lang_pred score", "op8_simhash_near_dedup": "doc_id fingerprint component_id", "op9_exact_top_k": "query_id rank vec_id score",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, SF).columns), name
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
