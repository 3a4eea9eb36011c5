"""The operators against brute force, exact round trips and held-out accuracy, on small inputs with every awkward case."""

import random

import numpy as np
import pytest

from strandloom.llm import chat, decontamination, jaccard, langid, mixing, recompression, sharding, suffixes, topk, toxicity
from strandloom.llm.boosting import Isotonic, Trees
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, score double"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, runs of a word, short, empty and null texts."""
    rng = random.Random(5)
    base, passage = words(rng, 160), words(rng, 70)
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(12)]
    texts += [" ".join(base)] * 3
    for i in range(6):
        w = list(base)
        w[10 * i + 3] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, 30) + passage + words(rng, 30)) for _ in range(4)]
    texts += ["same " * 300, "same " * 260, "a b " * 100, "x", "x", "", None, " \t\n", "Ünïcödé " * 60, "Tail " + "Ünïcödé " * 60]
    texts.append(" ".join(words(rng, 4000)))
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, sources=("a", "b", None)):
    return spark.createDataFrame([(d, t, "en", sources[i % len(sources)], len(t or ""), "k", 1, 0.5) for i, (d, t) in enumerate(rows)], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_suffix_arrays_match_brute_force(spark):
    rows = corpus()
    out = suffixes.substring_dedup(frame(spark, rows).repartition(3))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(rows))


def test_recompression_matches_brute_force(spark):
    rows = corpus()
    out = recompression.substring_dedup(frame(spark, rows).repartition(3))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op5(rows))


def test_recompression_takes_every_repeat_of_a_passage_held_in_part_before(spark):
    rng = random.Random(23)
    rows = []
    for i in range(0, 60, 10):
        p = words(rng, 200)
        twice = p + words(rng, 20) + p + words(rng, 20) + p[30:170]
        rows += [(i + 3, " ".join(p[:120])), (i + 5, " ".join(twice)), (i + 6, " ".join(words(rng, 9) + p + p)), (i + 7, " ".join(p[100:]))]
    rows.append((5, rows[1][1] + " another text of the same id"))
    out = recompression.substring_dedup(frame(spark, rows).repartition(3))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op5(rows))


def test_recompression_anchors_follow_content_alone():
    rng = np.random.default_rng(1)
    window = rng.integers(0, 5, 50).astype(np.uint64)
    seen = set()
    for _ in range(40):
        left, right = rng.integers(0, 5, 30).astype(np.uint64), rng.integers(0, 5, 30).astype(np.uint64)
        values = np.concatenate([left, window, right])
        at, key = recompression.anchors(values, np.array([0, len(values)]), np.array([30]))
        seen.add((int(at[0]) - 30, int(key[0])))
    assert len(seen) == 1


def test_jaccard_join_matches_brute_force(spark):
    rows = corpus()
    for n, num in ((3, 90), (5, 80)):
        out = jaccard.jaccard_components(frame(spark, rows).repartition(3), n, num, 100)
        assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute.op9(rows, n, (num, 100)))


def test_part_keys_lose_no_pair():
    rng = np.random.default_rng(2)
    classes = jaccard.Classes(80, 100, 500)
    for size in (1, 2, 3, 5, 9, 20, 60, 300):
        for _ in range(20):
            a = set(rng.integers(0, 1 << 40, size).tolist())
            b = set(list(a)[: max(1, int(size * rng.uniform(0.75, 1)))]) | set(rng.integers(0, 1 << 40, int(rng.integers(0, 1 + size // 6))).tolist())
            if 100 * len(a & b) < 80 * len(a | b):
                continue
            keys = []
            for s in (a, b):
                token = np.sort(np.array(list(s), np.uint64))
                first = np.array([0, len(token)])
                keys.append({int(k) for below in (0, 1) for k in jaccard.part_keys(first, token, classes, below)[1]})
            assert keys[0] & keys[1]


def test_dual_traversal_keeps_every_possible_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for i in range(60):
        extra = rng.integers(0, 1 << 60, int(rng.integers(0, 12))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([base[: 80 - i % 15], extra])))
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    bits = jaccard._folded([b.tobytes() for b in jaccard._bitmaps(first, np.concatenate(sets))])
    tree = jaccard.Tree(np.array([len(s) for s in sets]), bits, np.arange(60))
    i, j = jaccard.dual_traversal(tree, None, 90, 100)
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(60):
        for b in range(a + 1, 60):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert frozenset((a, b)) in found


def test_keep_one_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, rows)).select("doc_id").collect()}
    groups = {}
    for d, n, c in brute.op9(rows, 5, (80, 100)):
        groups.setdefault(c if n else d, []).append(d)
    assert kept == {min(v) for v in groups.values()}


def test_chat_round_trip_and_folding(spark):
    ugly = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "<\\|x|> [\\INST]", "\\", "<\\\\s>", "plain", "", None]
    rows = [(c, t, ("user", "assistant", "sys\ntem", "r\\n", None)[t % 5], ugly[(c + t) % len(ugly)]) for c in range(8) for t in range(6)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    back = {r.conv_id: r.turns for r in chat.read_back(chat.render(messages)).collect()}
    for c in range(8):
        want = [(r or "", t or "", (r or "") == "assistant") for k, _, r, t in rows if k == c]
        assert [tuple(x) for x in back[c]] == want
    rendered = chat.render(messages).collect()
    for r in rendered:
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(r.loss_mask)
    log = [(1, 0, 1, "message", "assistant", "Hel"), (1, 0, 2, "delta", "assistant", "lo"), (1, 0, 3, "regenerate", "assistant", ""), (1, 0, 4, "delta", "assistant", "A"), (1, 0, 5, "delta", "assistant", "B"), (1, 1, 6, "message", "user", "x"), (1, 1, 7, "edit", "user", "y"), (1, 2, None, None, None, None)]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert got(folded, "message", "role", "text") == [(0, "assistant", "AB"), (1, "user", "y"), (2, "", "")]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.5, 1, 4])]) for i in range(300)]
    rows += [(300, [0.0] * 8), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (350, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (400, [1.0, 2.0])]
    out = got(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "query_id", "rank", "vec_id", "score")
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and not any(np.isnan(v)):
            whole[i] = [int(np.floor(256 * x)) for x in v]
    want = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert out == sorted(want)


def test_search_prunes_by_bound_without_losing_the_top():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(500, 6)))
    v = v[np.argsort(-np.sqrt((v * v).sum(1)))]
    q = np.floor(256 * rng.normal(size=(20, 6)))
    all_scores = topk.products(q, v)
    kth = np.sort(all_scores, axis=1)[:, -5].astype(float)
    a, b, c = topk.search_block(np.arange(1000, 1020), q, kth, np.arange(500), v, 5)
    assert [x.tolist() for x in c] and sorted(np.concatenate(c).tolist()) == sorted(np.sort(all_scores, axis=1)[:, -5:].ravel().tolist())


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60))) for i in range(3000)] + [(None, "a b c"), (None, "a b c"), (5, "again")]
    docs = frame(spark, rows, sources=("s1", "s0", None, "s2"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        x = by.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 60 and target <= 2 * size + 1e-6
    assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(x[2] for x in by.values())) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in out)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_targets_refill_to_the_limit():
    out = mixing.fill_targets([("b", 10), (None, 100), ("a", 1000)])
    assert [s for s, _, _ in out] == ["a", "b", None]
    assert dict((s, t) for s, _, t in out)["b"] == 20.0
    assert abs(sum(t for *_, t in out) - 1.5 * 1110) < 1e-9
    assert mixing.fill_targets([("a", 0)]) == [("a", 0, 0.0)] and mixing.fill_targets([]) == []


def test_sharding_compacts_and_keeps_every_row(spark, tmp_path):
    docs = frame(spark, corpus())
    rows = sharding.shard(docs, f"file://{tmp_path}/store", arrivals=8, target=1 << 12, smallest=1 << 10).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in corpus())
    store = sharding.Store(spark, f"file://{tmp_path}/store", docs.schema)
    manifest = store.manifest()
    tiers = [sharding.tier(sharding.size_of(r), sharding.FANOUT, 1 << 10) for r in manifest["runs"]]
    assert all(tiers.count(t) < sharding.FANOUT for t in tiers) and manifest["version"] == rows[0].version
    assert sorted(map(str, store.read(manifest["runs"]).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(RuntimeError):
        store.commit({"version": manifest["version"] - 1}, [])


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(11)
    make = {"aa": "ab ba aab bab abba", "bb": "xy yz zyx xxy yzz"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) for _ in range(40)), lang) for i in range(400) for lang in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "aa"), (1002, "", None), (None, "ab ba", "aa"), (1004, "ab ba aab " * 1500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(docs, ["doc_id", "lang"]).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert held and all(r.lang_pred == r.lang for r in held)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_kneser_ney_probabilities_sum_to_one():
    texts = ["abab abc", "cab bab"]
    keys, _ = langid.keys_of(texts)
    found, n = np.unique(keys, return_counts=True)
    model = langid.Model(["x"], np.zeros(len(found), int), found, n)
    letters = np.unique(found & ((1 << langid.BITS) - 1))
    for context in np.unique(found >> langid.BITS)[:10]:
        p = np.exp(model._log((context << langid.BITS) | letters, langid.ORDER)).sum()
        assert 0.5 < p <= 1.001  # the rest is kept for letters never seen


def test_language_model_keeps_every_count(spark):
    rng = np.random.default_rng(37)
    texts = [("aa" if i % 3 else "bb", "".join(map(chr, rng.integers(97, 123, 3000) - (i % 3 == 0) * rng.integers(0, 2) * 32)) + " rare ab") for i in range(120)]
    made = langid.fit(spark.createDataFrame(texts, "lang string, text string"))
    lang, key, n = [], [], []
    for i, x in enumerate(("aa", "bb")):
        found, times = np.unique(langid.keys_of([t for y, t in texts if y == x])[0], return_counts=True)
        lang, key, n = [*lang, np.full(len(found), i)], [*key, found], [*n, times]
    whole = langid.Model(["aa", "bb"], *map(np.concatenate, (lang, key, n)))
    assert len(whole.tables[-1][0]) > 1 << 18 and made.langs == whole.langs and np.isclose(made.floor, whole.floor)
    for a, b in zip([*made.tables, *made.weights], [*whole.tables, *whole.weights], strict=True):
        assert (a[0] == b[0]).all() and np.allclose(a[1], b[1], atol=1e-4)


def test_toxicity_separates_held_out_rows(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        w = words(rng, 60)
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["idiot", "vilewort", "vileword"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "you idiot")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert sum((r.doc_id % 6 == 0) == bool(r.predicted) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(rows)
    none = toxicity.score(docs, toxicity.learn(docs, marks.where("toxic = 0")))
    assert {r.score for r in none.collect()} == {0.0}


def test_toxicity_keeps_the_share_of_the_labels_when_it_samples(spark):
    rng = random.Random(29)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 12))) for i in range(4500)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(4500)], "doc_id long, quality int, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.learn(docs, marks, sample=250)).collect()]
    assert abs(sum(scores) / len(scores) - 0.1) < 0.05


def test_trees_and_isotonic_steps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = Trees(trees=60, depth=3).fit(x, y, np.ones(2000)).raw(x)
    assert ((raw > 0) == (y > 0.5)).mean() > 0.95
    p = Isotonic(raw, y, np.ones(2000))(np.sort(raw))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(17)
    items = [(i, " ".join(words(rng, 40))) for i in range(6)] + [(7, None), (None, "a b c d"), (8, "x y")]
    plant = lambda w, edits: [("zz" if k in edits else x) for k, x in enumerate(w)]
    docs = [(i, " ".join(words(rng, 120))) for i in range(40)]
    docs.append((100, " ".join(words(rng, 50) + items[0][1].split() + words(rng, 50))))
    docs.append((101, " ".join(words(rng, 50) + plant(items[1][1].split(), {5, 13, 22, 31}) + words(rng, 50))))
    docs.append((102, items[2][1].upper().replace(" ", ", ")))
    docs += [(103, None), (104, ""), (105, "x y"), (100, docs[0][1])]
    out = decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(100, 0), (101, 1), (102, 2)}
    kept = decontamination.keep_clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == len(docs) - 3 and kept.where("doc_id = 100").count() == 1


def test_decontamination_finds_many_edited_copies_beside_a_verbatim_one(spark):
    rng = random.Random(31)
    item, short = [f"q{i}" for i in range(40)], [f"r{i}" for i in range(15)]
    edited = [f"edit{k}" if k % 5 == 4 else x for k, x in enumerate(item)]
    docs = [(i, " ".join(words(rng, 20) + edited + words(rng, 20))) for i in range(60)]
    docs += [(100 + i, " ".join(words(rng, 20) + [*short[:11], "new", *short[12:]] + words(rng, 20))) for i in range(60)]
    docs += [(200, " ".join(words(rng, 20) + item)), (201, " ".join(words(rng, 20) + short)), (202, " ".join(words(rng, 20) + item[:3] + words(rng, 20)))]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short))], "item_id long, text string")
    out = decontamination.contaminated(frame(spark, docs), benchmark)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, 0) for i in (*range(60), 200)} | {(i, 1) for i in (*range(100, 160), 201)}


def test_smith_waterman_against_the_plain_recurrence():
    rng = np.random.default_rng(8)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, _ = decontamination.smith_waterman([a, a[:1]], [b, b])
        assert score[0] == h.max()


def test_empty_tables(spark):
    docs = frame(spark, corpus()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (
        suffixes.substring_dedup(docs), recompression.substring_dedup(docs), jaccard.jaccard_components(docs), jaccard.keep_one(docs), mixing.mix(docs), mixing.apply_mix(docs), langid.identify(docs, ["doc_id"]),
        toxicity.score(docs, toxicity.learn(docs, labels)), decontamination.contaminated(docs, benchmark), decontamination.contaminated(frame(spark, corpus()), benchmark), decontamination.keep_clean(docs, benchmark),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")), sharding.shard(docs), chat.render(spark.createDataFrame([], "conv_id long, message long, role string, text string")),
    ):
        assert df.count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a " * 300), (1, "a " * 300), (None, "b " * 300), (None, "b " * 300), (2, "c d"), (2, "e f g h")]
    docs = frame(spark, rows)
    one = {(r.doc_id, r.n_removed > 0) for r in suffixes.substring_dedup(docs).collect()}
    assert (1, True) in one and (None, True) in one and suffixes.substring_dedup(docs).count() == 6
    five = recompression.substring_dedup(docs).collect()
    assert len(five) == 6 and not any(r.n_removed for r in five)
    nine = jaccard.jaccard_components(docs).collect()
    assert len(nine) == 6 and all(r.component_id == r.doc_id for r in nine)
    assert jaccard.keep_one(docs).count() == 4  # one of the repeated row, one of doc 2, both rows without an id


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 80)), "en", f"s{i % 3}", 10) for i in range(60)]
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows + [(100, rows[0][1], "en", "s0", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words(rng, 30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("doc_id = 100").count() == 0
    assert corpus_pipeline.run(spark, path).count() > 0




def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_patterned_words_are_told_apart(spark):
    a, b = thue_morse(2048)
    rest = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, b), (3, f"{a} {rest}"), (4, f"{b} {rest[3:]}"), (5, " ".join(a)), (6, " ".join(b)), (7, f"{a} {rest}")]
    docs = frame(spark, rows)
    assert got(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op9(rows))
    assert got(recompression.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op5(rows))
    assert got(suffixes.substring_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(rows))
    items = spark.createDataFrame([(0, f"{a} {a} {b} {a}")], "item_id long, text string")
    hit = spark.createDataFrame([(1, f"{b} {b} {a} {b}"), (2, f"{a} {a} {b} {a}")], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(hit, items).collect()} == {2}


def near_group(rng, m, n=100, edits=9):
    """Near copies around a text that isn't there: few link with any one of them."""
    base = words(rng, n)
    out = []
    for _ in range(m):
        w = list(base)
        for k in rng.sample(range(n), rng.randint(1, edits)):
            w[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_group_of_near_copies_without_a_common_pivot(spark, monkeypatch):
    rng = random.Random(41)
    texts = near_group(rng, 150, edits=4) + near_group(rng, 80, n=60, edits=5) + near_group(rng, 40, edits=2)
    texts += texts[:5]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    for n, num in ((3, 90), (5, 80)):
        out = jaccard.jaccard_components(frame(spark, rows).repartition(3), n, num, 100)
        assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute.op9(rows, n, (num, 100)))


def test_a_block_gives_no_more_links_than_tie_its_components():
    import pyarrow as pa

    rng = np.random.default_rng(43)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.sort(np.delete(base, rng.choice(100, 3, replace=False))).view(np.int64) for _ in range(60)]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    bits = jaccard._bitmaps(first, np.concatenate(sets).view(np.uint64))
    for sides in ([0] * 60, [0] * 20 + [1] * 40):
        rows = pa.table({"side": sides, "node": list(range(60)), "n": [len(s) for s in sets], "component": [i // 2 for i in range(60)], "tokens": [s.tolist() for s in sets], "bitmap": [b.tobytes() for b in bits]})
        out = jaccard._links_of_block(90, 100)(rows)
        assert len(out) == 29


def fold_by_hand(log):
    """Final (role, text) by (conversation, message) of rows (conv_id, message, seq, kind, role, text)."""
    out = {}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in (x[2], x[3] or "message", x[4], x[5] or ""))
    for conv, message, _, kind, role, text in sorted(log, key=key):
        now = out.setdefault((conv, message), ["", ""])
        now[1] = now[1] + (text or "") if kind == "delta" else (text or "")
        now[0] = role if role is not None else now[0]
    return sorted((c, m, r, t) for (c, m), (r, t) in out.items())


def test_folding_random_logs(spark):
    rng = random.Random(47)
    log = [(rng.randint(0, 9), rng.randint(0, 3), rng.choice([None, *range(12)]), rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "unknown", None]), rng.choice([None, None, "user", "assistant"]), rng.choice(["a", "b ", "", None, "<|x|>"])) for _ in range(600)]
    log += [(50, 0, 1, "message", "assistant", ""), (50, 0, 2, "delta", None, "Hel"), (50, 0, 3, "delta", None, "lo")]
    schema = "conv_id long, message long, seq long, kind string, role string, text string"
    folded = chat.fold_events(spark.createDataFrame(log, schema).repartition(4))
    assert got(folded, "conv_id", "message", "role", "text") == fold_by_hand(log)
    assert (50, 0, "assistant", "Hello") in fold_by_hand(log)
    assert chat.fold_events(spark.createDataFrame([], schema)).count() == 0


def test_a_dead_writers_claim_lapses_and_old_shards_go_by_age(spark, tmp_path):
    docs = frame(spark, corpus())
    store = sharding.Store(spark, f"file://{tmp_path}/store", docs.schema)
    store.append(docs)
    claim = tmp_path / "store/manifests/v00000002.claim"
    claim.touch()  # a writer died before it published
    with pytest.raises(RuntimeError):
        store.append(docs)
    assert store.manifest()["version"] == 1
    again = sharding.Store(spark, store.root, docs.schema, lease=0)
    assert again.append(docs)["version"] == 2 and store.read(store.manifest()["runs"]).count() == 2 * docs.count()
    assert store.sweep() == 0  # what the failed append wrote is young
    gone = store.sweep(retain=0)
    assert gone > 0 and store.read(store.manifest()["runs"]).count() == 2 * docs.count()


def test_sharding_arrivals_one_after_the_other(spark, tmp_path):
    docs = frame(spark, corpus())
    store = sharding.Store(spark, f"file://{tmp_path}/store", docs.schema)
    for i in range(9):
        store.append(docs.where(f"pmod(doc_id, 9) = {i}").coalesce(1))
        store.compact(fanout=2, target=1 << 30, smallest=1)
    tiers = [sharding.tier(sharding.size_of(r), 2, 1) for r in store.manifest()["runs"]]
    assert len(set(tiers)) == len(tiers) and sorted(map(str, store.read(store.manifest()["runs"]).collect())) == sorted(map(str, docs.collect()))


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(53)
    names = ["nth", "copy", "plan", "score", "entropy", "rejected", "mark", "row", "size", "leak_mark", "jaccard_copy", "carried_0"]
    texts = [" ".join(words(rng, 30)) for _ in range(40)]
    rows = [(i if i % 9 else None, texts[i % 40], "en", f"s{i % 3}", 1, *range(i, i + len(names))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    benchmark = spark.createDataFrame([(0, texts[5])], "item_id long, text string")
    whole = {tuple(r) for r in docs.collect()}
    for out in (langid.keep_identified(docs), jaccard.keep_one(docs, 5, 80, 100), decontamination.keep_clean(docs, benchmark), mixing.apply_mix(docs)):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= whole


def test_mixing_gives_repeated_rows_their_copies_and_reruns_agree(spark):
    rows = [(1, "a b c d", "s0")] * 40 + [(None, "a b c", "s0")] * 30 + [(i, "x " * (i % 30), "s1") for i in range(200)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, tag long")
    chosen = mixing.mix(docs)
    assert chosen.count() == len(rows)
    want = {(r.doc_id, r.size): r.n for r in chosen.groupBy("doc_id", "size").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect() if r.n}
    first = sorted(map(str, mixing.apply_mix(docs).collect()))
    again = sorted(map(str, mixing.apply_mix(docs.repartition(5, "tag")).collect()))
    have = {}
    for r in mixing.apply_mix(docs).collect():
        k = (r.doc_id, len(r.text.split()))
        have[k] = have.get(k, 0) + 1
    assert first == again and have == want


def test_blocks_that_cannot_reach_the_bound_do_not_meet(spark):
    members = spark.createDataFrame([(2, 0, 50, 1.0), (2, 0, 100, 2.0), (2, 1, 150, 1.0)], "dim int, block long, vec_id long, norm double")
    blocks = spark.createDataFrame([(2, b, float(b)) for b in range(1, 11)], "dim int, block long, longest double")
    met = lambda bounds: topk.block_pairs(members, spark.createDataFrame(bounds, "query_id long, bound long"), blocks).groupBy("q_block").count()
    assert got(met([(50, 9), (100, 16), (150, 10)]), "q_block", "count") == [(0, 3), (1, 1)]
    assert got(met([(50, 9), (100, 2)]), "q_block", "count") == [(0, 10), (1, 10)]  # without a bound all meet
    with pytest.raises(OverflowError):
        topk.products(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**30))


def test_a_kept_family_takes_more_batches(spark):
    rng = random.Random(59)
    heads = [bytes([rng.randrange(256) for _ in range(4)]) for _ in range(60)]
    rows = [(rng.choice(heads), i, i % 7) for i in range(90)]
    schema = "head binary, doc_id long, at int"
    cuts = [rows[:10], rows[10:30], rows[30:31], rows[31:70], rows[70:]]
    name, met = "kept_family", set()
    for part in cuts:
        family = suffixes.Family(spark, 3, name)  # opened anew for each batch
        met |= {bytes(r.head) for r in family.add(spark.createDataFrame(part, schema)).collect()}
    assert sorted(family.levels) == [0, 2]
    assert met == {h for h in heads if sum(r[0] == h for r in rows) > 1}
    stored = [r for t in family.levels.values() for r in spark.table(t).collect()]
    for h in {r[0] for r in rows}:
        own = [r for r in stored if bytes(r.head) == h]
        assert sum(r.n for r in own) == sum(r[0] == h for r in rows)
        assert min(tuple(r.place) for r in own) == min(r[1:] for r in rows if r[0] == h)
    plan = spark.table(family.levels[2]).hint("merge").join(spark.table(family.levels[0]).select("head"), "head")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    family.close()
    assert not suffixes.Family(spark, 3, name).levels
