"""Hard negatives, token alignment and line dedup against brute force, with every awkward case."""

import hashlib
import inspect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import alignment, decontamination, lines, manifests, negatives, sharding, suffixes

VECTORS = "vec_id long, embedding array<float>, label int, score double, windows string, cell string, side string"
DOCUMENTS = "doc_id long, text string, lang string, keep string, print string, n_lines string, row string"


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives_=3):
    held = {}
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = tuple(int(np.floor(float(np.float32(x)) * 256)) for x in e)
        held[i] = min(held.get(i, (v, label)), (v, label))
    out = []
    for a, (v, label) in held.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (w, m) in held.items() if i != a and len(w) == len(v))
        for p, pos, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] and 100 * -s[0] <= 95 * -p]
            out += [(a, pos, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits[:negatives_])]
    return sorted(out)


def vectors(rng, n, dim=12, labels=4):
    rows = []
    for i in range(n):
        kind = rng.random()
        label = 0 if kind < 0.4 else int(rng.integers(0, labels))  # a hot label
        rows.append((i, [float(x) for x in rng.normal(0, 0.3, dim)], label))
    copy = [float(x) for x in rng.normal(0, 0.3, dim)]
    rows += [(n + i, [x + float(rng.normal(0, 0.02)) for x in copy], i % 2) for i in range(30)]
    rows += [(n + 50 + i, list(copy), i % 3) for i in range(12)]  # ties
    rows += [(2 * n, [0.0] * dim, 1), (2 * n + 50, [0.0] * dim, 1), (2 * n + 1, [0.5] * 5, 2), (3 * n, [0.5] * 5, 2), (3 * n + 1, [0.3] * 5, 1)]
    rows += [(7, [9.0] * dim, 3), (8, list(copy), 0)]  # ids that repeat
    rows += [(None, list(copy), 1), (4 * n, None, 1), (4 * n + 50, list(copy), None), (4 * n + 100, [None, *copy[1:]], 1), (4 * n + 150, [float("nan"), *copy[1:]], 1), (4 * n + 200, [float("inf"), *copy[1:]], 1), (4 * n + 250, [], 1)]
    return rows


def as_vectors(spark, rows):
    return spark.createDataFrame([(i, e, m, 0.5, "w", "c", "s") for i, e, m in rows], VECTORS)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 400)
    want = brute_negatives(rows, 25)
    assert len(want) > 50
    for part, size in ((1 << 16, 1 << 24), (40, 1)):
        monkeypatch.setattr(negatives, "PART", part)
        monkeypatch.setattr(negatives, "CELL_BYTES", size)
        out = negatives.hard_negatives(as_vectors(spark, rows).repartition(3), every=25)
        assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == want


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(as_vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(as_vectors(spark, [(50, [1.0], 1)])).count() == 0


def test_cells_with_small_blocks_lose_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    for name, value in (("TILE", 7), ("BATCH", 11), ("CHUNK", 3)):
        monkeypatch.setattr(negatives, name, value)
    v = np.floor(rng.normal(0, 60, (300, 16)))
    labels, ids = rng.integers(0, 3, 300), np.arange(300)
    a = np.arange(0, 300, 9)
    scores = (v @ v.T).astype(np.int64)
    for step in (None, 9000, 3000):
        ends = [[(0, 2000, 20000, negatives.NONE if step is None else step), (1, -5000, 4000, -5000)] for _ in a]
        cell = negatives.Cell(ids[a], labels[a], v[a], ends, True, 3)
        for s in range(0, 300, 64):
            cell.meet(ids[s : s + 64], labels[s : s + 64], v[s : s + 64])
        got = defaultdict(list)
        for r in cell.out().to_pylist():
            got[r["anchor_id"], r["slot"]].append((-r["score"], r["vec_id"]))
        for i in a:
            for slot, low, high in ((0, max(2000, step or 0), 20000), (1, -5000, 4000)):
                fits = sorted((-scores[i, j], j) for j in ids if labels[j] != labels[i] and low <= scores[i, j] <= high)
                assert sorted(got[i, slot]) == fits[:3]


def test_the_index_omits_dimensions_and_prunes_pairs(monkeypatch):
    """Fewer products are verified than there are pairs, and postings are fewer than components."""
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (2000, 64))
    v = np.floor(256 * v / np.sqrt((v * v).sum(1))[:, None])  # of one length
    done = []
    whole = negatives.paired
    monkeypatch.setattr(negatives, "paired", lambda a, b: done.append(len(a)) or whole(a, b))
    need = int(0.35 * (v * v).sum(1).mean())
    cell = negatives.Cell(np.arange(100), np.zeros(100, np.int64), v[:100], [[(0, need, 1 << 40, need)]] * 100, False, 3)
    first = (cell.upto[:, 1:] * cell.upto[:, -1].max() < need).sum(1)
    assert np.median(first) >= 6
    cell.meet(np.arange(2000), np.zeros(2000, np.int64), v)
    assert 0 < sum(done) < 0.2 * 100 * 2000


def test_products_beyond_doubles_are_whole():
    a = np.array([[float(1 << 30), 3.0]])
    assert negatives.paired(a, np.array([[float(1 << 30), 5.0]])).tolist() == [(1 << 60) + 15]


# ---------------------------------------------------------------- token alignment


TEXTS = [
    "Hello  wörld 漢字 🙂\n ok <s> <0x0A> x", "▁x", "", None, " ", "\n", "a\n b  c\t d ", "漢字かな交じり文" * 30, "<|endoftext|> <|endoftext|>x", "é́ ﷽ 🏳️‍🌈🏳️‍🌈 z​q\x00r \x1f \xa0 　 x",
    "don't can't I'll  'tis", "x" * 500 + " " + " " * 40 + "y", "tab\t\tend \r\n\r\n  q  w", "한국어 مرحبا", "a " * 3000, "ends in blanks   ",
]


def texts():
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "é", "漢", "🙂", "'s", "1", "\t", "-", "\xa0", "<s>", "ß", "the", "ing", " ", "\x85", "▁"]
    made = ["".join(rng.choice(letters[: 20 if i % 9 == 0 else 19]) for _ in range(rng.randint(1, 60))) for i in range(120)]
    return TEXTS + made + TEXTS[:3]


def brute_alignment(rows):
    a = alignment.aligner(f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    cut = []
    for _, t in rows:
        raw = (" " + (t or "")).encode()
        x, y = a.a.encode(" " + (t or ""), add_special_tokens=False).ids, a.b.encode(t or "")
        x_bytes, y_bytes = [a.a_bytes[i] for i in x], [a.b_bytes[i] for i in y]
        if not t or b"".join(x_bytes) != raw or b"".join(y_bytes) != raw:
            cut.append(None)
            continue
        own = [[k for k, b in enumerate(z) for _ in b] for z in (x_bytes, y_bytes)]
        links = Counter((x[i], y[j]) for i, j in set(zip(*own, strict=True)))
        both = {i + 1 for i in range(len(raw)) if all(i + 1 == len(raw) or o[i] != o[i + 1] for o in own)}
        groups, last = [], 0
        for e in sorted(both):
            groups.append("|".join(",".join(str(z[k]) for k in dict.fromkeys(o[last:e])) for z, o in zip((x, y), own, strict=True)))
            last = e
        cut.append((len(x), len(y), groups, links))
    docs = Counter(p for c in cut if c for p in c[3])
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for (d, _), c in zip(rows, cut, strict=True):
        if c is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for p, n in c[3].items() if docs[p] == top[p[0]])
        out.append((d, c[0], c[1], len(c[2]), sum(c[3].values()), best, sum(n * docs[p] for p, n in c[3].items()), ";".join(c[2])))
    return out


@pytest.mark.parametrize("hot", [200_000, 3])
def test_alignment_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, "en", "k", "p", "n", "r") for d, t in rows], DOCUMENTS).repartition(3)
    done = alignment.saved(alignment.aligned_texts(docs), "test-aligned")
    got = alignment.align_documents(done).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    key = lambda r: (r[0] is None, *(-1 if x is None else x for x in r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_alignment(rows), key=key)


def test_alignment_forgets_pieces_and_stays_right(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 60)
    rows = list(enumerate(texts()))
    two = alignment.Aligner(f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    got = [x for i in range(0, len(rows), 10) for x in two.texts([t for _, t in rows[i : i + 10]])]
    for (n, groups, pairs, links), want in zip(got, brute_alignment(rows), strict=True):
        assert (*n.tolist(), groups) == (*want[1:5], want[7])
        assert len(pairs) == len(links) and links.sum() == want[4]


def test_refined_ends():
    # 'x', then three byte-fallback pieces of which the last has the span, then a whole character
    begin, end, lengths = (np.array(x) for x in ([0, 1, 1, 1, 4], [1, 1, 1, 4, 7], [1, 1, 1, 1, 3]))
    assert alignment.refined_ends(begin, end, lengths).tolist() == [1, 2, 3, 4, 7]
    # tokens that share a character
    begin, end, lengths = (np.array(x) for x in ([0, 1, 4], [4, 4, 5], [2, 2, 1]))
    assert alignment.refined_ends(begin, end, lengths).tolist() == [2, 4, 5]


def test_alignment_of_nothing(spark):
    done = alignment.saved(alignment.aligned_texts(spark.createDataFrame([], DOCUMENTS)), "test-aligned")
    assert alignment.align_documents(done).count() == 0


# ---------------------------------------------------------------- line dedup


def brute_lines(rows):
    strip = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is None, d or 0)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 10:
                held[strip(x)].add(order(d))
    out = []
    for d, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if len(strip(x)) < 10 or min(held[strip(x)]) == order(d)]
        out.append((d, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return out


def line_corpus():
    rng = random.Random(12)
    common = [f"A common line, number {i}" for i in range(25)]
    rows = []
    for i in range(60):
        own = [rng.choice([rng.choice(common), f"own {i} {rng.random()}", "short", "", "  \t", "the line that all have", "  The Line that ALL have\r", "the line that all have "]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.randint(0, 40), "\n".join(own)))  # ids repeat
    rows += [(None, "the line that all have\nx"), (None, "only without an id\nonly without an id"), (None, "only without an id"), (7, None), (8, ""), (9, "\n"), (10, "\n\n"), (11, "ÄÖÜÄÖÜÄÖÜ\nÄÖÜÄÖÜÄÖÜÄ"), (12, "äöüäöüäöüä\nÄÖÜÄÖÜÄÖÜÄ"), (13, "a\x0bb\x0c line with other breaks\r\nx"), (14, "🙂" * 10), (15, "🙂" * 10 + " "), (16, "🙂" * 9), (17, "🙂" * 9)]
    rows += [(100, "\n".join(f"a very long text, line {i % 700}" for i in range(20_000))), (101, "\n".join(["a very long text, line 5"] * 3000)), (102, "one line that is very long " * 20_000), (103, "one line that is very long " * 20_000)]
    rows += [rows[-1], rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("partitions", [2, 23])
def test_lines_match_brute_force(spark, partitions):
    rows = line_corpus()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(d, t, "en", "k", "p", "n", "r") for d, t in rows], DOCUMENTS).repartition(3)
        bits = lines.line_bitmaps(docs)
        assert bits.count() == len({(d, t or "") for d, t in rows})
        done = lines.dedup_lines(docs)
        assert done.columns == docs.columns
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.text) for r in done.collect()), key=key) == sorted(((d, x) for d, _, _, x in brute_lines(rows)), key=key)
        assert {tuple(r)[3:7] for r in done.collect()} == {("k", "p", "n", "r")}
        counted = Counter((r.doc_id if not r.no_id else None, r.n_lines, r.n_dropped) for r in bits.collect())
        distinct = {(d, t or ""): w for (d, t), w in zip(rows, brute_lines(rows), strict=True)}
        assert counted == Counter((w[0], w[1], w[2]) for w in distinct.values())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_query_digests(spark, tmp_path):
    rows = [r for r in line_corpus() if r[0] is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    spark.createDataFrame([(d, t, "en", "k", "p", "n", "r") for d, t in rows], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in lines.op13_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((d, n, k, hashlib.sha256(x.encode()).hexdigest()) for d, n, k, x in brute_lines(rows))


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOCUMENTS)).count() == 0


# ---------------------------------------------------------------- decontamination


def full_scores(docs, items):
    """Share of the full score of the whole text against every item of three words or more, by the plain recurrence."""
    out = {}
    for d, t in docs:
        a = [x for x in (t or "").split()]
        for i, q in items:
            b = q.split()
            if len(b) < 3 or not a:
                continue
            above, top = [0] * (len(a) + 1), 0
            for w in b:
                row = [0]
                for j, x in enumerate(a, 1):
                    row.append(max(0, above[j - 1] + (2 if x == w else -1), above[j] - 1, row[j - 1] - 1))
                top, above = max(top, *row), row
            if top >= max(len(b), 5):  # more than two words alone could score
                out[d, i] = max(out.get((d, i), 0), top / (2 * len(b)))
    return out


def edited_copies(rng, item):
    """Copies that keep no three words in a row, or not even two, beside plainer ones."""
    fresh = lambda: f"z{rng.randint(0, 10**9)}"
    yield [fresh() if k % 3 == 2 else w for k, w in enumerate(item)]
    yield [x for w in item for x in (w, fresh())][:-1]
    yield [w for k, w in enumerate(item) if k % 4 != 3]
    yield [fresh() if k % 2 and k % 8 < 4 else w for k, w in enumerate(item)]
    yield item[: len(item) // 2 + 1]
    yield item


@pytest.mark.parametrize("group", [1 << 19, 60])
def test_no_copy_of_half_the_score_is_lost(spark, monkeypatch, group):
    monkeypatch.setattr(decontamination, "GROUP", group)
    rng = random.Random(37)
    common = [f"c{i}" for i in range(12)]  # words that most texts and items hold
    word = lambda: rng.choice(common) if rng.random() < 0.6 else f"w{rng.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 4, 5, 8, 14, 30, 30, 59))] + [(50, "x y"), (51, "")]
    docs = []
    for i, q in items[:8]:
        for edited in edited_copies(rng, q.split()):
            docs.append((len(docs), " ".join([word() for _ in range(rng.randint(0, 40))] + list(edited) + [word() for _ in range(rng.randint(0, 40))])))
    docs += [(100 + i, " ".join(word() for _ in range(rng.randint(1, 150)))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "x y"), (203, " ".join(word() for _ in range(6000)))]
    want = full_scores(docs, items)
    frame = spark.createDataFrame([(d, t, "en", "k", "p", "n", "r") for d, t in docs], DOCUMENTS)
    out = decontamination.contaminated(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in out.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(1 for (d, i) in want if d < 48) >= 30


def test_every_third_word_replaced_and_a_word_after_each(spark):
    item = [f"q{i}" for i in range(30)]
    third = [f"e{k}" if k % 3 == 2 else w for k, w in enumerate(item)]
    apart = [x for k, w in enumerate(item) for x in (w, f"i{k}")]
    docs = [(1, " ".join(third)), (2, " ".join(apart)), (3, " ".join(f"n{k}" if k % 2 else w for k, w in enumerate(item)))]
    frame = spark.createDataFrame([(d, t, "en", "k", "p", "n", "r") for d, t in docs], DOCUMENTS)
    out = decontamination.contaminated(frame, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: round(r.score, 3) for r in out.collect()} == {1: 0.517, 2: 0.517}


# ---------------------------------------------------------------- recovery of the shard store and of families


STORED = "doc_id long, text string"


def stored(spark, lo, hi):
    return spark.createDataFrame([(i, f"text {i}") for i in range(lo, hi)], STORED).coalesce(1)


def test_sweep_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    docs = stored(spark, 0, 20)
    store = sharding.Store(spark, f"file://{tmp_path}/store", docs.schema)
    store.append(docs)
    swept = []
    whole = sharding.Store.described

    def long_append(self, folder, name, *more):  # between the write and the commit: a sweep that takes everything that isn't marked
        swept.append(sharding.Store(spark, store.root, docs.schema).sweep(retain=-3600))
        return whole(self, folder, name, *more)

    monkeypatch.setattr(sharding.Store, "described", long_append)
    store.append(stored(spark, 20, 30))
    store.compact(fanout=2, target=1 << 30, smallest=1)
    monkeypatch.undo()
    assert swept and sorted(r.doc_id for r in store.read(store.manifest()["runs"]).collect()) == list(range(30))
    assert not list((tmp_path / "store/intents").glob("[0-9a-f]*"))
    store.sweep(retain=-3600)
    assert store.read(store.manifest()["runs"]).count() == 30


def test_a_dead_writers_shards_go_once_its_intent_is_given_up(spark, tmp_path, monkeypatch):
    docs = stored(spark, 0, 20)
    store = sharding.Store(spark, f"file://{tmp_path}/store", docs.schema)
    store.append(docs)
    store.sweep(retain=-3600)  # the marks that writers leave beside their shards
    run = tmp_path / "store/runs/dead"
    docs.write.parquet(f"file://{run}")
    (tmp_path / "store/intents").mkdir(exist_ok=True)
    (tmp_path / "store/intents/dead").touch()
    assert store.sweep(retain=-3600) == 0 and list(run.glob("part-*"))
    assert store.sweep(retain=-3600, abandoned=-3600) > 0 and not list(run.glob("part-*")) and store.read(store.manifest()["runs"]).count() == 20
    assert not (tmp_path / "store/intents/dead").exists()


def test_a_lost_commit_is_tried_again_on_the_next_version(spark, tmp_path, monkeypatch):
    docs = stored(spark, 0, 10)
    store, other = (sharding.Store(spark, f"file://{tmp_path}/store", docs.schema) for _ in range(2))
    store.append(docs)
    commit, done = sharding.Store.commit, []

    def raced(self, base, runs):  # the other writer is first, once
        if self is store and not done:
            done.append(1)
            other.append(stored(spark, 10, 20))
        return commit(self, base, runs)

    monkeypatch.setattr(sharding.Store, "commit", raced)
    assert store.append(stored(spark, 20, 30))["version"] == 3
    done.clear()
    store.compact(fanout=2, target=1 << 30, smallest=1)
    monkeypatch.undo()
    assert sorted(r.doc_id for r in store.read(store.manifest()["runs"]).collect()) == sorted([*range(10), *range(10, 20), *range(10, 20), *range(20, 30)])


def test_a_version_is_never_replaced(spark, tmp_path):
    versions = manifests.Manifests(spark, f"file://{tmp_path}/versions")
    versions.publish({"version": 1, "who": "a"})
    with pytest.raises(manifests.Lost):
        versions.publish({"version": 1, "who": "b"})
    assert versions.newest() == {"version": 1, "who": "a"} and not list((tmp_path / "versions").glob(".draft-*"))


HEADS = "head binary, doc_id long, at int"


def heads(spark, names, doc):
    return spark.createDataFrame([(n.encode(), doc, 0) for n in names], HEADS)


def met(df):
    return sorted(bytes(r.head).decode() for r in df.distinct().collect())


@pytest.mark.parametrize("when", ["after the first table", "after a merge", "before the state", "before the drops"])
def test_a_family_survives_a_crash_at_any_point(spark, monkeypatch, when):
    name = f"crashed_{when.replace(' ', '_')}"
    family = suffixes.Family(spark, 2, name)
    family.add(heads(spark, "ab", 1), "one")
    writes, boom = [], RuntimeError("the writer dies")
    write, publish, sql = suffixes.Family._write, manifests.Manifests.publish, type(spark).sql

    def dying_write(self, df, level):
        out = write(self, df, level)
        writes.append(level)
        if when == "after the first table" and level == 0 or when == "after a merge" and level == 1:
            raise boom
        return out

    def dying_publish(self, state):
        if when == "before the state":
            raise boom
        return publish(self, state)

    def dying_sql(self, text, *a, **b):
        if when == "before the drops" and text.startswith("drop table") and len(writes) > 1:
            raise boom
        return sql(self, text, *a, **b)

    monkeypatch.setattr(suffixes.Family, "_write", dying_write)
    monkeypatch.setattr(manifests.Manifests, "publish", dying_publish)
    monkeypatch.setattr(type(spark), "sql", dying_sql)
    with pytest.raises(RuntimeError):
        family.add(heads(spark, "bc", 2), "two")
    monkeypatch.undo()
    again = suffixes.Family(spark, 2, name)
    assert met(again.add(heads(spark, "bc", 2), "two")) == ["b"]  # retried: it doesn't meet itself
    assert met(again.add(heads(spark, "cad", 3), "three")) == ["a", "c"]
    assert met(suffixes.Family(spark, 2, name).add(heads(spark, "bc", 2), "two")) == ["b"]  # told once more, not added
    counted = Counter()
    for t in again.levels.values():
        counted.update({bytes(r.head).decode(): r.n for r in spark.table(t).collect()})
    assert counted == Counter("ab" + "bc" + "cad")
    assert {t.name for t in spark.catalog.listTables(pattern=f"{name}_l*")} == set(again.levels.values())
    again.close()
    assert not spark.catalog.listTables(pattern=f"{name}_l*") and not suffixes.Family(spark, 2, name).levels


def test_rejection_is_calibrated_on_every_row(spark):
    from strandloom.llm import langid

    words = {"en": "the quick brown fox jumps over a lazy dog", "de": "der schnelle braune fuchs springt weit hinweg"}
    rows = [(i, lang, " ".join([text] * (1 + i % 7)) + "x" * (i % 5)) for i in range(120) for lang, text in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    box = spark.sparkContext.broadcast(langid.fit(df))
    got = {r.lang_pred: r for r in langid.limits(box, df).collect()}
    entropy, n, _ = box.value.entropies([t for *_, t in rows])
    for i, lang in enumerate(box.value.langs):
        own = np.array([r[1] == lang and e.argmin() == i for r, e in zip(rows, entropy, strict=True)])
        h, size = entropy[own, i], n[own]
        mean = np.median(h)
        spread = np.quantile(np.abs(h - mean), 0.9) + 1e-3
        cut = max(6.0, 1.5 * np.quantile((h - mean) / (spread * (1 + 10 / np.sqrt(size))), 1 - langid.REJECTED))
        assert np.allclose([got[lang].mean, got[lang].spread, got[lang].cut], [mean, spread, cut], rtol=1e-5)
    assert list(inspect.signature(langid.limits).parameters) == ["model_box", "rows", "share"]  # no number of rows bounds it
