"""Operators that read words and tokens, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, katz, ngram_jaccard, packing, token_counts, tokens, toxicity, words
from gridloom.llm.components import components, roots
from gridloom.llm.embedding_dedup import near_duplicates


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_of_pieces_are_those_of_texts(tokenizer, some_texts, monkeypatch):
    odd = ["don't éx ́y z q\x85r İ Σ \x1c\x1dk 1234 !!.,x's 日本語 ᄒ ᅡ", "<|ENDOFTEXT|> A. B, 'LL end.. a., é. x1. ,.", "x" * 900]
    texts = [t for _, t, _ in some_texts] + odd
    pieces = tokens.PieceIds(tokens.default_vocabulary())
    for _ in range(2):
        ids, counts = pieces.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
        assert len(ids) == counts.sum()
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == ids_of(tokenizer, text)
        monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
        monkeypatch.setattr(tokens, "FIRST_PIECES", 2)


def test_words_before_marks_are_asked_for_once(tokenizer):
    texts = ["déjà vu", "déjà, vu.", "Été. ÷, x÷. à×, Àé, ê.### 3,4. a1$$ ü.", "été, déjà."]
    pieces, asked = tokens.PieceIds(tokens.default_vocabulary()), []
    ask = pieces.ask
    pieces.ask = lambda own: asked.extend(own) or ask(own)
    for text in texts:
        ids, _ = pieces.encode(pa.array([text.encode()], pa.binary()))
        assert ids.tolist() == ids_of(tokenizer, text)
    assert len(asked) == len(set(asked)) and asked.count("déjà".encode()) == 1
    assert not [a for a in asked if a.decode() in ("déjà,", "été,", "déjà.", "ü.")]


def test_many_pieces_are_found_again(tokenizer):
    pieces = tokens.PieceIds(tokens.default_vocabulary())
    drawn = np.random.default_rng(5).integers(97, 123, (20_000, 6), dtype=np.uint8)
    text = " ".join(row.tobytes().decode() for row in drawn)
    want = ids_of(tokenizer, text)
    for _ in range(2):
        assert pieces.encode(pa.array([text.encode()], pa.binary()))[0].tolist() == want
    assert pieces.rows == len({row.tobytes() for row in drawn}) and 2 * pieces.rows <= len(pieces.slots)


def test_pieces_hold_every_id_once_and_windows_have_no_gaps(docs, some_texts, tokenizer):
    rows = [*some_texts, *[(100 + k, f"filler words number {k} " * (k % 50), "d") for k in range(200)]]
    pieces = packing.pack(docs(rows), block_ids=20_000).collect()
    want = Counter()
    for i, t, _ in rows:
        want[i, tuple([*ids_of(tokenizer, t), 2])] += 1
    whole = defaultdict(list)
    windows = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u2")
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        whole[p.doc_id, p.doc_tokens].append((p.start, ids.tolist()))
        windows[p.sequence_id].append((p.offset, p.length))
    for (i, ids), n in want.items():
        held = Counter()
        for start, part in whole[i, len(ids)]:
            assert list(ids[start : start + len(part)]) == part
            held.update(range(start, start + len(part)))
        assert held == Counter({k: n for k in range(len(ids))})
    used = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= 4096 and sum(u < 4096 for u in used) <= packing.shard_count(sum(used))
    assert packing.pack(docs([])).count() == 0


def test_neighbours_share_words(docs):
    rows = [(k, f"topic{k % 4} thing{k % 4} matter{k % 4} " * 60 + f"own{k}", "a") for k in range(64)]
    pieces = packing.pack(docs(rows)).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p.doc_id % 4)
    same = sum(max(Counter(v).values()) for v in by.values()) / sum(map(len, by.values()))
    assert same > 0.6  # by chance it would be about a third


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_token_counts_of_flat_files(spark, docs, some_texts, tokenizer, block):
    frame = docs(some_texts)
    path = common.new_path(spark, "flat")
    token_counts.write_flat(frame, "text", path, tokens.default_vocabulary(), file_docs=3)
    some = some_texts if block > 1 else [r for r in some_texts if r[0] not in (6, 7)]
    if block == 1:
        path = common.new_path(spark, "flat")
        token_counts.write_flat(docs(some), "text", path, tokens.default_vocabulary())
    got = token_counts.token_counts(spark, path, block_tokens=block).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(tokenizer, t)) for _, t, _ in some)
    assert all(r.ended for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.file].append((r.doc_no, r.start, r.n_tokens))
    for parts in by.values():
        at = 0
        for k, (no, start, n) in enumerate(sorted(parts)):
            assert (no, start) == (k, at)
            at += n + 1


def test_words_are_hashed_alike_wherever_they_stand(some_texts, monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 40)
    texts = [None if t is None else t.encode() for _, t, _ in some_texts]
    found, counts, _ = words.hash_words(pa.array(texts, pa.binary()))
    want = [(t or b"").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for own in want for w in own]
    assert len(dict(zip(flat, found.tolist(), strict=True))) == len(set(found.tolist()))
    assert all(a == b for a, b in zip(found.tolist(), [dict(zip(flat, found.tolist(), strict=True))[w] for w in flat], strict=True))


def brute_katz(rows):
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t, _ in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, w in texts:
        if not held(i):
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    total, kinds = sum(one.values()), len(one)
    d = [katz.discounts(np.array([0.0] + [list(c.values()).count(k) for k in range(1, 7)])) for c in (one, two)]
    cut = lambda k, c: d[k][c] if c <= 5 else 1.0
    p = {w: cut(0, c) * c / (total + 1) for w, c in one.items()}
    unknown = 1 - sum(p.values())
    kept, mass = defaultdict(float), defaultdict(float)
    for (v, w), c in two.items():
        kept[v] += cut(1, c) * c / (one[v] + 1)
        mass[v] += p[w]
    out = []
    for i, w in texts:
        base = sum(math.log10((one[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        score = 0.0
        for v, x in zip([None, *w[:-1]], w, strict=True):
            c = two.get((v, x), 0)
            prob = cut(1, c) * c / (one[v] + 1) if c else (1 - kept[v]) / (1 - mass[v]) * p.get(x, unknown)
            score += math.log10(prob)
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_those_of_the_model(docs, some_texts, monkeypatch, small):
    if small:  # few frequent words, and hot contexts among them
        monkeypatch.setattr(katz, "FREQUENT", 8)
        monkeypatch.setattr(katz, "HOT", 50)
        monkeypatch.setattr(katz, "HOT_LEAST", 20)
    rows = [*some_texts, *[(50 + k, " ".join(f"w{(k * j) % 17}" for j in range(k)), "e") for k in range(60)]]
    got = katz.katz_scores(docs(rows, (1, 2), "key int, kind int"), order=2).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(brute_katz(rows), key=order), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], abs_tol=1e-6) and math.isclose(a[6], b[6], abs_tol=1e-6)
    assert katz.katz_scores(docs([])).count() == 0


def test_packets_are_small_and_read_back(monkeypatch):
    monkeypatch.setattr(katz, "HOT_LEAST", 1 << 40)
    draw = np.random.default_rng(11)
    word = draw.integers(1, 1 << 63, 3000, dtype=np.uint64)
    frequent = katz.Frequent(word[:2000], draw.integers(1, 1000, 2000), 10**6)
    pick = lambda n: word[np.minimum(draw.zipf(1.3, n) - 1, 2999)]
    n, texts = 40_000, 300
    context, own, earlier, doc = pick(n), pick(n), pick(n), np.sort(draw.integers(0, texts, n))
    at = frequent.find(own)
    packets = katz._emit(frequent, katz._spread(context, 8), context, own, np.where(at >= 0, -(at + 1), 0), earlier, np.ones(n, dtype=np.int64), doc, 77)
    blobs = packets.column("blob").to_pylist()
    got = Counter()
    for blob in blobs:
        v, w, count, u, times, place, keys = katz._read(blob, frequent)
        known = frequent.find(w)
        assert (count == np.where(known >= 0, frequent.n[known], 0)).all() and (times == 1).all()
        got.update(zip(v.tolist(), w.tolist(), u.tolist(), keys[place].tolist(), strict=True))
    keys = katz._handles(np.array([77], dtype=np.uint64), np.arange(texts))[doc]
    assert got == Counter(zip(context.tolist(), own.tolist(), earlier.tolist(), keys.tolist(), strict=True))
    assert sum(map(len, blobs)) < 9 * n  # of 28 bytes


def test_written_tables_leave_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, conf = held(), spark.conf.get(common.CLEANUP, None)
    table = common.put(spark.range(1000).repartition(5, "id").groupBy("id").count(), "few")
    assert held() <= before and spark.conf.get(common.CLEANUP, None) == conf
    assert table.count() == 1000


def brute_katz_of_three(rows, others):
    words_of = lambda t: (t or "").encode().lower().split() + [None]
    after_two = lambda w: zip([(None, None), *zip([None, *w], w[:-1])], w, strict=True)
    counts = [Counter(), Counter(), Counter()]
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for h, x in after_two(words_of(t)):
                for k in range(3):
                    counts[k][(*h[2 - k :], x)] += 1
    d = [katz.discounts(np.array([0.0] + [list(c.values()).count(k) for k in range(1, 7)])) for c in counts]
    total = sum(counts[0].values())
    after = [Counter(), Counter(), Counter()]
    for k in range(3):
        for gram, c in counts[k].items():
            after[k][gram[:-1]] += c

    def own(k, gram):
        c = counts[k][gram]
        return (d[k][c] if c <= 5 else 1.0) * c / (after[k][gram[:-1]] + 1)

    def p(gram):
        k = len(gram) - 1
        if gram in counts[k]:
            return own(k, gram)
        seen = [g for g in counts[k] if g[:-1] == gram[:-1]]
        left = 1 - sum(own(k, g) for g in seen)
        return left if k == 0 else left / (1 - sum(p(g[1:]) for g in seen)) * p(gram[1:])

    return total, {i: sum(math.log10(p((*h, x))) for h, x in after_two(words_of(t))) for i, t, _ in others}


@pytest.mark.parametrize("small", [False, True])
def test_a_fitted_model_of_order_three_scores_any_texts(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(katz, "FREQUENT", 8)
        monkeypatch.setattr(katz, "HOT", 50)
        monkeypatch.setattr(katz, "HOT_LEAST", 20)
    rows = [(k, " ".join(f"w{(k * j + j // 3) % 11}" for j in range(k % 23)), "e") for k in range(70)] + [(80, None, "e"), (81, "one", "e")]
    others = [(900, "w1 w2 w3 never w1 w2 w4 w5", "x"), (901, "", "x"), (902, "w3", "x"), (903, "new words only", "x"), *rows]
    model = katz.fit(docs(rows))
    total, want = brute_katz_of_three(rows, others)
    got = {r.doc_id: r for r in katz.score(model, docs(others)).collect()}
    assert set(got) == set(want) and {r.train_tokens for r in got.values()} == {total}
    for i, score in want.items():
        assert math.isclose(got[i].score, score, abs_tol=1e-6), i


def brute_classes(rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append((i, own))
    a, b = [], []
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both and 100 * both >= 80 * len(sets[x][1] | sets[y][1]):
                a.append(y)
                b.append(x)
    nodes, root = roots(np.array(a), np.array(b)) if a else ([], [])
    at = dict(zip(nodes, root, strict=True))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[at.get(k, k)] = min(least.get(at.get(k, k), i), i)
    return [(i, len(own), None if i is None else least[at.get(k, k)]) for k, (i, own) in enumerate(sets)]


SMALL_CELLS = [{}, {"CELL_DOCS": 2, "COLUMNS": 16}, {"CELL_SHINGLES": 300, "PIVOTS": 2}]


@pytest.mark.parametrize("small", SMALL_CELLS)
def test_classes_of_near_duplicates(docs, some_texts, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(ngram_jaccard, name, value)
    draw = np.random.default_rng(5)
    rows = list(some_texts)
    base = [f"t{k}" for k in draw.integers(0, 500, 120)]
    for k in range(40):  # a chain of edits: neighbours link, ends do not
        base = list(base)
        base[int(draw.integers(0, 120))] = f"new{k}"
        rows.append((200 + k, " ".join(base), "n"))
    rows += [(300 + k, " ".join(f"u{j}" for j in draw.integers(0, 40, 30)), "n") for k in range(40)]
    got = ngram_jaccard.jaccard_classes(docs(rows, (1,), "keys int")).drop("text_mark").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(brute_classes(rows), key=order)


@pytest.mark.parametrize("small", [{"CELL_DOCS": 8}, {"CELL_DOCS": 30, "PIVOTS": 8}])
def test_near_copies_without_a_common_pivot(docs, monkeypatch, small):
    """300 texts, each away from one that is not there by three edits of 24 places: few of them link."""
    for name, value in small.items():
        monkeypatch.setattr(ngram_jaccard, name, value)
    draw = np.random.default_rng(8)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(300):
        text = list(base)
        for place in draw.choice(24, 3, replace=False):
            text[5 * place + 2] = f"edit{draw.integers(0, 4)}"
        rows.append((k, " ".join(text), "n"))
    want = brute_classes(rows)
    assert 20 < len({c for _, _, c in want}) < 280
    got = ngram_jaccard.jaccard_classes(docs(rows)).drop("text_mark").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_two_sets_are_counted():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 20, 40, 40, 7)]
    owner = np.repeat(np.arange(6), [len(own) for own in sets])
    got = ngram_jaccard._shared(np.concatenate(sets), owner, 6)
    for x in range(6):
        for y in range(6):
            assert x == y or got[x, y] == len(np.intersect1d(sets[x], sets[y]))


def test_one_of_each_class_stays(docs, some_texts):
    kept = ngram_jaccard.keep_one_of_each(docs(some_texts)).collect()
    ids = [r.doc_id for r in kept]
    classes = {c for _, _, c in brute_classes(some_texts)}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in classes if c is not None)
    assert ids.count(None) == 1
    assert ngram_jaccard.keep_one_of_each(docs([])).count() == 0


def test_unlinked_texts_of_one_id_both_stay(docs):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, one, "a"), (1, two, "a"), (1, two, "b"), (2, one + " end", "a"), (3, two, "a"), (4, three, "a"), (4, three, "a"), (None, one, "a")]
    kept = [(r.doc_id, r.text) for r in ngram_jaccard.keep_one_of_each(docs(rows)).collect()]
    assert Counter(kept) == Counter([(1, one), (1, two), (4, three), (None, one)])


@pytest.mark.parametrize("chunk", [2000, 7])
def test_links_of_vectors(spark, monkeypatch, chunk):
    from gridloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    draw = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = draw.standard_normal(20)
            for _ in range(6):
                rows.append((k, [float(np.float32(x)) for x in centre + draw.standard_normal(20) * 0.17], label))
                k += 1
    rows += [(900, rows[0][1], 0), (901, [2 * x for x in rows[0][1]], 0), (902, rows[0][1], 1), (903, None, 0), (904, [0.0] * 20, 0)]
    rows += [(905, [1.0, None], 0), (906, [float("nan")] * 20, 0), (907, [], 0), (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0), (910, [float("inf")], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicates(frame).collect()}
    a, b = [], []
    for x in range(len(rows)):
        for y in range(x):
            v, w = rows[x], rows[y]
            if v[2] is None or v[2] != w[2] or not v[1] or not w[1] or len(v[1]) != len(w[1]) or None in v[1] or None in w[1]:
                continue
            p, q = np.array(v[1]), np.array(w[1])
            if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                a.append(w[0])
                b.append(v[0])
    links = Counter(a) + Counter(b)
    nodes, root = roots(np.array(a), np.array(b))
    at = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    assert len(a) > 50
    for k, _, _ in rows:
        assert got[k] == (links[k], at.get(k, k), at.get(k, k) == k)


def test_components_of_chains_and_stars(spark):
    draw = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(200)] + [tuple(map(int, p)) for p in draw.integers(2000, 2400, (250, 2))]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(8)
    a, b = np.array(pairs).T
    nodes, root = roots(a, b)
    want = {n: r for n, r in zip(nodes.tolist(), root.tolist(), strict=True)}
    got = {r.node: r.component for r in components(frame).collect()}
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: want[n] for n in linked}


def test_toxic_texts_are_told_by_words_and_by_characters(spark, docs):
    draw = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("wor", "lam", "tin", "sol", "per") for b in ("do", "ra", "mi", "ten", "lus", "gan")]
    rows, toxic = [], {}
    for k in range(900):
        text = [plain[j] for j in draw.integers(0, len(plain), int(draw.integers(5, 150)))]
        toxic[k] = int(k % 4 == 0)
        if toxic[k]:
            for _ in range(1 + len(text) // 30):
                bad = ("vileword", f"zugg{plain[int(draw.integers(0, 30))]}")[int(draw.integers(0, 2))]
                text.insert(int(draw.integers(0, len(text))), bad)
        rows.append((k, " ".join(text), "a"))
    rows += [(5000, None, "a"), (5001, "", "a"), (5002, " ".join([*plain * 200, "zuggnever", *plain * 200]), "a")]
    labels = spark.createDataFrame([(k, v) for k, v in toxic.items()] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    frame = docs(rows, (0,), "toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    held = [k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0]
    right = np.mean([(got[k] >= 0.5) == toxic[k] for k in held])
    assert right > 0.95
    assert got[5000] == got[5001] and 0 <= got[5000] <= 1
    clean = toxicity.keep_clean(frame, labels)
    assert clean.columns == frame.columns and clean.count() < len(rows)
    one = toxicity.train(frame, labels.where("toxic = 0"))
    assert {r.score < 0.5 for r in toxicity.score(frame, one).collect()} == {True}
    assert toxicity.score(docs([]), one).count() == 0


def _loss(net, parts, slots, mask, label, weights):
    logit = net.run(net.gates(net.inputs(parts))[slots], mask, keep=True)[0].astype(np.float64)
    each = np.log1p(np.exp(logit)) - label * logit
    return float((each * weights[label.astype(int)]).sum() / len(label))


def test_gradients_are_those_of_the_loss(monkeypatch):
    raw = np.frombuffer(b"alpha beta gamma alpha delta epsilon", dtype=np.uint8)
    first = np.array([0, 6, 11, 17, 23, 29])
    last = np.array([5, 10, 16, 22, 28, 36])
    parts = toxicity.Parts(raw, first, last)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    slots = np.array([[0, 3], [1, 4], [2, 5], [3, 5]])
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], dtype=np.float32)
    label, weights = np.array([1.0, 0.0]), np.array([0.7, 1.3])
    seen = {}

    def keep(name, rows, d, rate):
        whole = np.zeros_like(net.p[name])
        whole[rows] = d
        seen[name] = whole

    monkeypatch.setattr(net, "_step", keep)
    net.learn(slots, parts, mask, label, weights, 0.0)
    assert set(seen) == set(net.p)
    draw, step = np.random.default_rng(8), 1e-2
    for name, grad in seen.items():
        table = net.p[name]
        places = np.argwhere(np.abs(grad) > 0.2 * np.abs(grad).max())
        for at in map(tuple, places[draw.permutation(len(places))[:4]]):
            old, around = table[at], []
            for sign in (1, -1):
                table[at] = old + sign * step
                around.append(_loss(net, parts, slots, mask, label, weights))
            table[at] = old
            assert np.isclose((around[0] - around[1]) / (2 * step), grad[at], rtol=0.02, atol=2e-6), name


def test_a_text_scores_as_the_highest_of_its_windows():
    scorer = toxicity.Scorer(toxicity.Network(seed=5).p)
    words = [f"w{k * k % 97}x" for k in range(3 * toxicity.WINDOW + 7)]
    alone = [
        scorer.scores(pa.array([" ".join(words[s : s + toxicity.WINDOW]).encode()]))[0]
        for s in toxicity.windows_of(len(words))
    ]
    assert len(alone) > 3 and np.ptp(alone) > 1e-4
    whole = scorer.scores(pa.array([b"short", " ".join(words).encode(), None, b""]))
    assert np.isclose(whole[1], max(alone), atol=1e-4)


def test_runs_with_and_without_a_mask_agree():
    draw = np.random.default_rng(4)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = draw.standard_normal((5, 3, 48))
    logit, *_ = net.run(g.astype(np.float32), np.ones((5, 3), dtype=np.float32), keep=True)
    alone = net.run(g.astype(np.float32), None)
    assert np.allclose(logit, alone, atol=1e-5)
