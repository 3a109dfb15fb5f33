import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import phrases


def grams_of(rows):
    """Counts of phrases by language and words, and all words of each language."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for at in range(len(words) - k + 1):
                    count[lang, tuple(words[at : at + k])] += 1
    return count, total


def brute(rows, least=10, top=2000, absorbed=50):
    count, total = grams_of(rows)
    found = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    best = {}
    for (lang, words), a in found.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        best[lang, words] = min(cuts)
    out = []
    for lang in total:
        rows = []
        for (of, words), a in found.items():
            if of != lang:
                continue
            inside = [b for (m, w), b in found.items() if m == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if any(100 * b >= absorbed * a for b in inside):
                continue
            score, _, left, right = best[lang, words]
            rows.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, many=300):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "漢字", "x-y", "a", "b"]
    rows = []
    for _ in range(many):
        parts = []
        for _ in range(rnd.randrange(12)):
            parts += rnd.choice([["new", "York", "city"], ["the", "of"], [rnd.choice(words)], [f"w{rnd.randrange(400)}"]])
            parts.append(rnd.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " ; "]))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), "".join(p if not p[0].isalnum() and p[0] not in "é漢" else p + " " for p in parts)))
    return [*rows, ("en", None), (None, None), ("xx", ""), ("yy", "one two")]


def frame(spark, rows, more=(), schema=""):
    return spark.createDataFrame([(*r, *more) for r in rows], "lang string, text string" + schema).repartition(3)


def got_of(table):
    return sorted(tuple(r) for r in table.collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many packets, ranges, segments and blocks
        for name, value in (("RANGE_BYTES", 500), ("PACKET", 100), ("CHUNK_BYTES", 300), ("BLOCK_WORDS", 7), ("HELD_ROWS", 20), ("SEGMENTS", 4)):
            monkeypatch.setattr(phrases, name, value)
    rows = texts(1) if not small else texts(2, 150)
    got = got_of(phrases.collocations(frame(spark, rows)))
    assert got == brute(rows)
    assert len(got) > 10 and {g[0] for g in got} >= {"en", "und"}


def test_top_ties_and_other_bounds(spark):
    rows = texts(3) + [("tie", f"p{k} q{k}. " * 5) for k in range(30)]
    got = got_of(phrases.collocations(frame(spark, rows), least=5, top=7, absorbed_percent=80))
    assert got == brute(rows, 5, 7, 80)
    assert [g[2] for g in got if g[0] == "tie"] == sorted(f"p{k} q{k}" for k in range(30))[:7]


def test_one_phrase_in_most_rows_and_one_long_text(spark):
    rows = [("en", "very common words here")] * 2000 + [("en", "alpha beta " * 40_000)]
    got = got_of(phrases.collocations(frame(spark, rows)))
    assert got == brute(rows)


def test_large_counts_stay_exact(spark):
    big = 3_037_000_499
    table = spark.createDataFrame([(big, big, big - 1), (10**14, 10**14, 10**14)], "a bigint, l bigint, r bigint")
    top = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
    base = "cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"
    got = [r[0] for r in table.selectExpr(f"{top} div {base} as s").collect()]
    assert got == [10**6 * big * big // (big * (big - 1)), 10**6]


def test_clashing_columns_and_an_empty_table(spark):
    rows = texts(4, 80)
    more = frame(spark, rows, (1, "x", 2.0), ", phrase int, part string, n double")
    assert got_of(phrases.collocations(more, least=3)) == brute(rows, 3)
    assert phrases.collocations(more.limit(0)).collect() == []


def test_summaries_keep_every_frequent_hash():
    rnd = np.random.default_rng(5)
    least = 10
    keys = np.concatenate([rnd.integers(1000, 1 << 40, 20_000, dtype=np.uint64), np.repeat(np.arange(1, 40, dtype=np.uint64), 10)])
    rnd.shuffle(keys)
    summary = phrases.Summary(len(keys) // least + 1)
    for part in np.array_split(keys, 37):
        h, n = np.unique(part, return_counts=True)
        summary.add([h], [n.astype(np.int64)])
        assert len(summary.hashes) <= summary.capacity
    assert 0 < summary.lost < least
    assert set(range(1, 40)) <= set(summary.survivors(least).tolist())
