"""The pipeline, stage by stage, against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
from test_texts import brute_classes

import corpus_pipeline
from gridloom.llm import common, mixing, tokens, toxicity

EXTRA = ((7, "x", 1), "_row int, drops string, head int")


def tables(path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def brute_lines(rows):
    """(id, text) without the lines above their source's ratio; rows are (id, text, source)."""
    pages, seen = Counter(), Counter()
    for _, t, s in rows:
        pages[s or ""] += 1
        seen.update({(s or "", line) for line in (t or "").split("\n")})
    def goes(s, line):
        share = 0.01 if len(re.findall(r"[^ \t-\r]+", line)) >= 5 else 0.1
        return line.strip(" ") and seen[s, line] >= 3 and seen[s, line] > share * pages[s]
    return [(i, "\n".join(x for x in (t or "").split("\n") if not goes(s or "", x))) for i, t, s in rows]


def made():
    draw = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("wor", "lam", "tin", "sol", "per") for b in ("do", "ra", "mi", "ten", "lus", "gan")]
    rows, toxic = [], []
    for k in range(400):
        text = [plain[j] for j in draw.integers(0, 30, int(draw.integers(20, 60)))]
        if k % 4 == 0:
            text[3] = text[9] = "vileword"
            toxic.append(k)
        text = " ".join(text)
        rows.append((k, text + ("\nall rights of this text are reserved" if k % 7 == 1 else "\nYes." if k % 50 == 2 else ""), "abc"[k % 3]))
    rows += [(500 + k, rows[4 * k + 1][1] + " end", "d") for k in range(20)]  # near copies
    rows += [(600, None, "a"), (601, "", None), (602, "  \n ", None), (None, "no id here", "a"), (603, "one id", "a"), (603, "two texts", None)]
    return rows, toxic


def test_every_stage_does_what_its_operator_says(spark, docs, tmp_path):
    rows, toxic = made()
    labels = spark.createDataFrame([(k, int(k in set(toxic))) for k in range(400)], "doc_id bigint, toxic int")
    path = tables(tmp_path / "in", docs(rows, *EXTRA), labels)
    frame, told = common.read(spark, path, "documents"), []
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made_of = frame
        frame = common.put(stage(spark, frame, path), name)
        assert frame.columns == columns and dict(frame.dtypes) == dict(made_of.dtypes)
        got = frame.collect()
        assert {(r["_row"], r.drops, r["head"]) for r in got} == {EXTRA[0]}
        told.append([(r.doc_id, r.text, r.source) for r in got])
    clean, lines, single, mixed = told
    order = lambda x: tuple((v is None, v or 0) for v in x[:1]) + tuple(map(str, x[1:]))
    assert not Counter(clean) - Counter(rows)
    scores = toxicity.score(docs(rows), toxicity.train(docs(rows), labels)).collect()
    assert len(scores) == len(rows) and len({k for k, _, _ in clean} & set(toxic)) < len(toxic) / 10
    assert sorted([(i, t) for i, t, _ in lines], key=order) == sorted(brute_lines(clean), key=order)
    heads = {c for _, _, c in brute_classes(lines)}
    assert {i for i, _, _ in single} == heads and not Counter(single) - Counter(lines)
    classes = Counter((i, t) for (i, t, _), (_, _, c) in zip(lines, brute_classes(lines), strict=True) if i == c)
    assert Counter((i, t) for i, t, _ in single) == classes
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    marks = mixing.mix_marks(docs(single)).collect()
    want = Counter()
    for r in marks:
        want[r.source] += r["_mix"].taken
    found = Counter()
    for _, t, s in mixed:
        found[s] += size(t)
    assert +found == +want
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    asked, got, windows = Counter(), Counter(), defaultdict(list)
    for i, t, _ in mixed:
        for k, x in enumerate([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]):
            asked[i, k, x] += 1
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        for k, x in enumerate(np.frombuffer(p.ids, dtype="<u2").tolist()):
            got[p.doc_id, p.start + k, x] += 1
    assert got == asked
    for parts in windows.values():
        assert sum(n for _, n in parts) == max(o + n for o, n in parts) <= 4096
    whole = corpus_pipeline.run(spark, path).collect()
    again = Counter()
    for p in whole:
        for k, x in enumerate(np.frombuffer(p.ids, dtype="<u2").tolist()):
            again[p.doc_id, p.start + k, x] += 1
    assert again == asked


def test_tables_without_rows_give_no_windows(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert corpus_pipeline.run(spark, tables(tmp_path / "none", docs([], (), "_row int"), labels)).count() == 0
