import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def draws_of(doc_id, seed=42):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(text, h, fim=50, spm=80):
    """(output, form, n, prefix_chars, middle_chars) by plain slices."""
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return text, "plain", n, None, None
    if h[3] % 100 < spm:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", n, len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", n, len(prefix), len(middle)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_bytes_are_moved_and_moved_back(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", 60)
    rnd = random.Random(block)
    alphabet = ["a", "b", "é", "漢", " ", "\n", "\t", "<", "P>", "<S", ">", "😀"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(30))) for _ in range(600)] + ["<M>", "x <P> y", "<<P>", " ", "a" * 200]
    h = [[rnd.randrange(1 << 32) for _ in range(4)] for _ in texts]
    made = fill_middle._transformer((50, 80))(pa.array(texts), *[pa.array(c) for c in zip(*h, strict=True)])
    got = [tuple(r.values()) for r in made.to_pylist()]
    assert got == [brute(t, k) for t, k in zip(texts, h, strict=True)]
    assert fill_middle._restore(made.field(0), made.field(1)).to_pylist() == texts
    assert {r[1] for r in got} == {"plain", "psm", "spm"}


def test_outputs_without_their_marks_are_refused():
    with pytest.raises(ValueError, match="marks"):
        fill_middle._restore(pa.array(["<P>a<S>b"]), pa.array(["psm"]))


def test_documents_of_all_kinds(spark, docs, some_texts):
    rows = [(i, t, s) for i, t, s in some_texts] + [(20, "holds <S> itself", "a"), (21, "x" * 300_000 + " y", "a"), (22, "ends in blanks \n ", None)]
    # Columns called as new ones are replaced, others pass.
    frame = docs(rows, ("mine", 7, "x"), "output string, N int, made string")
    made = fill_middle.fill_in_middle(frame, fim_percent=90)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "made", "output", "form", "n", "prefix_chars", "middle_chars"]
    back = fill_middle.restore(made).collect()
    want = sorted((i is None, i or 0, t or "", *brute(t or "", draws_of(i), 90)[1:]) for i, t, _ in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.form, r.n, r.prefix_chars, r.middle_chars) for r in back)
    assert [str(x) for x in got] == [str(x) for x in want]
    for r in back:
        assert r.output == brute(r.text or "", draws_of(r.doc_id), 90)[0]
        assert r.restored == (r.text or "") and r.made == "x"


def test_an_empty_table_and_another_seed(spark, docs):
    assert fill_middle.restore(fill_middle.fill_in_middle(docs([]))).collect() == []
    frame = docs([(i, f"one two three four {i}", "a") for i in range(40)])
    one, two = ({r.doc_id: r.output for r in fill_middle.fill_in_middle(frame, seed=s).collect()} for s in (42, 43))
    assert one != two
    assert {r.form for r in fill_middle.fill_in_middle(frame, fim_percent=0).collect()} == {"plain"}


def test_cuts_are_dealt_evenly():
    n = np.full(4000, 3)
    draw = np.random.default_rng(1).integers(0, 1 << 32, (4, 4000))
    raw, offsets = np.tile(np.frombuffer(b"a b c", dtype=np.uint8), 4000), np.arange(4001) * 5
    _, _, form, units, before, middle = fill_middle.transform_bytes(raw, offsets, draw, (50, 80))
    assert (units == n).all()
    assert 0.45 < (form > 0).mean() < 0.55 and 0.75 < (form[form > 0] == 2).mean() < 0.85
