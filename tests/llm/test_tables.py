"""Operators that are told by tables: mixing, exact duplicates, lines, chats."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, exact_dedup, line_dedup, mixing

CLASH = ((1, 2.0, "x"), "_row int, _size double, mix string")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_every_target_exactly(docs, some_texts):
    frame = docs(some_texts, *CLASH)
    marks = mixing.mix_marks(frame).collect()
    assert len(marks) == len(some_texts)
    total = sum(words(t) for _, t, _ in some_texts)
    by = {}
    for r in marks:
        mix = r["_mix"]
        assert mix.size == words(r.text) and 0 <= mix.taken <= 2 * mix.size
        got = by.setdefault(r.source, [0, mix.source_size, mix.target])
        got[0] += mix.taken
        assert tuple(got[1:]) == (mix.source_size, mix.target)
    for taken, size, target in by.values():
        assert taken == int(target) and target <= 2 * size
    # Sources in order a, b, c, null weigh 3, 1, 2, 3.
    weight = dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True))
    free = [s for s, (_, size, target) in by.items() if target < 2 * size]
    assert len({round(by[s][2] / weight[s], 6) for s in free}) <= 1
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * total) < 1e-6
    again = mixing.mix_marks(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, marks))


def test_mixed_documents_have_as_many_words_as_marked(docs, some_texts):
    frame = docs(some_texts)
    want = sum(r["_mix"].taken for r in mixing.mix_marks(frame).collect())
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    assert sum(words(r.text) for r in mixed.collect()) == want


def test_tables_without_rows(docs, spark):
    none = docs([])
    assert mixing.mix_marks(none).count() == 0
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.dedup_document_lines(none).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.chat_digest(chat_format.format_conversations(turns)).count() == 0


def test_equal_texts_are_grouped_and_one_row_stays(docs, some_texts):
    rows = [*some_texts, (20, "o n e", "z"), (21, "o n e", "z"), (22, " ", "z")]
    got = exact_dedup.duplicate_groups(docs(rows)).collect()
    sign = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(sign(t), []).append((-len(t or ""), i is None, i))
    assert len(got) == len(rows)
    for r in got:
        group = next(g for s, g in groups.items() if hashlib.sha256(s.encode()).hexdigest() == r.text_sha256)
        assert (r.group_size, r.keep_id) == (len(group), min(group)[2])
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs(rows, *CLASH)).count() == len(groups)


def test_a_small_filter_only_raises_false_alarms(docs, monkeypatch):
    rows = [(i, f"text {i % 700}", "a") for i in range(1000)]
    want = sorted(map(str, exact_dedup.duplicate_groups(docs(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "LEAST_PLACES", 64)
    monkeypatch.setattr(exact_dedup, "MOST_PLACES", 64)
    assert sorted(map(str, exact_dedup.duplicate_groups(docs(rows)).collect())) == want


@pytest.mark.parametrize("small", [True, False])
def test_lines_above_the_ratio_go(docs, monkeypatch, small):
    if not small:
        monkeypatch.setattr(line_dedup.common, "BROADCAST_BYTES", -1)
    rows = [(i, f"menu\nbody {i}\n\nmenu\nrare {i // 20}", "s" if i % 2 else None) for i in range(40)]
    rows += [(100, None, "s"), (101, "menu", "other"), (102, "", "s")]
    got = line_dedup.dedup_document_lines(docs(rows, (5,), "drops int"), ratio=0.6).collect()
    by = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.drops == 5 for r in got)
    assert by[101] == "menu" and by[100] == "" and by[102] == ""
    for i in range(40):
        assert by[i] == f"body {i}\n\nrare {i // 20}"


def test_lines_of_a_part_of_a_source_go_and_chance_lines_stay(docs):
    notice, pair = "all rights of this text are reserved", "a line that only two documents have"
    rows = [(i, f"body {i}\n{notice if i % 20 == 0 else ''}\n{'Yes it is.' if i % 20 == 1 else ''}", "s") for i in range(200)]
    rows += [(900 + i, f"{pair}\nmenu", "t") for i in range(2)] + [(910 + i, f"own {i}\nmenu", "t") for i in range(8)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_document_lines(docs(rows)).collect()}
    for i in range(200):
        assert got[i] == (f"body {i}\n" if i % 20 == 0 else rows[i][1])
    assert got[900] == pair and got[910] == "own 0"


def test_chats_read_back(spark):
    odd = ["", None, "\\", "\\b", "<|user|>\n", "</turn>\n", "<&>", "a\\l<>\\g", "x" * 70_000, "né 日本", "\n"]
    rows = [(k % 3, k, ["user", "assistant", "assistant", None, "a<|b"][k % 5], odd[k % 11]) for k in range(60)]
    rows += [(None, 1, "user", "no id"), (7, None, "assistant", "b"), (7, None, "assistant", "a"), (7, None, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat_format.format_conversations(frame)
    got = {r.conv_id: r for r in chat_format.chat_digest(formatted).collect()}
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == lengths[c]
        merged = sum(k == 0 or turns[k - 1][1] != turns[k][1] for k in range(len(turns)))
        assert got[c].n_messages == merged
    assert Counter(type(r.n_turns) for r in got.values()) == {int: len(by)}
