"""The pipeline on a small corpus, stage by stage, against plain Python."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_line_dedup import brute as brute_lines

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for d in range(120):
        toxic = d % 6 == 0
        text = line(30) + "\n" + line(30) + (" scumwretch vilefoul" if toxic else "")
        rows.append([d, text, "en", r.choice(["a", "b", None])])
        labels.append((d, 1, int(toxic)))
    base = rows[7][1]
    rows.append([200, base.replace("\n", " "), "en", "a"])  # a copy whose one line is new
    rows += [[201, None, "en", "a"], [202, "", None, "b"], [203, base, "en", "b"], [204, line(5000), "de", None], [204, rows[-1][1], "de", None]]
    return [(d, t, g, s, None if t is None else len(t), "x") for d, t, g, s in rows], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs.collect())
    return rows, labels, out, folder


def test_toxic_documents_go_and_others_stay(stages):
    rows, labels, out, _ = stages
    toxic = {d for d, _, y in labels if y}
    assert sorted((r.doc_id, r.text or "") for r in out[0]) == sorted((d, t or "") for d, t, *_ in rows if d not in toxic)


def test_lines(stages):
    before = {(r.doc_id, r.text) for r in stages[2][0]}
    want = {d: kept for d, _, _, kept in brute_lines([(d, t) for d, t in sorted(before, key=lambda x: x[0]) if d != 204])}
    got = {r.doc_id: r.text or "" for r in stages[2][1] if r.doc_id != 204}
    assert got == want
    assert len(stages[2][1]) == len(stages[2][0])
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in stages[2][1])


def test_one_of_each_group(stages):
    before, after = stages[2][1], stages[2][2]
    # line dedup emptied 203; null, empty and emptied texts are one group; 200 is a near copy of 7
    texts = Counter(r.text or "" for r in after)
    assert max(texts.values()) == 1
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - {200, 202, 203}


def test_mix(stages):
    before, after = stages[2][2], stages[2][3]
    size, total = Counter(), Counter()
    for r in before:
        size[r.source] += len((r.text or "").split())
    for r in after:
        total[r.source] += len((r.text or "").split())
    words, level = sum(size.values()), None
    weight = {"a": 1, "b": 2, None: 3}
    target, full = {}, set()
    while True:
        free = [s for s in size if s not in full]
        level = (words - sum(3 * size[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else weight[s] * level for s in size}
    for s in size:
        assert abs(total[s] - target[s]) <= max(len((r.text or "").split()) for r in before if r.source == s)
    known = {(r.doc_id, r.text, r.source) for r in before}
    copies = Counter((r.doc_id, r.text, r.source) for r in after)
    assert set(copies) <= known and max(copies.values()) <= 3


def test_packed(stages):
    docs, pieces = stages[2][3], stages[2][4]
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in docs)
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_last_stage(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(P.run(spark, stages[3]).collect()) == key(stages[2][4])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
