import hashlib
import random

from assetlens.llm import line_dedup as L

SPACE = " \t\n\v\f\r"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    lines = [(d, k, x) for d, t in sorted(docs, key=lambda r: r[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    gone, first = set(), {}
    for d, k, x in lines:
        s = x.strip(SPACE)
        if not s:
            continue
        if s in first:
            gone.add((d, k))
            continue
        if any(one_edit(s, y) for y in first):
            gone.add((d, k))
        first[s] = (d, k)
    return sorted((d, 0 if t is None else t.count("\n") + 1, sum((d, k) in gone for k in range((t or "").count("\n") + 1)), "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)) for d, t in docs)


def rows(frame):
    return sorted((r.doc_id, r.n_lines, r.n_removed, r.kept or "") for r in frame.collect())


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ") for _ in range(r.randint(1, 30))) for _ in range(40)]
    docs = []
    for i in range(150):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(x) + 1)
                x = r.choice([x[:k] + r.choice("abz") + x[k:], x[:k] + x[k + 1 :], x[:k] + r.choice("abz") + x[k + 1 :]])
            lines.append(r.choice(["", " ", "\t"]) + x + r.choice(["", " ", "\r"]))
        docs.append((i * 2, "\n".join(lines)))
    return docs + [(1001, None), (1003, ""), (1005, "\n \n"), (1007, docs[3][1])]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, bucket int").repartition(4)


def test_brute_force(spark, monkeypatch):
    docs = corpus(1)
    assert rows(L.dedup_lines(frame(spark, docs))) == brute(docs)
    monkeypatch.setattr(L, "COMPARED", 2)
    docs = corpus(2)
    assert rows(L.dedup_lines(frame(spark, docs))) == brute(docs)


def test_cases(spark):
    common = "the same first half "
    docs = [(i, f"{common}{i:05d}{'x' * (i % 3)}\n{common}") for i in range(200)]
    assert rows(L.dedup_lines(frame(spark, docs))) == brute(docs)
    assert L.dedup_lines(frame(spark, docs).limit(0)).collect() == []
    twice = L.dedup_lines(frame(spark, [(1, "one line of text"), (1, "one line of text"), (None, "one line of text!")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in twice) == [("1", 0), ("1", 0), ("None", 1)]


def test_halves_lose_no_pair():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(2, 12)))
        k = r.randrange(len(a))
        for b in (a[:k] + a[k + 1 :], a[:k] + "c" + a[k + 1 :], a[:k] + "c" + a[k:]):
            assert set(L.halves(a)) & set(L.halves(b)) and (L.parity(a) ^ L.parity(b)).bit_count() <= 2


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(docs)]
    assert sorted(tuple(r) for r in L.op2_line_dedup(spark, sf).collect()) == want


def test_variants_meet_where_lines_are_one_edit_apart():
    r = random.Random(7)
    for _ in range(300):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(1, 12)))
        k = r.randrange(len(a))
        b = r.choice([a[:k] + "x" + a[k:], a[:k] + "x" + a[k + 1 :], a[:k] + "xy" + a[k + 1 :], a[:k] + a[k + 1 :]])
        sent = [{(int(x), int(y), int(z)) for part in L.variants(t) for x, y, z in zip(*part, strict=True)} for t in (a, b)]
        roles = {L.WHOLE: L.SHORTER, L.SHORTER: L.WHOLE, L.SAME_PLACE: L.SAME_PLACE}
        meet = any((x, y, roles[z]) in sent[1] for x, y, z in sent[0])
        assert meet == L.one_edit(a, b) == (a != b and one_edit(a, b))


def test_long_lines_take_time_in_their_length(monkeypatch):
    import time

    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(10_000)) * 1000  # 10 MB
    began = time.time()
    assert sum(len(low) for low, _, _ in L.variants(line)) == 2 * len(line) + 1
    assert L.one_edit(line, line[:5_000_000] + line[5_000_001:]) and not L.one_edit(line, line[:-2])
    assert time.time() - began < 60
    short = line[:1000]
    whole = [{(int(x), int(z)) for part in L.variants(short) for x, _, z in zip(*part, strict=True)}]
    monkeypatch.setattr(L, "AT_ONCE", 64)
    assert whole[0] == {(int(x), int(z)) for part in L.variants(short) for x, _, z in zip(*part, strict=True)}


def test_long_lines(spark):
    r = random.Random(9)
    line = "".join(r.choice("abcdefgh ") for _ in range(200_000)).strip()
    docs = [(1, line), (2, line[:70_000] + "X" + line[70_001:]), (3, line[:-1]), (4, line + "\nshort\nshort!"), (5, "a\nb\nab")]
    got = {r.doc_id: r.n_removed for r in L.dedup_lines(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
