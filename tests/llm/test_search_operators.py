"""Decontamination, hard negatives and spelling variants against brute force, with nulls and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratafs.llm import decontaminate, negatives, spelling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# decontamination


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéßñ9", k=rng.randint(1, 5))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(n)) for i, n in enumerate((10, 14, 40, 9, 3, 25, 11))]
    items += [(7, items[1][1].upper()), (8, None), (9, ""), (10, "-- !"), (11, "zebra"), (None, items[2][1]), (4, items[4][1]), (12, items[0][1]), (13, "ab " * 12)]
    held = [items[i][1] for i in (0, 1, 2, 3, 4, 5)]
    docs = [prose(rng.randint(0, 60)) for _ in range(20)]
    docs += [f"{prose(7)}, {t}. {prose(5)}" for t in held] * 2
    docs += [" ".join([*words(t)[:5], "amid", *words(t)[5:]]) for t in held[:2]]  # a word between: proximity alone
    docs += [" ".join([*words(t)[:2], *words(t)[3:1:-1], *words(t)[4:]]) for t in held]
    docs += [" ".join(words(items[2][1])[5:22]), "ab " * 40, "a Zebra!", None, "", "...", held[0], prose(5000) + f" {held[1]}"]
    half = words(held[0])
    docs += [" ".join(half[:5]), " ".join(half[5:])]  # neighbours in a segment that only match across their border
    return [(i, t) for i, t in enumerate(docs)] + [(3, held[2]), (None, held[3])], items


def near_and_exact(doc, item, slack, counts):
    """(words hit, exact, near) of one item in one document, by trying every place."""
    d, it = words(doc), words(item)
    span, hit, exact, near = min(10, len(it)), set(), False, False
    for st in range(len(it) - span + 1 if span else 0):
        w = it[st : st + span]
        rarest = min(range(span), key=lambda j: (counts[w[j]], j))
        for s in range(len(d) - span + 1):
            if d[s : s + span] == w:
                exact = True
                hit |= set(range(s, s + span))
            if d[s + rarest] == w[rarest]:
                near |= all(w[j] in d[max(0, s + j - slack) : s + j + slack + 1] for j in range(span) if j != rarest)
    return hit, exact, near


@pytest.fixture(scope="module")
def contaminated():
    docs, items = texts()
    counts = Counter(w for _, t in docs for w in words(t))
    want = defaultdict(list)
    for i, t in docs:
        hit, exact, near = set(), set(), set()
        for item, x in items:
            h, e, n = near_and_exact(t, x, 2, counts)
            hit |= h
            if item is not None:
                exact |= {str(item)} if e else set()
                near |= {str(item)} if n else set()
        want[i].append((len(words(t)), len(hit), sorted(hit), sorted(exact), sorted(near)))
    return docs, items, want


@pytest.mark.parametrize("block,segment,part,candidates", [(250_000, 4 << 20, 4096, 1 << 20), (60, 900, 7, 5), (1, 1, 1, 1)])
def test_matches_against_brute_force(spark, contaminated, monkeypatch, block, segment, part, candidates):
    docs, items, want = contaminated
    monkeypatch.setattr(decontaminate, "PART", part)
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int").repartition(2)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    if block == 1:  # a block for each text: a few will do
        right = right.where("item_id in (1, 2, 4, 7)")
    got = defaultdict(list)
    for r in decontaminate.decontaminate(left, right, block=block, segment_bytes=segment).collect():
        covered = [k for s in r["spans"] for k in range(s["start"], s["start"] + s["length"])]
        assert len(covered) == len(set(covered))
        got[r["doc_id"]].append((r["n_words"], r["n_hit"], sorted(covered), r["item_ids"], r["near_ids"]))
    if block == 1:
        for i, rows in got.items():
            assert sorted((n, [x for x in e if x in ("1", "2", "4", "7")], [x for x in m if x in ("1", "2", "4", "7")]) for n, _, _, e, m in want[i]) == sorted((n, e, m) for n, _, _, e, m in rows)
        return
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert any(m != e for rows in want.values() for *_, e, m in rows) and any(e for rows in want.values() for *_, e, _ in rows)


def test_no_documents_and_no_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    made = decontaminate.decontaminate(docs, items.limit(0))
    assert sorted(tuple(r) for r in made.collect()) == [(1, 2, 0, [], [], []), (2, 0, 0, [], [], [])]
    assert decontaminate.decontaminate(docs.limit(0), items).columns == made.columns
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_a_frequent_token_is_split_over_segments(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the " * 50).alias("text"))
    index = decontaminate.build_index(docs, segment_bytes=2000)
    sizes = [len(r["steps"]) for r in index.collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 600
    assert decontaminate.frequencies(index, np.unique(decontaminate.tokens_of(b"the"))).tolist() == [20_000]


# hard negatives


def vectors():
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(0, 0.4, 6) + 0.35]) for i in range(300)]
    rows += [(300 + k, k % 4, rows[5][2]) for k in range(30)]  # one vector often, under every label
    rows += [(400, 1, None), (401, None, rows[1][2]), (402, 1, [1.0, None]), (403, 1, [1.0, float("nan")]), (404, 2, [float("inf")]), (None, 1, rows[2][2])]
    rows += [(405, 3, []), (406, 3, [0.5, 0.25]), (407, 2, rows[3][2] + [9.0, 9.0]), (408, 1, [-1.0] * 6), (409, 1, [0.0] * 6), (500, 77, rows[4][2]), rows[8], rows[20]]
    return rows


def mined(rows, positives=5, negatives_=10):
    sound = [(i, c, [int(np.floor(x * 256)) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in [x for x in sound if x[0] % 10 == 0]:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in sound if i != a))
        for p, i, c in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives_]
            out += [(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,cells,batch", [(16_384, 1 << 22, 10_000), (7, 64, 11)])
def test_negatives_against_brute_force(spark, monkeypatch, block, cells, batch):
    rows = vectors()
    monkeypatch.setattr(negatives, "CELLS", cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        table = spark.createDataFrame([(i, c, v, "x", 1.0) for i, c, v in rows], "vec_id long, label int, embedding array<float>, rank string, score double").repartition(3)
        got = sorted(tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, block=block).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = mined([(i, c, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, c, v in rows])
    assert got == want and len(want) > 200


def test_negatives_without_rows_or_anchors(spark):
    table = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") == 1).count() == 0
    assert negatives.hard_negatives(table, F.col("vec_id") == 9).count() == 0
    assert negatives.hard_negatives(table, F.col("vec_id") == 1).count() == 0


def test_inner_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 28, 1 << 40):
        a, b = (rng.integers(-top, top, (3, 2)) // (1 if top < 1 << 40 else 1 << 10) for _ in range(2))
        assert negatives.inner(a, b).tolist() == (a.astype(object) @ b.astype(object).T).tolist()
    with pytest.raises(OverflowError):
        negatives.inner(np.array([[1 << 62, 1 << 62]]), np.array([[4, 4]]))


# spelling variants


def vocabulary():
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdeéÿ", k=rng.randint(6, 9))) for _ in range(25)]
    found = Counter()
    for s in stems:
        found[s] += rng.randint(100, 3000)
        for _ in range(12):
            p, c = rng.randrange(len(s)), rng.choice("abcdeéÿ")
            v = rng.choice((s[:p] + s[p + 1 :], s[:p] + c + s[p:], s[:p] + c + s[p + 1 :], s[:p] + c + s[p + 1 :] + c))
            found[v] += rng.randint(1, 60)
    found["z" * 3000] += 9
    found["z" * 2999] += 90
    found["z" * 2999 + "y"] += 900
    return found


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


def grouped(found):
    near = {w: [v for v in found if edits(w, v)] for w in found}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-found[v], v), default=None)
        form[w] = best if best is not None and found[best] >= 5 * found[w] else None
    out = []
    for w in found:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, found[w], len(near[w]), form[w] and found[form[w]]))
    return sorted(out)


@pytest.mark.parametrize("cell,symbols,made", [(200, None, 1 << 21), (2, (2, 4, 0), 1 << 21), (1, (2, 3, 4, 0), 997), (3, (0,), 1 << 21)])
def test_variants_against_brute_force(spark, monkeypatch, cell, symbols, made):
    found = vocabulary()
    if made < 1 << 21:  # pieces of long words take long
        found = Counter({w: n for w, n in found.items() if len(w) < 100} | {"z" * 300: 9, "z" * 299: 80})
    monkeypatch.setattr(spelling, "MADE", made)
    rows = [(w, n, 1) for w, n in found.items()] + [(None, 7, 1)]
    first = rows[0]
    rows[0] = (first[0], first[1] - 1, 1)
    rows.append((first[0], 1, 1))  # a repeated word
    table = spark.createDataFrame(rows, "word string, n long, id int").repartition(3)
    got = sorted((tuple(r) for r in spelling.variants(table, cell=cell, symbols=symbols).collect()))
    assert got == grouped(found)
    assert any(root not in (w, form) for w, form, root, *_ in got)  # a chain of forms


def test_words_of_documents(spark):
    texts = [(1, "Colour colour COLOUR colöur9colour x×÷y"), (1, "Colour"), (2, None), (None, "colour " * 400), (3, ""), (4, "É" * 70_000), (5, "élan élans")]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in spelling.count_words(table, damage=3, length=0, count=1).collect()}
    assert got == want
    assert {r["word"] for r in spelling.count_words(table, count=2).collect()} == {w for w, n in Counter(re.findall("[a-zà-ÿÀ-ß]+", " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in texts))).items() if len(w) >= 6 and n >= 2}
    assert spelling.variants(spelling.count_words(table.limit(0))).count() == 0


@pytest.mark.parametrize("made", [1 << 21, 40])
def test_neighbourhoods_hold_all_edits(monkeypatch, made):
    monkeypatch.setattr(spelling, "MADE", made)
    for symbols, word in ((3, "abcabd"), (0, "éa"), (2, "a"), (4, "")):
        codes = spelling.symbols_of(word, symbols).reshape(1, -1)
        letters = spelling._alphabet(symbols, spelling.LETTERS)
        one = codes[0].tolist()
        want = {tuple(one)} | {tuple(one[:i] + one[i + 1 :]) for i in range(len(one))}
        want |= {tuple(one[:i] + [c] + one[i:]) for i in range(len(one) + 1) for c in letters.tolist()}
        want |= {tuple(one[:i] + [c] + one[i + 1 :]) for i in range(len(one)) for c in letters.tolist()}
        hashes = {int(spelling.reduced_hash(np.array([w], np.uint64).reshape(1, -1))[0]) for w in want}
        got = [int(k) for _, keys in spelling.neighbourhood(codes, letters) for k in keys]
        assert set(got) == hashes and (made < 100 or len(got) == len(set(got)))


def test_stored_segments_are_read_a_few_at_a_time(spark):
    """Row groups of the index are bounded by bytes though a task writes fewer than a hundred segments: readers hold whole ones."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.integers(0, 1 << 40, 60_000).astype(str))) for i in range(40)]
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), segment_bytes=1 << 19)
    groups = []
    for path in index.inputFiles():
        made = pq.ParquetFile(path.removeprefix("file://")).metadata
        groups += [made.row_group(i) for i in range(made.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and len(groups) > 1
    assert max(g.total_byte_size for g in groups) < 24 << 20
