"""Each pipeline stage on what its predecessor kept, against brute force."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from stratafs.llm import quality
from tests.llm.test_operators import brute_quality, brute_repeats, similar_groups, vocabulary, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    rng, vocab = random.Random(21), vocabulary(900)
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(60)
    rows = [(i, prose(rng.randint(30, 150))) for i in range(40)]
    rows += [(100 + i, f"{prose(30)}\n{passage}\n{prose(20)}") for i in range(6)]
    long = prose(300).split()
    for i in range(4):
        near = list(long)
        near[rng.randrange(300)] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, "too short"), (303, " ".join(["spam"] * 80)), (304, None), (305, "")]
    rows += [(306, f"{prose(40)} mail me.x@corp.example or +1 (377) 555-0271 {prose(10)}"), (5, rows[5][1]), (None, prose(50))]
    return [(i, t, "en", None if (i or 0) % 7 == 0 else "src", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """The columns of each stage's output rows, from the input on."""
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "PII", "packing"]
    for rows in stages[1:-1]:
        assert rows and tuple(rows[0].__fields__) == corpus_pipeline.COLUMNS
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_quality_stage(stages):
    def kept(text):
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = sum(1 for x in (text or "").split("\n") if words(x))
        return not (n < 20 or 100 * repeat > 30 * n or 10 * chars < 15 * n or chars > 40 * n or 10 * symbols > 3 * n or 2 * dup > lines)

    assert quality.CURRENT == "2025-text"
    assert Counter(stages[1]) == Counter(r for r in stages[0] if kept(r["text"]))
    assert {302, 303, 304, 305}.isdisjoint(r["doc_id"] for r in stages[1])


def test_near_duplicate_stage(stages):
    rows = stages[1]
    groups = [[rows[i] for i in g] for g in similar_groups([(r["doc_id"], r["text"]) for r in rows])[0]]
    want = sorted(min((r["doc_id"] is None, r["doc_id"] or 0) for r in g) for g in groups)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stages[2]) == want
    ids = {r["doc_id"] for r in stages[2]}
    assert 5 in ids and not ids & {300, 301} and len(ids & {200, 201, 202, 203}) == 1


def test_substring_stage(stages):
    want = brute_repeats([(r["doc_id"], r["text"]) for r in stages[2]])
    after = {r["doc_id"]: r for r in stages[3]}
    assert len(after) == len(stages[2])
    for r in stages[2]:
        _, removed, kept = want[r["doc_id"], r["text"]]
        assert " ".join(words(after[r["doc_id"]]["text"])) == kept
        assert removed or after[r["doc_id"]]["text"] == r["text"]
        assert (after[r["doc_id"]]["lang"], after[r["doc_id"]]["source"]) == (r["lang"], r["source"])
    assert sum(want[r["doc_id"], r["text"]][1] > 0 for r in stages[2]) == 5


def test_pii_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[3:5])
    assert before.keys() == after.keys()
    assert "[EMAIL]" in after[306] and "[PHONE]" in after[306] and "corp.example" not in after[306] and "555" not in after[306]
    assert all(after[i] == before[i] for i in before if i != 306)


def test_packing_stage(stages):
    pieces = defaultdict(list)
    for r in stages[5]:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert pieces.keys() == {r["doc_id"] for r in stages[4]}
    for parts in pieces.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]


def test_empty_input(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
