"""The index over real file trees: life cycle, moves, rules, store, gate, command line."""

import os

import pytest

from stratafs import cli, review
from stratafs.index import Index
from stratafs.sources import gate, walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "src").mkdir(parents=True)
    (root / "a.md").write_text("---\nk: 1\n---\n# Guide\n\nFirst words\nof it.\n\n## Setup\n")
    (root / "b.txt").write_text("  plain line\nmore")
    (root / "src" / "c.py").write_text("print(1)\n")
    (root / "bin.dat").write_bytes(b"a\0b")
    (root / ".git").mkdir()
    (root / ".git" / "HEAD").write_text("x")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "p.js").write_text("12345")
    os.symlink(root / "b.txt", root / "link.txt")
    return root


def kinds(events):
    return sorted((r["event_type"], os.path.basename(r["path"])) for r in events.collect())


def test_life_cycle(spark, tmp_path, tree):
    index = Index(spark, str(tmp_path / "store"), [str(tree)], home="/home/none")
    assert kinds(index.scan(now=1000)) == [("created", x) for x in ("a.md", "b.txt", "bin.dat", "c.py")]
    assert kinds(index.scan(now=2000)) == []
    (tree / "a.md").write_text("---\nk: 22\n---\n# Guide\n\nFirst words\nof it.\n\n## Setup\n")
    (tree / "b.txt").rename(tree / "moved.txt")
    (tree / "copy.py").write_text("print(1)\n")
    os.link(tree / "bin.dat", tree / "hard.dat")
    assert kinds(index.scan(now=3000)) == [("copied", "copy.py"), ("deleted", "b.txt"), ("hardlinked", "hard.dat"), ("minor_change", "a.md"), ("moved", "moved.txt")]
    (tree / "src" / "c.py").unlink()
    (tree / ".indexignore").write_text("*.dat\n")
    (tree / "a.md").write_text("other words")
    assert kinds(index.scan(now=4000)) == [("created", ".indexignore"), ("deleted", "bin.dat"), ("deleted", "c.py"), ("deleted", "hard.dat"), ("updated", "a.md")]
    page = index.events_since(0, 5)
    assert len(page.events) == 5 and page.has_more and page.next_cursor == 5
    assert index.events_since(10_000).events == []
    assert [r["title"] for r in index.find("guide").collect()][:1] == ["Guide"]
    assert [os.path.basename(r["path"]) for r in index.find("print").collect()] == ["copy.py"] and index.find("print 2").count() == 0
    assert [(r["status"], r["id"]) for r in index.store.table("scan_runs").orderBy("id").collect()] == [("complete", i) for i in (1, 2, 3, 4)]
    assert index.find_ext(".PY").collect()[0]["total_matched"] == 1
    assert index.find_path("*mov?d*").count() == 1 and index.find_path("nothing").count() == 0
    out = index.outline(str(tree / "moved.txt")).first()
    assert (out["title"], out["summary"]) == ("b", "plain line")  # of the first path with this content
    catalog = index.store.table("catalog").collect()
    assert [(os.path.basename(r["path"]), r["total_bytes"], r["file_count"]) for r in catalog] == [("node_modules", 5, 1)]
    assert index.audit()["tier1"].first()["files"] == index.health(now=4100)["total_active_paths"]
    assert index.health(now=4100)["is_stale"] is False and index.health(now=99_000)["is_stale"] is True
    assert index.manifest().count() == index.health()["total_active_paths"]
    assert [(r["path"], r["n_paths"]) for r in index.get(out["content_hash"]).collect()] == [(str(tree / "moved.txt"), 1)]
    (tree / "moved.txt").unlink()
    index.scan(now=5000)
    assert [(r["path"], r["n_paths"]) for r in index.get(out["content_hash"]).collect()] == [(None, 0)] and index.get("none").count() == 0
    shots = [(r["scan_id"], r["files_scanned"], r["events_emitted"], r["tier2_dirs_cataloged"]) for r in index.store.table("snapshots").orderBy("scan_id").collect()]
    assert shots == [(1, 4, 4, 1), (2, 4, 0, 1), (3, 6, 5, 1), (4, 4, 5, 1), (5, 3, 1, 1)]
    assert index.audit(sort_by="count")["largest"].count() == 1 and index.audit(min_bytes=6)["largest"].count() == 0
    assert index.map()["totals"].first()["total_active_paths"] == 3 and index.freshness(5001) == {"as_of": 5000, "is_stale": False, "reason": None}
    assert "95000 seconds" in index.freshness(100_000)["reason"]


def test_partial_scan_leaves_other_roots(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for d in (one, two):
        d.mkdir()
        (d / "f.txt").write_text(d.name)
    index = Index(spark, str(tmp_path / "store"), [str(one), str(two), str(tmp_path / "missing")])
    assert len(kinds(index.scan(now=1))) == 2
    (one / "f.txt").unlink()
    (two / "f.txt").unlink()
    assert kinds(index.scan([str(one)], now=2)) == [("deleted", "f.txt")]
    assert index.health()["total_active_paths"] == 1


def test_stored_search_is_that_over_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratafs.functions.patterns import search_terms
    from stratafs.operators import search

    root = tmp_path / "r"
    root.mkdir()
    texts = ["the café is at the sea", "sea at the cafe the cafe", "state-of-the-art of the sea", "", "nothing here", "the of the of the sea", "of the", "CAFÉ"]
    for i, t in enumerate(texts):
        (root / f"f{i}.txt").write_text(t)
    index = Index(spark, str(tmp_path / "store"), [str(root)])
    index.scan(now=1)
    (root / "f9.txt").write_text("a later sea of the cafe")
    index.scan(now=2)
    rows = [(f"f{i}", t.strip(), "", t.strip(), t) for i, t in [*enumerate(texts), (9, "a later sea of the cafe")]]
    docs = spark.createDataFrame(rows, "title string, summary string, topic_text string, s2 string, search_text string").drop("s2").withColumn("content_hash", F.sha2("search_text", 256))
    for query in ("sea", "cafe", "the-sea", "of-the", "of-the sea", "Café the", "state-of-the-art", "absent", "sea absent", "later"):
        terms = search_terms(query)
        want = {r["content_hash"]: round(r["rank"], 9) for r in search.bm25(docs, "content_hash", ["title", "topic_text", "summary", "search_text"], terms).collect()}
        state = index.store.state()
        placed, counts = index.store.table("postings", state), state["counts"]
        got = search.ranked(placed, "content_hash", terms, counts["docs"], counts["tokens"]).collect()
        assert {r["content_hash"]: round(r["rank"], 9) for r in got} == want, query
        best = sorted((v, k) for k, v in want.items())[:2]
        assert [(round(r["rank"], 9), r["content_hash"]) for r in search.top(placed, "content_hash", terms, 2, counts["docs"], counts["tokens"], first=1).collect()] == best, query
    assert len(want) == 1 and index.find("").count() == 0


def test_a_commit_that_fails_anywhere_leaves_the_last_state(spark, tmp_path, monkeypatch):
    from stratafs.sources.store import CommitConflict, Store

    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *xs: spark.createDataFrame([(x, "h", None, "c") for x in xs], store.table("read_audit").schema)
    read = lambda s=store: sorted(r["path"] for r in s.table("read_audit").collect())
    store.commit(read_audit=rows("a"))
    base = store.state()
    # before the pointer
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(read_audit=rows("b"))
    assert read() == ["a"] and store.state() == base
    # while the pointer is written: none or half of it is there
    for number, half in ((base["next"], b""), (base["next"] + 1, b'{"generation": 2, "ta')):
        out = store._fs.create(store._name(number))
        out.write(bytearray(half))
        out.close()
        assert read() == ["a"] and store.state()["generation"] == 1
    # whoever goes on passes over them
    store.commit(append={"read_audit": rows("b")})
    assert read() == ["a", "b"] and store.state()["generation"] == 2
    # two writers from one state
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    start = one.state()
    two.commit(start, append={"read_audit": rows("c")})
    with pytest.raises(CommitConflict):
        one.commit(start, read_audit=rows("d"))
    # what replaces no table that has changed follows the other
    one.commit(start, append={"read_audit": rows("e")})
    one.commit(start, scan_runs=store.table("scan_runs"))
    assert read() == ["a", "b", "c", "e"]
    for i in range(70):
        state = store.state()
        if i < 2:
            store.commit(state, append={"read_audit": rows(f"x{i}")})
    assert len(store.state()["tables"]["read_audit"]) == 6
    monkeypatch.setattr("stratafs.sources.store.MOST_PARTS", 6)
    store.commit(append={"read_audit": rows("z")})
    assert len(store.state()["tables"]["read_audit"]) == 1 and read() == ["a", "b", "c", "e", "x0", "x1", "z"]
    assert store.vacuum(1) > 0 and read() == ["a", "b", "c", "e", "x0", "x1", "z"]


def test_requests_run_and_recover(spark, tmp_path, tree, monkeypatch):
    index = Index(spark, str(tmp_path / "store"), [str(tree)], home="/home/none")
    assert index.due(100) and index.request("full", None, 10) == 1 and index.request("roots", [str(tree)], 11) == 2
    assert index.drain(20) == 2 and index.drain(21) == 0
    assert [(r["status"], r["scan_run_id"]) for r in index.store.table("scan_requests").orderBy("id").collect()] == [("complete", 1), ("complete", 2)]
    assert not index.due(100) and index.due(20 + 86_400)
    monkeypatch.setattr(Index, "_scan", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    index.request("full", None, 30)
    assert index.drain(31) == 1
    last = index.store.table("scan_requests").where("id = 3").first()
    assert (last["status"], last["error"], index.store.table("scan_runs").where("id = 3").first()["status"]) == ("failed", "disk", "failed")
    run = index._begin(40)  # and then the process ends
    index.recover("gone")
    assert index.store.table("scan_runs").where(f"id = {run}").first()["error"] == "gone"


def test_events_honour_rules_of_directories_and_walk_new_ones(spark, tmp_path):
    root = tmp_path / "r:1"  # a colon is nothing special
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "old").mkdir()
    (root / "sub" / ".indexignore").write_text("  private*\n[ab]x.txt\nhidden/\n[catalog]\nbig/\n")
    for name in ("sub/open.txt", "old/a.txt", "old/b.txt"):
        (root / name).write_text(name)
    index = Index(spark, str(tmp_path / "store"), [str(root)], home="/home/none")
    assert len(kinds(index.scan(now=1))) == 4
    (root / "sub" / "hidden").mkdir()
    (root / "sub" / "big").mkdir()
    (root / "fresh" / "in").mkdir(parents=True)
    for name in ("sub/private.txt", "sub/deep/private2", "sub/ax.txt", "sub/cx.txt", "sub/hidden/y", "sub/big/z", "fresh/1.txt", "fresh/in/2.txt", "fresh/in/3.tmp"):
        (root / name).write_text(name)
    (root / "old").rename(tmp_path / "elsewhere")
    named = ["sub/private.txt", "sub/deep/private2", "sub/ax.txt", "sub/cx.txt", "sub/hidden/y", "sub/big/z", "fresh"]
    flushes = [(str(root / n), "Create", None, 5) for n in named] + [(str(root / "old"), "Delete", None, 5)]
    got = index.apply(spark.createDataFrame(flushes, "key string, kind string, from_key string, flush_ms long"), 2)
    assert kinds(got) == [("created", "1.txt"), ("created", "2.txt"), ("created", "cx.txt"), ("deleted", "a.txt"), ("deleted", "b.txt")]
    assert [os.path.basename(r["path"]) for r in index.find("cx").collect()] == ["cx.txt"]
    assert kinds(index.scan(now=3)) == []


def test_only_two_headers_are_sections():
    from stratafs.operators import policy

    rules = policy.parse_rules("[abc]\n  *.log  \n[catalog]\n\tbig/\n[other-thing]\n[no-embed]\nx\n", "/r")
    assert [r.source.strip() for r in rules.ignored] == ["[abc]", "*.log"] and [r.source.strip() for r in rules.cataloged] == ["big/", "[other-thing]"]
    for path, is_dir, tier in (("/r/a", False, policy.IGNORED), ("/r/d/x.log", False, policy.IGNORED), ("/r/d/big", True, policy.CATALOGED), ("/r/x", False, policy.INDEXED), ("/r/d", False, policy.INDEXED)):
        assert policy.classify_one([rules], path, is_dir) == tier


def test_gate(tmp_path):
    root, out = tmp_path / "r", tmp_path / "out.txt"
    (root / ".ssh").mkdir(parents=True)
    (root / "ok.txt").write_text("yes")
    (root / ".ssh" / "id").write_text("no")
    out.write_text("no")
    os.symlink(out, root / "sneaky.txt")
    content, row = gate.read(str(root / "ok.txt"), [str(root)], "test")
    assert content == b"yes" and row["caller"] == "test" and len(row["content_hash"]) == 64
    for path, kind in ((root / "gone", "io"), (root / ".." / "out.txt", "outside_allowlist"), (root / "sneaky.txt", "outside_allowlist"), (root / ".ssh" / "id", "ignored_path")):
        with pytest.raises(gate.GateError) as e:
            gate.read(str(path), [str(root)])
        assert e.value.kind == kind


def test_roots_and_reviews():
    roots = gate.parse_roots("# c\n/a\n!/b\n\n")
    assert roots == [("/a", True), ("/b", False)] and gate.parse_roots(gate.format_roots(roots)) == roots
    assert gate.roots_changed(roots, [("/b", True)]) == ({"/b"}, {"/a"})
    got = review.parse("# x\ncatalog\t~/my dir\t1 KB\twhy\nkeep  /b  1\nnope /c\n\nignore /d*\n", "/h")
    assert got == [("catalog", "/h/my dir"), ("keep", "/b"), ("ignore", "/d*")]
    text, n = review.apply_to_rules("*.x\n[catalog]\nold/\n[no-embed]\ny\n", got, "/h")
    assert n == 2 and text == "*.x\n/d[*]\n[catalog]\nold/\n~/my dir\n[no-embed]\ny\n"
    assert review.backup_summary([("redundant", "/a"), ("keep", "/b")]) == ["1 file(s) marked redundant; nothing is deleted:", "  would delete: /a", "1 file(s) kept."]


def test_command_line(spark, tmp_path, tree, capsys):
    base = ["--store", str(tmp_path / "s"), "--root", str(tree)]
    assert cli.main([*base, "scan"], spark) == 0
    assert '"event_type":"created","n":4' in capsys.readouterr().out
    for command in (["audit"], ["health"], ["triage"], ["map"], ["manifest", "--json"], ["find", "guide"], ["scan-status"], ["events-since", "0"], ["backup-audit", str(tree)], ["read", str(tree / "b.txt")], ["prune", "1d"]):
        assert cli.main([*base, *command], spark) == 0
    assert "plain line" in capsys.readouterr().out
    for command, has in ((["audit", "--full", "--sort-by", "count"], "largest"), (["audit", "--ext", "txt"], "b.txt"), (["audit", "--tier2", "--min-bytes", "1"], "tier2"), (["scan", "--paths", str(tree)], ""), (["history", str(tree / "b.txt"), "--since", "2001-01-01", "--until", "2999-01-01T00:00:00"], "created")):
        assert cli.main([*base, *command], spark) == 0
        out = capsys.readouterr()
        assert has in out.out and ("is_stale" in out.err) == (command[0] != "scan")
    listed = ["--store", str(tmp_path / "s"), "--roots-file", str(tmp_path / "roots")]
    for change, want in (("add", f"{tree}\n"), ("disable", f"!{tree}\n"), ("remove", ""), ("enable", f"{tree}\n")):
        assert cli.main([*listed, "roots", change, str(tree)], spark) == 0
        assert capsys.readouterr().out == want
    landing = tmp_path / "landing"
    landing.mkdir()
    (tree / "late.txt").write_text("late")
    (landing / "1.json").write_text('{"path": "/", "raw": "overflow", "cookie": null, "ts": "2024-01-01T00:00:00Z"}')
    assert cli.main([*listed, "init"], spark) == 0 and cli.main([*listed, "watch", str(landing), str(tmp_path / "ck"), "--once"], spark) == 0
    assert cli.main([*listed, "find", "late"], spark) == 0
    assert "late.txt" in capsys.readouterr().out


def test_watching_gives_what_a_scan_gives(spark, tmp_path, tree):
    import json
    import time

    from stratafs.streaming.watch import watch

    index = Index(spark, str(tmp_path / "store"), [str(tree)], home="/home/none")
    index.scan(now=1000)
    (tree / "b.txt").rename(tree / "renamed.txt")
    (tree / "a.md").write_text("new words")
    (tree / "fresh.txt").write_text("fresh")
    (tree / ".env").write_text("SECRET=1")
    landing = tmp_path / "landing"
    landing.mkdir()
    stamp = lambda s: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(1_700_000_000 + s))
    raw = [("b.txt", "rename_from", 7, 0), ("renamed.txt", "rename_to", 7, 0), ("a.md", "modify_data", None, 1), ("a.md", "close_write", None, 1), ("fresh.txt", "create_file", None, 2),
           (".env", "create_file", None, 2), ("a.md", "access", None, 3)]
    lines = [json.dumps({"path": str(tree / p), "raw": r, "cookie": c, "ts": stamp(s)}) for p, r, c, s in raw]
    (landing / "1.json").write_text("\n".join(lines))
    query = watch(index, str(landing), str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
        (landing / "2.json").write_text(json.dumps({"path": "/elsewhere", "raw": "modify_data", "cookie": None, "ts": stamp(5000)}))
        query.processAllAvailable()
    finally:
        query.stop()
    log = [(r["event_type"], os.path.basename(r["path"])) for r in index.store.table("events").where("scan_id is null").collect()]
    assert sorted(log) == [("created", "fresh.txt"), ("created", "renamed.txt"), ("deleted", "b.txt"), ("updated", "a.md")]
    state = lambda: sorted((r["path"], r["content_hash"]) for r in index.store.table("paths").where("disappeared is null").collect())
    followed = state()
    assert kinds(index.scan(now=2000)) == [] and state() == followed


def test_parts_of_a_walk_are_what_one_walk_finds(tmp_path, monkeypatch):
    for i in range(40):
        d = tmp_path / "huge" / f"d{i % 4}" / f"e{i % 7}" / ("node_modules" if i % 5 == 0 else f"f{i}")
        d.mkdir(parents=True, exist_ok=True)
        (d / f"x{i}.txt").write_text("x")
    (tmp_path / "huge" / "d1" / ".indexignore").write_text("e2/\n")
    reader = walk.WalkReader([str(tmp_path), str(tmp_path / "none")], "", "/")
    found = {}
    for parts in (1, 3, 10, 1000):
        monkeypatch.setattr(walk, "PARTS", parts)
        tops = reader.partitions()
        assert len(tops) >= min(parts, 20)
        found[parts] = sorted(row for top in tops for row in reader.read(top))
    assert len(found[1]) > 30 and any(row[6] for row in found[1]) and not any("/d1/e2/" in row[0] for row in found[1])
    assert all(rows == found[1] for rows in found.values())
    assert all(len(set(rows)) == len(rows) for rows in found.values())


def written_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def path_rows(spark, n, mtime):
    from pyspark.sql import functions as F

    return spark.range(n).select(
        F.concat(F.lit("/r/d"), (F.col("id") % 97).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit("/r").alias("root"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
        F.lit(mtime).cast("bigint").alias("mtime"), F.lit(1).cast("bigint").alias("size_bytes"), F.col("id").alias("inode"), F.lit(1).cast("bigint").alias("dev"), F.lit(False).alias("is_hardlink"),
        F.lit(1).cast("bigint").alias("appeared"), F.lit(None).cast("bigint").alias("disappeared"), F.lit(1).cast("bigint").alias("last_seen_scan"),
    )


def test_few_changed_paths_write_few_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratafs.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    store.commit(active=path_rows(spark, 1_000_000, 1))
    whole = written_bytes(tmp_path / "s")
    assert whole > 20_000_000
    before = store.state()["tables"]["active"]
    few = path_rows(spark, 100, 2).withColumn("gone", F.col("inode") % 10 == 0)
    store.commit(change={"active": few})
    assert written_bytes(tmp_path / "s") - whole < 500_000
    after = store.state()["tables"]["active"]
    slots = {str(r[0]) for r in few.select(store._slot("path", after["slots"])).distinct().collect()}
    assert after["base"] == before["base"] and set(after["deltas"]) == slots
    now = store.table("active")
    assert now.count() == 999_990 and now.where("mtime = 2").count() == 90
    # only the slots of some keys are read
    read = store.table("active", keys=few.where("inode = 7").select("path"))
    assert len({f.split("slot=")[1].split("/")[0] for f in read.inputFiles()}) == 1 and read.where("inode = 7").first()["mtime"] == 2


@pytest.mark.parametrize("rewrite", [4, 0])
def test_deltas_merge_as_a_dictionary_does(spark, tmp_path, monkeypatch, rewrite):
    import random

    from stratafs.sources import store as stores

    for name, n in (("SLOTS", 4), ("MOST_DELTAS", 2), ("REWRITE", rewrite)):
        monkeypatch.setattr(stores, name, n)
    rng, want = random.Random(rewrite), {}
    store = stores.Store(spark, str(tmp_path / "s"))
    empty = store.table("documents").schema
    for step in range(9):
        keys = rng.sample(range(25), rng.randint(1, 12))
        rows = [(str(k), f"b{step}", None, None, None, None, False, None, step, rng.random() < 0.3) for k in keys]
        frame = spark.createDataFrame(rows, empty.add("gone", "boolean") if "gone" not in empty.names else empty)
        if step == 4:  # replaced as a whole between
            want = {}
            rows = [(*r[:9], False) for r in rows]
            store.commit(documents=spark.createDataFrame(rows, frame.schema).drop("gone"))
        else:
            store.commit(change={"documents": frame})
        for r in rows:
            want.pop(r[0], None)
            if not r[9]:
                want[r[0]] = r[1]
        assert {r["content_hash"]: r["body_hash"] for r in store.table("documents").collect()} == want
    entry = store.state()["tables"]["documents"]
    assert max(map(len, entry["deltas"].values())) <= 2
    store.vacuum(1)
    assert {r["content_hash"]: r["body_hash"] for r in store.table("documents").collect()} == want
    left = {os.path.relpath(d, tmp_path / "s") for d, _, names in os.walk(tmp_path / "s") if "slot=" in d and names}
    assert left == set(store._folders(entry))
    base = store.state()
    store.commit(base, change={"documents": frame})
    with pytest.raises(stores.CommitConflict):
        store.commit(base, change={"documents": frame})


def test_a_batch_of_changes_leaves_other_slots_alone(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for i in range(60):
        (root / f"f{i}.txt").write_text(f"words of {i}")
    index = Index(spark, str(tmp_path / "store"), [str(root)])
    index.scan(now=1)
    before = index.store.state()["tables"]
    (root / "f7.txt").write_text("other words")
    (root / "f8.txt").unlink()
    flushes = spark.createDataFrame([(str(root / "f7.txt"), "Modify", None, 5), (str(root / "f8.txt"), "Delete", None, 6)], "key string, kind string, from_key string, flush_ms long")
    assert kinds(index.apply(flushes, 2)) == [("deleted", "f8.txt"), ("updated", "f7.txt")]
    after = index.store.state()["tables"]
    assert after["active"]["base"] == before["active"]["base"] and 1 <= len(after["active"]["deltas"]) <= 2
    assert after["documents"]["base"] == before["documents"]["base"] and len(after["documents"]["deltas"]) == 1
    assert index.health(3)["total_active_paths"] == 59 and index.store.table("closed").count() == 2
    assert kinds(index.scan(now=4)) == [] and [r["id"] for r in index.store.table("events").orderBy("id").collect()] == list(range(1, 63))


def test_blocks_that_cannot_be_among_the_best_are_not_scored(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratafs.operators import search

    n = 6000
    rare = F.when(F.col("id") == 80, F.lit(" sea" * 30)).otherwise("")
    text = F.concat(F.lit("the sea of words"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 40), lambda x: F.concat(F.lit(" w"), x.cast("string"))), ""), rare)
    docs = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), text.alias("text"))
    docs_n, length = search.text_lengths(docs, ["text"])
    blocks = search.block_rows(docs, "content_hash", ["text"], 5, search.block_bits(n))
    blocks.repartitionByRange("token", "prefix").sortWithinPartitions("token", "prefix").write.parquet(str(tmp_path / "b"))
    blocks = spark.read.parquet(str(tmp_path / "b"))
    sizes = blocks.where("token = 'sea'").agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    assert sizes[0] == 64 and sizes[1] < 2 * search.BLOCK and sizes[2] == n
    phrases = [["sea"]]
    want = search.bm25(docs, "content_hash", ["text"], phrases).orderBy("rank", "content_hash").limit(1).collect()
    got = search.top(blocks, "content_hash", phrases, 1, docs_n, length, first=2).collect()
    assert [(r["content_hash"], round(r["rank"], 9)) for r in got] == [(r["content_hash"], round(r["rank"], 9)) for r in want]
    parts = search.promising(blocks, phrases, search._idfs(blocks, phrases, docs_n), length / docs_n)
    assert parts.where(F.col("most") >= -got[0]["rank"]).count() == 1 and parts.count() == 64
    assert search.top(blocks, "content_hash", [["sea"], ["absent"]], 3, docs_n, length).count() == 0


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_for_stored_postings(spark, tmp_path):
    import hashlib
    import random

    from stratafs.operators import search
    from stratafs.sources.store import Store

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "sea"] * 300
    rows = [(hashlib.sha256(bytes([i % 250, i // 250])).hexdigest(), rng.choice(["", "the sea", None]), " ".join(rng.choices(words, k=rng.choice([0, 1, 90, 150])))) for i in range(900)]
    once = spark.createDataFrame(rows, "content_hash string, title string, text string").repartition(3)
    once.unionByName(once.where("content_hash < '4'")).repartition(5).write.parquet(str(tmp_path / "copies"))
    copies = spark.read.parquet(str(tmp_path / "copies"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = search.block_rows(search.once_a_task(copies, "content_hash"), "content_hash", ["title", "text"], 3, search.block_bits(900))
        store = Store(spark, str(tmp_path / "store"))
        before = shuffled(spark)
        store.commit(append={"postings": blocks})
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = store.table("postings")
    assert held.count() == held.select("token", "prefix").distinct().count()
    docs, length = search.indexed(held)
    assert (docs, length) == search.text_lengths(once, ["title", "text"])
    for phrases in ([["sea"]], [["the", "sea"], ["of"]], [["the", "the"], ["sea"], ["the"]], [["w7"], ["the"]], [["w7", "w9", "w8"]], [["sea"], ["sea"]]):
        want = sorted((round(r["rank"], 9), r["content_hash"]) for r in search.bm25(once, "content_hash", ["title", "text"], phrases).collect())
        assert sorted((round(r["rank"], 9), r["content_hash"]) for r in search.ranked(held, "content_hash", phrases, docs, length).collect()) == want, phrases
        got = search.top(held, "content_hash", phrases, 5, docs, length, first=2).collect()
        assert [(round(r["rank"], 9), r["content_hash"]) for r in got] == want[:5], phrases
    # the texts are shuffled once, and nothing that is made of them
    assert moved < 2 * sum(f.stat().st_size for f in (tmp_path / "copies").rglob("*.parquet"))


def test_output_is_not_cut_and_reading_is_dealt(spark, tmp_path, capsys):
    cli.show(spark.range(2500))
    assert len(capsys.readouterr().out.splitlines()) == 2500
    root = tmp_path / "r"
    root.mkdir()
    for i in range(50):
        (root / f"f{i}.txt").write_text(f"{i} " * (i + 1))
    found = walk.walk(spark, [str(root)]).where("catalog_dir is null").coalesce(1)
    assert walk.dealt_by_size(found).rdd.getNumPartitions() == 4
    read = walk.read_contents(found).collect()
    assert {r["path"]: bytes(r["content"]) for r in read} == {str(root / f"f{i}.txt"): (f"{i} " * (i + 1)).encode() for i in range(50)}
    assert walk.read_contents(found.limit(0)).count() == 0


@pytest.mark.parametrize("first, most", [(256, 100_000), (1, 3), (5, 7)])
def test_walking_by_steps_finds_what_one_walk_finds(spark, tmp_path, tree, first, most):
    (tree / "wide").mkdir()
    for i in range(40):
        (tree / "wide" / f"f{i}.txt").write_text("x")
    for part in ("deep/a/b/c/d", "skip/in", "node_modules/q/r"):
        (tree / part).mkdir(parents=True)
        (tree / part / "z.txt").write_text(part)
    (tree / ".indexignore").write_text("skip/\nf1*.txt\n")
    (tree / "wide" / ".indexignore").write_text("!f11.txt\nf2.txt\n")
    (tree / "deep" / ".indexignore").write_text("[catalog]\nb/\n")
    os.symlink(tree / "deep", tree / "loop")
    roots = [str(tree), str(tmp_path / "missing"), str(tree / "deep") + "/"]
    sizes = []

    def hold(df):
        rows = df.collect()
        sizes.append(len(rows))
        return spark.createDataFrame(rows, df.schema)

    want = sorted(map(tuple, walk.walk(spark, [r.rstrip("/") for r in roots], "*.py\n", "/").collect()), key=repr)
    got = sorted(map(tuple, walk.walk_steps(spark, roots, "*.py\n", "/", hold, first, most).collect()), key=repr)
    assert got == want and len(got) > 20
    assert (len(sizes) > 2) == (first < 100)
    assert walk.walk_steps(spark, []).count() == 0
