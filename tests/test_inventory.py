import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daysieve.functions import texts
from daysieve.operators import extras, rules, state
from daysieve.sources import assistants, files, inventory, logs

NOW = datetime(2024, 1, 9, 10)


def tree(root, *paths, at=NOW):
    for p in paths:
        full = root / p
        if p.endswith("/"):
            full.mkdir(parents=True, exist_ok=True)
        else:
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_text("x")
            os.utime(full, (at.timestamp(), at.timestamp()))


def found(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_repositories_of_a_tree(spark, tmp_path):
    tree(tmp_path, "real/.git/", "real/inner/.git/HEAD", "real/.hidden/x/.git/", "$Recycle.Bin/S-1/$R/.git/", "$RECYCLE.BIN/S-1/$R/.git/", "system volume information/trap/.git/", "node_modules/m/.git/", "a/b/c/d/.git/", "a/b/c/d/e/.git/", "wc/.svn/", "wc/sub/f.txt", "link/.git")
    for dealt in (256, 2, 1):
        inv = inventory.walk(spark, [str(tmp_path)], depth=4, dealt=dealt)
        assert found(inventory.repositories(inv), tmp_path) == ["a/b/c/d", "link", "real", "real/inner"]
        assert found(inventory.repositories(inv, marker=".svn"), tmp_path) == ["wc"]
        # pruned directories are listed, not entered
        names = found(inv, tmp_path)
        assert "node_modules" in names and "node_modules/m" not in names and "real/.git/HEAD" not in names and len(names) == len(set(names))
    # an inventory that was not pruned gives the same
    every = spark.createDataFrame([(str(tmp_path / p),) for p in ("real/.git", "node_modules/m/.git", "a/b/c/d/.git", "a/b/c/d/e/.git", "$recycle.bin/.git")], "path string")
    assert found(inventory.repositories(every, (str(tmp_path),)), tmp_path) == ["a/b/c/d", "real"]


def test_too_many_repositories(spark, tmp_path):
    tree(tmp_path, *(f"r{i:03}/.git/" for i in range(210)))
    every = inventory.repositories(inventory.walk(spark, [str(tmp_path)]))
    assert inventory.repositories(inventory.walk(spark, [str(tmp_path)]), most=200).count() == 200
    assert "超过 200 个" in inventory.too_many(every).first().warning and inventory.too_many(every.limit(200)).count() == 0


def scan(spark, root, **more):
    inside = lambda t: (t >= F.lit(NOW - timedelta(days=1)).cast("timestamp")) & (t < F.lit(NOW + timedelta(days=1)).cast("timestamp"))
    inv = inventory.walk(spark, [str(root)], depth=9)
    rows = inventory.classified(inv, inside, (str(root),), **more)
    return rows


def test_scan_of_a_tree(spark, tmp_path):
    tree(tmp_path, "proj/src/a.ts", "proj/src/b.py", "proj/.env", "proj/server.pem", "proj/node_modules/junk/index.js", "proj/.idea/workspace.xml", "proj/dist/bundle.js", "proj/obj/x.cs", "repo/src/c.ts", "proj/run.log")
    tree(tmp_path, "proj/old.ts", at=NOW - timedelta(days=99))
    os.utime(tmp_path / "proj/old.ts", (0, 0))
    repos = spark.createDataFrame([(str(tmp_path / "repo"),)], "root string")
    rows = scan(spark, tmp_path, repos=repos)
    hits = inventory.hits(rows).where("NOT created")
    assert found(hits, tmp_path) == ["proj/src/a.ts", "proj/src/b.py"]
    c = inventory.counters(rows).first()
    assert (c.scanned, c.skipped_in_repo, c.skipped_sensitive, c.skipped_noise, c.truncated) == (6, 1, 1, 1, False) and c.dirs == 3
    assert found(inventory.hits(scan(spark, tmp_path, repos=repos, depth=1)), tmp_path) == []
    assert found(inventory.hits(scan(spark, tmp_path, exclude=(str(tmp_path / "proj"),))), tmp_path) == ["repo/src/c.ts"]


def test_cap_and_depth_of_a_scan(spark, tmp_path):
    tree(tmp_path, *(f"proj/f{i}.ts" for i in range(12)), "a/b/c/d/e/f/g/deep.ts")
    assert inventory.hits(scan(spark, tmp_path), 5).count() == 5 and inventory.counters(scan(spark, tmp_path), 5).first().truncated
    assert found(inventory.hits(scan(spark, tmp_path, depth=2).where("path LIKE '%deep%'")), tmp_path) == []
    assert inventory.hits(scan(spark, tmp_path, depth=9).where("path LIKE '%deep%'")).count() == 1


def test_directories_that_are_skipped(spark):
    names = ["$Recycle.Bin", "$RECYCLE.BIN", "System Volume Information", "Recovery", "Config.Msi", "$WinREAgent", "MSOCache", "lost+found", "node_modules", ".git", ".cache", "src", "my-project", "Recycler", "Documents"]
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", inventory.skips(F.col("n")).alias("s")).collect()}
    assert [n for n in names if not got[n]] == ["src", "my-project", "Recycler", "Documents"]


def test_tails_and_heads_read_what_they_must(spark, tmp_path):
    line = "2024-01-09T10:00:00Z\t/w\tmake {}\n"
    big = tmp_path / "shell.log"
    with open(big, "w") as f:
        for i in range(30_000):
            f.write(line.format(i))
        f.write("2024-01-09T10:00:01Z\t/w\texport API_KEY=abc\n")
    rows = spark.createDataFrame([(str(big),), (str(tmp_path / "none"),)], "path string")
    got = {r.status: r for r in files.read_ranges(rows, tail=10_000).collect()}
    assert got["ok"].n_bytes == 10_000 and got["ok"].start == got["ok"].size - 10_000 and got["absent"].text is None
    assert got["ok"].text.splitlines() == big.read_text()[-10_000:].splitlines()[1:]
    commands = logs.parse_shell_log(files.last_lines(rows, tail=10_000))
    c = logs.shell_counts(commands, F.year("ts") == 2024).first()
    assert c.skipped_credential == 1 and c.total == len(got["ok"].text.splitlines())
    assert logs.collect_shell(commands).count() == c.total - 1


def test_working_folders_of_the_newest_logs(spark, tmp_path):
    for i in range(6):
        p = tmp_path / f"s{i}.jsonl"
        p.write_text('{"type":"x"}\n{"cwd": "/home/\\u4e2d/p%d"}\n' % i)
        os.utime(p, (1000 + i, 1000 + i))
    (tmp_path / "subagents").mkdir()
    (tmp_path / "subagents" / "z.jsonl").write_text('{"cwd":"/no"}')
    (tmp_path / "late.jsonl").write_text(" " * 17_000 + '{"cwd":"/too/late"}')
    inv = inventory.walk(spark, [str(tmp_path)])
    assert [r.cwd for r in files.working_folders(inv, 4).orderBy(F.desc("mtime")).collect()] == ["/home/中/p5", "/home/中/p4", "/home/中/p3"]
    assert inventory.touched_since(inv, F.lit(1004).cast("timestamp")).where("path LIKE '%/s_.jsonl'").count() == 2


def test_broken_files_end_nothing(spark, tmp_path):
    for name, text in (("a.jsonl", b'{"type":"user","sessionId":"s1","timestamp":"2024-01-09T10:00:00Z","message":{"content":"one"}}\nbad line\n'), ("b.jsonl", b'{"type":"user","sessionId":"s2","message":{"content":"two"}}\n\xff\xfe\n'), ("c.jsonl", b"")):
        (tmp_path / "claude").mkdir(exist_ok=True)
        (tmp_path / "claude" / name).write_bytes(text)
    (tmp_path / "claude" / "gone.jsonl").symlink_to(tmp_path / "nowhere")
    (tmp_path / "buddy").mkdir()
    (tmp_path / "buddy" / "x.json").write_text(json.dumps([{"role": "user", "content": "any shape"}]))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.json").write_text("{")
    got, report = assistants.read_sessions(spark, {"claude-code": str(tmp_path / "claude"), "codebuddy": str(tmp_path / "buddy"), "gemini-cli": str(tmp_path / "docs"), "cline": str(tmp_path / "none"), "opencode": str(tmp_path / "none")})
    assert sorted((r.provider, r.text) for r in got.collect()) == [("claude-code", "one"), ("claude-code", "two"), ("codebuddy", "any shape")]
    told = {r.provider: (r.status, r.files, r.unread, r.sessions) for r in report.collect()}
    assert told == {"claude-code": ("ok", 3, 1, 2), "codebuddy": ("ok", 1, 0, 1), "gemini-cli": ("empty", 1, 0, 0), "cline": ("absent", 1, 1, 0), "opencode": ("absent", 0, 0, 0)}


def test_denied_files_are_told(monkeypatch):
    assert files.fault(PermissionError()) == "denied" and files.fault(FileNotFoundError()) == "absent" and files.fault(IsADirectoryError()) == "failed"


def test_rules_against_each_rule_in_turn(spark):
    rng = random.Random(5)
    roots = [(f"/{rng.choice('abc')}/{rng.choice(['work', 'home', 'x'])}/{''.join(rng.choices('abcd', k=rng.randrange(1, 7)))}",) for _ in range(400)] + [(None,), ("",)]
    told = [("".join(rng.choices("abcd/", k=rng.randrange(0, 6))), f"p{i}", i) for i in range(300)] + [(None, "never", 999), ("/work/a", "w", 500), ("/work/a", "w again", 501)]
    for given in (told, [r for r in told if r[0]]):
        got = {r.text: r.project for r in rules.last_rule(spark.createDataFrame(roots, "text string"), spark.createDataFrame(given, "match string, project string, ordinal int")).collect()}
        want = {}
        for match, project, _ in sorted((r for r in given if r[0] is not None), key=lambda r: r[2]):
            for (root,) in roots:
                if root is not None and match in root:
                    want[root] = project
        assert got == want


def test_no_nested_loop_over_rules(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(10_000).select(F.concat(F.lit("/p"), "id").alias("match"), F.col("id").cast("string").alias("project"), F.col("id").alias("ordinal"))
        roots = spark.range(20_000).select(F.concat(F.lit("/home/p"), F.col("id") % 15_000, F.lit("/x")).alias("text"))
        got = rules.last_rule(roots, many)
        plan = got._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = {f"/home/p{i}/x": max((j for j in {int(str(i)[:n]) for n in range(1, len(str(i)) + 1)} if j < 10_000 and str(i).startswith(str(j))), default=None) for i in range(15_000)}
        assert {r.text: int(r.project) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_projects_and_exclusions(spark):
    repos = spark.createDataFrame([("/w/mono",), ("/w/other/",)], "root string")
    sessions = spark.createDataFrame([("/w/mono/src", None), ("/free/one", []), ("/container", ["/w/mono"]), ("/container2", ["/container2", "/w/mono"]), (".", None), (None, None)], "cwd string, action_roots array<string>")
    extra = spark.createDataFrame([("/free/one/deep",), ("/files/x",)], "root string")
    sub = spark.createDataFrame([("/w/mono", "packages/app", " App "), ("/unknown", "x", "no")], "repo string, path string, project string")
    told = spark.createDataFrame([("/free", "Free", 0), ("one", "One", 1)], "match string, project string, ordinal int")
    got = {r.root: (r.project, r.name, r.renamed) for r in rules.projects(repos, sessions, extra, sub, told).collect()}
    assert got == {"/w/mono": ("mono", "mono", False), "/w/other": ("other", "other", False), "/w/mono/packages/app": ("app", "App", True), "/free/one": ("one", "One", True), "/container2": ("container2", "container2", False), "/files/x": ("files/x", "files/x", False)}
    modules = spark.createDataFrame([("mono", "mono"), ("app", "App"), ("one", "One"), (None, None)], "project string, name string")
    projects = spark.createDataFrame([("mono", "/w/mono"), ("app", "/w/mono/packages/app")], "project string, root string")
    barred = lambda *r: sorted(str(x.project) for x in rules.excluded(modules, projects, spark.createDataFrame([(x,) for x in r], "rule string")).where("excluded").collect())
    assert barred(" packages ", "", None) == ["app"] and barred("On") == ["one"] and barred("mono") == ["app", "mono"] and barred() == []


def plain_objects(text):
    out, i = [], 0
    while (i := text.find("{", i)) >= 0:
        depth, quoted, j = 0, False, i
        while j < len(text):
            c = text[j]
            if quoted:
                if c == "\\":
                    j += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
            j += 1
        if j >= len(text):
            return out
        out.append(text[i : j + 1])
        i = j + 1
    return out


def test_objects_within_texts(spark):
    rng = random.Random(3)
    cases = ["", "none", '{"a": "}"} and {"b": {"c": "\\"}"}} {', 'say "x { "a": 1 }', "{\\\"}\" }", "\\{a}", "}{}", "{{}", '{"a\\\\"}']
    cases += ["".join(rng.choices('{}"\\ax\n', k=rng.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", texts.json_objects(F.col("t")).alias("o"))
    wrong = [(cases[r.i], r.o, plain_objects(cases[r.i])) for r in df.collect() if r.o != plain_objects(cases[r.i])]
    assert not wrong
    assert spark.range(1).select(texts.json_objects(F.lit(None).cast("string")).alias("o")).first().o is None


def test_answers_lack_keys(spark):
    df = spark.createDataFrame([('x {"entries": [], "n": null} y',), ("{}",), ("no",)], "t string")
    assert [r[0] is not None for r in df.select(extras.model_json(F.col("t"), ("entries",))).collect()] == [True, False, False]


def test_thread_ids(spark):
    a, b = "01234567-89ab-cdef-0123-456789abcdef", "11234567-89ab-cdef-0123-456789abcdef"
    df = spark.createDataFrame([(f"/x/rollout-2024-01-09T10-00-00-{a}.jsonl",), (f"rollout-2024-01-09T10-00-00-{a}_{b}.jsonl",), ("other.jsonl",)], "f string")
    assert [r[0] for r in df.select(state.thread_id(F.col("f"))).collect()] == [a, b, None]


@pytest.mark.parametrize("seed", range(3))
def test_tracks_by_a_plain_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        start = NOW + timedelta(minutes=rng.randrange(2000))
        rows.append((i, "ab"[i % 2], start, None if i % 17 == 0 else start + timedelta(minutes=rng.choice([0, 5, 30, 200]))))
    got = {r.key: r.track for r in extras.tracks(spark.createDataFrame(rows, "key int, board string, start_ts timestamp, end_ts timestamp")).collect()}
    for board in "ab":
        own = sorted((r for r in rows if r[1] == board), key=lambda r: (r[2], r[3] or r[2], r[0]))
        ends = []
        for key, _, start, end in own:
            track = next((t for t, e in enumerate(ends) if e <= start), len(ends))
            ends[track : track + 1] = [end or start]
            assert got[key] == track
        edges = sorted([(r[2], 1) for r in own if r[3]] + [(r[3], -1) for r in own if r[3]], key=lambda e: (e[0], e[1]))
        deep = most = 0
        for _, d in edges:
            deep += d
            most = max(most, deep)
        assert max(got[r[0]] for r in own) + 1 >= most
