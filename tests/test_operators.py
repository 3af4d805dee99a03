"""Values fixed by hand: redaction, positions, snippets, state machines, documents, streams, own code."""

import json
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from siltworks import queries as engine
from siltworks.functions import normalize, severity, text
from siltworks.operators import cache, custom_rules, extension, incremental, joins, match, monitor, state, vulnerabilities, windows
from siltworks.operators import settings as settings_op
from siltworks.plans import rules
from siltworks.sources import files, plugins, reports
from siltworks.streaming import delivery, rates


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_redaction(spark):
    for raw, want in (("Error at /home/user/project/file.ts", "Error at [PATH]"), ("User test@example.com not found", "User [EMAIL] not found"), ("Connection to 192.168.1.1 failed", "Connection to [IP] failed")):
        assert one(spark, text.redact, raw) == want


def js_hash(s: str) -> str:
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "big") + 2**31) % 2**32 - 2**31
    return f"{abs(h):x}"


def test_hash_and_names(spark):
    for s in ("ab", "", "é日本", "😀x", "a long text " * 9):
        assert one(spark, text.poly_hash, s) == js_hash(s)
    assert one(spark, text.anonymize_path, "a/b/c.py") == "<path-depth-3>/<file>.py"
    assert one(spark, text.title_words, "open_redirect") == "Open Redirect"
    assert one(spark, text.escape_html, "<a href='x'>&") == "&lt;a href=&#039;x&#039;&gt;&amp;"
    assert one(spark, text.sanitize_input, "&<>\"'/te\x00st\x7f") == "&amp;&lt;&gt;&quot;&#x27;&#x2F;test"
    assert one(spark, text.sanitize_input, None) == ""
    assert len(one(spark, text.sanitize_input, "a" * 200_001)) == 200_000


def test_offsets_agree_with_a_regex_engine(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c\n1") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for pattern in (r"a+b?|1", r"b\s*c", r"(?<=a)b"):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", match.matches(F.col("t"), pattern).alias("m"))
        for r in df.collect():
            t = texts[r.i]
            want = [(m[0], m.start(), t.count("\n", 0, m.start()) + 1, m.start() - t.rfind("\n", 0, m.start()) - 1) for m in re.finditer(pattern, t)]
            assert [(x.match, x.start, x.line, x.col) for x in r.m or []] == want


def test_positions(spark):
    code = spark.createDataFrame([(1, "javascript", "document.write(name)\n  Math.random()")], "i int, l string, t string")
    got = {(r.rule_id, r.line, r.col) for r in match.scan(code, rules.BUILT_IN, "i", "t", "l").collect()}
    assert got == {("SEC002", 1, 0), ("SEC009", 2, 2), ("SEC012", 2, 2)}
    empty = spark.createDataFrame([(1, "javascript", None), (2, None, "document.write(x)"), (3, "javascript", "")], "i int, l string, t string")
    assert match.scan(empty, rules.BUILT_IN, "i", "t", "l").collect() == []


def test_user_of_container_files(spark):
    cases = {"FROM a\nUSER rootless": None, "FROM a\nUSER root": 1, "# x\nFROM a": 2, "": 1, "user Root \nFROM b": 2, "USER\n  me": None}
    df = spark.createDataFrame([(k, k) for k in cases], "path string, content string")
    assert {r.path: r.line for r in match.missing_user(df).collect()} == {k: v for k, v in cases.items() if v}


def test_snippet(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\ne",)], "t string")
    assert df.select(text.snippet(F.split("t", "\n", -1), F.lit(3))).first()[0] == "b\nc\nd\ne"
    assert df.select(text.snippet(F.split("t", "\n", -1), F.lit(1))).first()[0] == "a\nb\nc"


def test_breaker():
    b = state.Breaker(failures=3, window=10, wait=5, successes=2)
    assert [b(t, ok) for t, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (7, True), (11, True), (12, True))] == ["closed", "closed", "closed", "closed", "closed", "open", "open", "half-open", "closed"]
    # a failure exactly one window old does not count
    b = state.Breaker(failures=2, window=10, wait=5)
    assert [b(0, False), b(10, False), b(19, False)] == ["closed", "closed", "open"]
    # a failure while half-open opens again
    assert [b(24, False), b(28, True), b(29, True), b(30, True)] == ["open", "open", "half-open", "closed"]


def test_alarm():
    a = state.Alarm(60, 80)
    assert [a(t, 90) for t in (0, 61, 122)] == ["critical"] * 3
    a = state.Alarm(60, 80)
    assert [a(0, 90), a(61, 10), a(70, 90), a(80, 10), a(131, 70)] == ["critical", "resolved", "critical", None, "warning"]
    low = state.Alarm(0.5, 0.3, op="lt")
    assert [low(0, 0.4), low(60, 0.2), low(120, 0.9)] == ["warning", "critical", "resolved"]


def streamed(spark, df, tmp_path, name, apply, batches=3):
    """The result over several micro-batches, files in the order of time."""
    path = str(tmp_path / name)
    for i, part in enumerate(df):
        part.coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(df[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    q = apply(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_state_on_streams_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    calls = [(i % 3, i, float(i * 5), rng.random() > 0.6) for i in range(240)]
    schema = "endpoint long, seq long, at double, ok boolean"
    parts = [spark.createDataFrame(calls[i : i + 80], schema) for i in range(0, 240, 80)]
    run = lambda df: state.circuit_breaker(df, failures=3, window=60, wait=30)
    assert streamed(spark, parts, tmp_path, "calls", run) == {tuple(r) for r in run(spark.createDataFrame(calls, schema)).collect()}
    values = [(f"m{i % 2}", float(i * 20), rng.choice([10.0, 70.0, 95.0])) for i in range(120)]
    schema = "metric string, at double, value double"
    parts = [spark.createDataFrame(values[i : i + 40], schema) for i in range(0, 120, 40)]
    run = lambda df: state.alerts(df, 60, 80)
    assert streamed(spark, parts, tmp_path, "alarms", run) == {tuple(r) for r in run(spark.createDataFrame(values, schema)).collect()}
    versions = [(f"u{i % 4}", i, rng.choice("ab")) for i in range(60)]
    schema = "uri string, version long, content string"
    parts = [spark.createDataFrame(versions[i : i + 20], schema) for i in range(0, 60, 20)]
    assert streamed(spark, parts, tmp_path, "versions", state.document_changes) == {tuple(r) for r in state.document_changes(spark.createDataFrame(versions, schema)).collect()}


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = {tuple(r) for r in rates.windowed_rate(engine.table(spark, sf, "events"), "ts", "event_type", "1 hour", 3600).collect()}
    engine.table(spark, sf, "events").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(engine.table(spark, sf, "events").schema).parquet(str(tmp_path / "in"))
    q = rates.windowed_rate(stream, "ts", "event_type", "1 hour", 3600).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("rates").collect()} == batch


def test_delivery(spark, tmp_path):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["low", "critical", "high", "critical", "info"])], "seq long, severity string")
    got = delivery.prioritized(rows, severity.rank(F.col("severity")), ["seq"], 2).orderBy("delivery", "seq").collect()
    assert [(r.seq, r.delivery) for r in got] == [(1, 0), (3, 0), (0, 1), (2, 1), (4, 2)]
    seen = []

    def bad(df, i):
        raise RuntimeError("sink is gone")

    fan = delivery.FanOut({"bad": bad, "good": lambda df, i: seen.extend(df.collect()), "files": delivery.append_to(str(tmp_path / "out"))})
    rows.write.parquet(str(tmp_path / "in"))
    spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(fan).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 5 and [e[0] for e in fan.errors] == ["bad"] and spark.read.parquet(str(tmp_path / "out")).count() == 5
    told = []
    delivery.prioritized_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), severity.rank(F.col("severity")), lambda df, i: told.append([r.severity for r in df.collect()])).trigger(availableNow=True).start().awaitTermination()
    assert told == [["critical", "critical", "high", "low", "info"]]
    assert json.loads(delivery.lines(rows, "issue").first().value) == {"type": "issue", "payload": {"seq": 0, "severity": "low"}}


def test_messages(spark, tmp_path):
    said = delivery.Messages()
    spark.streams.addListener(said)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(said)
    kinds = [m["type"] for m in said.messages]
    assert kinds[0] == "started" and kinds[-1] == "completed" and "progress" in kinds
    assert [m["sequence"] for m in said.messages] == list(range(1, len(kinds) + 1))


def test_reports_are_documents(spark, tmp_path):
    rows = [(2, "R1", "critical", 'a "b"', "x.py", 3, ["CWE-1"]), (1, "R2", "odd", "m", "y.py", 1, None), (3, "R1", None, None, None, None, [])]
    f = spark.createDataFrame(rows, "seq long, rule_id string, severity string, message string, file string, line long, cwe array<string>")
    for form in reports.FORMATS:
        path = str(tmp_path / form)
        reports.write(f, form, path)
        whole = "\n".join(r.value for r in sorted(spark.read.text(path).select("value", "_metadata.file_path").collect(), key=lambda r: r.file_path))
        assert whole
        if form in ("json", "codeclimate", "sarif"):
            got = json.loads(whole)
            items = got if form == "codeclimate" else got["issues"] if form == "json" else got["runs"][0]["results"]
            assert len(items) == 3
        if form == "csv":
            assert whole.splitlines()[1:3] == [",R2,R2,odd,unknown,m,y.py,1,0,0.7,,,No", ',R1,R1,critical,unknown,"a ""b""",x.py,3,0,0.7,CWE-1,,No']
    for form in ("checkstyle", "sonarqube"):
        with pytest.raises(ValueError, match="Unsupported report format"):
            reports.write(f, form, "/nowhere")
    assert reports.document(f.limit(0), "junit").count() == 2


def test_locations(spark):
    schema = "message string, line int, column int, location struct<startLine:int,endLine:int,startColumn:int,endColumn:int>"
    df = spark.createDataFrame([("a", None, None, (5, 7, 10, 20)), ("b", 10, 5, None), ("c", None, None, None), ("", 1, 1, None)], schema)
    got = [tuple(r.range) for r in normalize.diagnostics(df.drop("x")).select("range").collect()]
    assert got[:3] == [(4, 10, 6, 20), (9, 5, 9, 105), (0, 0, 0, 100)]
    assert normalize.with_message(df).count() == 3
    with pytest.raises(Exception, match="line is missing"):
        normalize.require(df, {"line": "int"}).collect()


def test_unknown_severity(spark):
    df = spark.createDataFrame([("odd",), ("info",)], "s string").select(severity.rank(F.col("s")).alias("r"))
    assert [r.r for r in df.collect()] == [-1, 4]


def test_cache_keeps_what_was_used_last(spark):
    keys = [(f"key{i}", i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(1001)]
    keys[0] = ("key0", 0, "2024-01-01 01:00:00")
    e = spark.createDataFrame(keys, "key string, seq int, at string").withColumn("accessed_at", F.to_timestamp("at"))
    kept = {r.key for r in cache.over_count(e, 1000).collect()}
    assert "key0" in kept and "key1" not in kept and len(kept) == 1000
    looked = spark.createDataFrame([("hit",), ("hit",), ("miss",)], "result string")
    assert tuple(cache.hit_rates(looked).first()) == (2, 1, 0.666667)
    assert cache.hit_rates(looked.limit(0), "result").collect() == []


def test_scopes_and_changes():
    code = "class A {\n  go() {\n  }\n}\nfunction one() { return 1 }\nconst f = () => {\n"
    assert [s[:4] for s in incremental.find_scopes(code, "javascript")] == [("class", "A", 0, 3), ("function", "one", 4, 4), ("function", "f", 5, 6)]
    assert [s[:4] for s in incremental.find_scopes("", "go")] == [("file", "module", 0, 0)]
    assert [s[:4] for s in incremental.find_scopes("def a():\n  x\ny = 1", "python")] == [("function", "a", 0, 1)]
    assert [s[:4] for s in incremental.find_scopes("def a():\n  x\ny = 1", "python", compat=True)] == [("function", "a", 0, 0)]
    assert incremental.line_changes("a\nb\nc", "a\nx\nc") == [("replace", 1, 1, "x", "b")]
    assert incremental.line_changes("a\nc", "a\nb1\nb2\nc") == [("insert", 1, 2, "b1\nb2", None)]
    assert incremental.line_changes("a\nb\nc", "a\nc") == [("delete", 1, 1, "", "b")]
    rng = random.Random(2)
    for _ in range(80):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = incremental.common_lines(a, b)
        assert len(kept) == best[-1][-1]
        assert not incremental.line_changes("\n".join(a), "\n".join(a))


def walked(a, b):
    """The common lines by the whole matrix."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out, i, j = [a[i - 1], *out], i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_common_lines_walk_like_the_matrix():
    rng = random.Random(6)
    for n in [*range(9), 10, 24, 25, 26, 60]:
        for letters in ("ab", "abcdefgh"):
            a, b = [rng.choice(letters) for _ in range(n)], [rng.choice(letters) for _ in range(rng.randint(0, 50))]
            assert incremental.common_lines(a, b) == walked(a, b)
            assert incremental.common_lines(b, a) == walked(b, a)


def test_common_lines_of_long_versions_in_little_memory():
    """The whole matrix of these would have 1.6 GB."""
    rng = random.Random(1)
    old = [f"line {rng.randint(0, 3000)}" for _ in range(20_000)]
    new = [x if rng.random() > 0.1 else f"new {rng.randint(0, 99)}" for x in old]
    tracemalloc.start()
    kept = incremental.common_lines(old, new)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) > 17_000 and most < 100 << 20


def test_merging_looks_at_neighbours_only(spark):
    schema = "doc int, seq int, type string, start_line int, end_line int, content string, previous string"
    rows = [(1, 0, "insert", 1, 1, "a", None), (1, 1, "delete", 1, 1, "", "x"), (1, 2, "insert", 2, 2, "b", None), (1, 3, "insert", 3, 5, "c", "p"), (1, 4, "insert", 1, 2, "d", None), (1, 5, "insert", 7, 7, "e", None), (2, 0, None, 1, 1, "f", ""), (2, 1, None, 2, 2, "g", "q")]
    got = incremental.merged(spark.createDataFrame(rows, schema), ["doc"], ["seq"]).orderBy("doc", "start_line", "type").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "delete", 1, 1, 1, "", "x"), (1, "insert", 1, 1, 1, "a", None), (1, "insert", 2, 5, 3, "b\nc\nd", "p\n"), (1, "insert", 7, 7, 1, "e", None), (2, None, 1, 2, 2, "f\ng", "q")], key=str)


def test_findings_of_a_first_version_hold_until_their_scope_changes(spark):
    status = [("d", v, name, 1, s) for v, line in enumerate([("affected", "affected"), ("unchanged", "unchanged"), ("unchanged", "affected"), ("unchanged", "unchanged")], 1) for name, s in zip("ab", line)]
    status += [("d", 5, "a", 2, "unchanged"), ("d", 6, "a", 1, "unchanged")]  # it moves, and comes back
    status = spark.createDataFrame(status, "uri string, version int, name string, start_line int, status string")
    found = spark.createDataFrame([("d", 1, "a", 1, "old"), ("d", 1, "b", 1, "gone"), ("d", 3, "b", 1, "late"), ("d", 6, "a", 1, "last")], "uri string, version int, name string, start_line int, finding string")
    got = incremental.carried_over(status, found, spark.createDataFrame([("d", v) for v in range(1, 8)], "uri string, version int"))
    assert sorted((r.version, r.finding) for r in got.collect()) == [(2, "gone"), (2, "old"), (3, "old"), (4, "late"), (4, "old")]


def test_joins_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    assert joins.resolved(a, a).collect() == []
    assert sorted(r.k for r in joins.resolved(a, a.filter("k = 1")).collect()) == [2, 2]
    assert windows.sliding_rate(spark.createDataFrame([], "k int, ts timestamp"), "k", "ts", 60).collect() == []


def test_sliding_rate_across_stretches(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), rng.randint(0, 20_000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, s int, i int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.rate for r in windows.sliding_rate(df, "k", "ts", 60, 3).collect()}
    want = {i: round(sum(k2 == k and s - 60 <= s2 <= s for k2, s2, _ in rows) / 60, 9) for k, s, i in rows}
    assert got == want


def test_file_scans(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in (("src/a.py", "x"), ("src/b.md", "x"), ("node_modules/c.js", "x"), ("src/d.js", "long" * 9), ("main.tf", "x"), ("go.mod", "m")):
        (tmp_path / name).write_text(body)
    tree = files.read_tree(spark, str(tmp_path))
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.project(tree, 10, 20)) == ["a.py"]
    assert names(files.infra(tree, "terraform")) == ["main.tf"]
    assert names(files.manifests(tree)) == ["go.mod"]


def test_own_code(spark):
    r = extension.Registry()
    assert r.plugin("a", "rule") and not r.plugin("a", "rule") and not r.plugin("b", "odd")
    assert r.enabled() == ["a"] and r.switch("a", False) and r.enabled("rule") == [] and not r.switch("z", True)
    with pytest.raises(KeyError):
        r.execute("none", spark.range(1), "id long")
    took, waits = [], []

    @extension.timed(lambda name, ms, ok: took.append((name, ok)))
    @extension.retried(3, sleep=waits.append)
    def flaky(left=[2]):
        if left[0]:
            left[0] -= 1
            raise OSError("request timeout")
        return 7

    assert flaky() == 7 and waits == [1, 2] and took == [("flaky", True)]

    @extension.retried(3, sleep=waits.append)
    def wrong():
        raise ValueError("401 unauthorized")

    with pytest.raises(ValueError):
        wrong()


def test_rules_from_files(spark, tmp_path):
    rule = {"id": "a-rule", "name": "A rule", "description": "says something", "version": "1.0.0", "severity": "high", "category": "style", "languages": ["*"], "patterns": [{"type": "regex", "value": "x+", "flags": "gi"}], "message": {"default": "found {{$0}}"}, "enabled": True}
    (tmp_path / "pack.json").write_text(json.dumps({"id": "p", "name": "Pack", "version": "1.0.0", "rules": [rule, {**rule, "severity": "awful"}]}, indent=1))
    (tmp_path / "none.json").write_text("{}")
    read = custom_rules.read_rules(spark, str(tmp_path))
    good, bad = custom_rules.imported(read)
    assert [r.pack for r in good.collect()] == ["p"] and len(bad.collect()) == 1
    found = custom_rules.match(spark.createDataFrame([("a.py", "aXXb"), ("b", None)], "path string, content string"), good).collect()
    assert [(r.path, r.message, r.line, r.column, r.end_column) for r in found] == [("a.py", "found XX", 1, 1, 3)]
    again = json.loads(custom_rules.exported(good, "2024-01-01").first().json)
    assert again["rules"][0]["id"] == "a-rule" and again["exportedAt"] == "2024-01-01"


def test_false_positive_tables():
    assert [p.id for p in vulnerabilities.patterns_for("Reflected XSS")] == ["fp-xss-textcontent", "fp-xss-dompurify", "fp-xss-htmlspecialchars", "fp-xss-escape-function"]
    assert vulnerabilities.pattern_by_id("fp-cred-env").suppress and vulnerabilities.pattern_by_id("none") is None


def test_settings_defaults_are_valid(spark):
    d = settings_op.defaults(spark, "p")
    assert settings_op.validate(d).filter("kind = 'error'").collect() == []
    assert [r.key for r in settings_op.validate(settings_op.migrate(d, "1.2")).collect()] == []
    assert settings_op.validate(d.limit(0)).collect() == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def manifest_lines(body, of):
    """Line by line: (line, rule) with the text from each line on written out."""
    lines, out = body.split("\n"), []
    for pos, t in enumerate(lines):
        rest, near = "\n".join(lines[pos:]), "\n".join(lines[max(0, pos - 5) : pos + 5])
        first = next((r.id for r in of if (q := re.compile(r.patterns[0].regex)).search(rest) and (q.search(t) or (pos > 0 and q.search(near)))), None)
        if first:
            out.append((pos + 1, first))
    return out


def test_manifest_rules_in_one_pass(spark):
    rng = random.Random(11)
    parts = ["kind: Secret", "stringData:", "data: x", "privileged: true", "resources:", "  limits:", "    cpu: 1", "    other: 2", "capabilities:", "  add:", "  - ALL", "hostPID: true", "", "runAsUser: 0", "x"]
    bodies = ["\n".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(150)] + ["", "\n\n", "kind: Secret kind: Secret\nstringData: kind: Secret"]
    got = match.manifest_scan(spark.createDataFrame(list(enumerate(bodies)), "path int, content string"), rules.KUBERNETES).collect()
    found = {i: sorted((r.line, r.rule_id) for r in got if r.path == i) for i in range(len(bodies))}
    assert found == {i: manifest_lines(b, rules.KUBERNETES) for i, b in enumerate(bodies)}
    assert match.manifest_scan(spark.createDataFrame([(1, None)], "path int, content string"), rules.KUBERNETES).collect() == []


def test_manifest_of_many_lines(spark):
    """Twenty thousand lines with a match at the end: the text from each line on would be two gigabytes."""
    body = "\n".join(["kind: Secret", *(f"  name{i}: value" for i in range(20_000)), "stringData:", "hostIPC: true"])
    got = match.manifest_scan(spark.createDataFrame([(1, body)], "path int, content string"), rules.KUBERNETES).collect()
    assert {r.line for r in got} == {*range(19_999, 20_004)}


def test_percentiles_of_a_hot_key(spark):
    """By nearest rank, whatever the values: many, few, negative, one, and of a group without a name."""
    rng = random.Random(12)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("hot", 0.25)] * 1500 + [("few", float(rng.randint(0, 3))) for _ in range(50)] + [("one", -7.5)] + [(None, float(i)) for i in range(20)] + [("none", None)]
    got = {r.k: r for r in monitor.distribution(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert set(got) == {"hot", "few", "one", None}
    for k, r in got.items():
        values = sorted(v for g, v in rows if g == k)
        assert (r.n, r.least, r.most) == (len(values), values[0], values[-1])
        assert [r.p50, r.p95, r.p99] == [values[-(-len(values) * q // 100) - 1] for q in (50, 95, 99)]
    whole = monitor.distribution(spark.createDataFrame(rows, "k string, v double"), "v").collect()
    assert len(whole) == 1 and whole[0].n == len(rows) - 1


def test_plugins_of_folders(spark, tmp_path):
    rule = {"id": "a-rule", "name": "A rule", "description": "x", "version": "1.0.0", "severity": "high", "category": "style", "languages": ["*"], "patterns": [{"type": "regex", "value": "a+"}], "message": {"default": "no"}, "enabled": False}
    own = {
        "user/zeta/plugin.json": {"id": "one", "name": "One of the user", "version": "2.0.0"}, "mine/alpha/plugin.json": {"id": "one", "name": "One", "displayName": "The one", "version": "1.0.0", "contributes": {"rules": [rule, {"id": "x"}]}},
        "mine/beta/plugin.json": {"id": "two", "name": "Two"}, "mine/loose.json": {"rules": []}, "mine/alpha/other.json": {"id": "no"}, "mine/gamma/readme.json": {}, "user/late/plugin.json": {"id": "three", "name": "Three", "version": "1.0.0"},
    }
    for name, body in own.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "mine/delta").mkdir()
    (tmp_path / "mine/delta/plugin.json").write_text("{no json")
    found = plugins.read_folders(spark, {"settings": [str(tmp_path / "mine"), str(tmp_path / "nowhere")], "user": [str(tmp_path / "user")]})
    assert sorted(r.path.rsplit("/", 2)[-1] for r in found.collect()) == ["loose.json", *["plugin.json"] * 5]
    got = plugins.manifests(found, most=1)
    assert {r.path.split("/")[-2]: (r.place, r.name, r.status) for r in got.collect()} == {"alpha": (0, "The one", "enabled"), "beta": (0, "Two", "invalid"), "delta": (0, None, "invalid"), "zeta": (3, "One of the user", "repeated"), "late": (3, "Three", "refused")}
    assert [(r.plugin, r.id, r.enabled, r.valid) for r in plugins.contributed(got).orderBy("ord").collect()] == [("one", "a-rule", True, True), ("one", "x", True, False)]


def test_long_histories_stream_through_a_task(spark):
    """Very many rows of one key, with rows without a time, in whatever order they come: as the loop over all of them."""
    rng = random.Random(3)
    calls = [(1, i, float(i) if i % 97 else None, rng.random() > 0.4) for i in range(30_000)]
    rng.shuffle(calls)
    got = state.circuit_breaker(spark.createDataFrame(calls, "endpoint long, seq long, at double, ok boolean"), failures=3, window=20, wait=15)
    step = state.Breaker(3, 20, 15)
    want = [(s, step(float("nan") if a is None else a, o)) for _, s, a, o in sorted(calls, key=lambda r: (r[2] is None, r[2] or 0, r[1]))]
    assert sorted((r.seq, r.state) for r in got.collect()) == sorted(want)
    assert {r.at for r in got.filter("seq % 97 = 0").collect()} == {None}


def test_versions_are_joined_without_broadcasts(spark):
    """All sides of these joins grow with the versions, whatever Spark estimates: none may be gathered on the driver."""
    from siltworks import queries_views as V

    for make in (V.affected_scopes, V.analysis_coverage, V.carried_findings):
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scopes_of_alike_versions(spark):
    """Equal versions of a batch are looked at once; each still has its own rows, and rows are dealt out by number."""
    from siltworks.operators import incremental as I
    from siltworks.session import dealt

    texts = ["function a() {\n}", None, "def b():\n    pass", "function a() {\n}"] * 5
    rows = [(str(i), 1, "python" if i % 2 == 0 and i % 4 else "javascript", t) for i, t in enumerate(texts)]
    v = spark.createDataFrame(rows, "uri string, version int, language string, content string").coalesce(1)
    got = sorted((r.uri, r.seq, r.type, r.name, r.start_line, r.end_line, r.hash) for r in I.scopes(v).collect())
    assert got == sorted((u, k, *s) for u, _, g, t in rows for k, s in enumerate(I.find_scopes(t or "", g)))
    assert dealt(v, 5).rdd.getNumPartitions() == 4 and dealt(v).rdd.getNumPartitions() == 1


def test_groups_of_reports_are_joined_alike_whatever_their_size(spark, monkeypatch):
    """Heads of large groups are broadcast, those of small ones joined by key: each finding once, a group of nulls as well."""
    rows = [(i, f"r{i % 3}", [None, "a", "b", "c"][min(i % 7, 3)], f"m{i}") for i in range(60)]
    f = spark.createDataFrame(rows, "seq long, rule_id string, file string, message string")
    key = lambda r: tuple((v is not None, v) for v in r)
    documents = []
    for large in (0, 12, 1000):
        monkeypatch.setattr(reports, "LARGE", large)
        documents.append([sorted(map(tuple, reports.document(f, form).collect()), key=key) for form in ("html", "junit")])
    assert documents[0] == documents[1] == documents[2] and sum(r[3] == 1 and r[0] == 1 for r in documents[0][1]) == 60


def test_settings_are_counted_without_sorting(spark):
    """The least key of a profile comes by hashing; all rows of a task would be sorted for it otherwise."""
    from siltworks import queries_functions as Q

    plan = Q.settings_import(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
