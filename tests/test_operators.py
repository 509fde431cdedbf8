"""Operators on small literal inputs: the traps that the tables do not show."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import awk, jq, numbers
from weft.operators import graph, patterns, relational, text, version
from weft.plans import shell
from weft.sources import sinks
from weft.sources.tables import lines, records, sequence_rows
from weft.streaming import incremental


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def column(df, c, by=("doc_id", "ln")):
    return [r[c] for r in df.orderBy(*by).collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_lines_final_newline_and_empty(spark):
    df = frame(spark, "a\nb\n", "a\nb", "", "\n", "a\n\n", None)
    got = [(r.doc_id, r.ln, r.line) for r in lines(df, "doc_id").orderBy("doc_id", "ln").collect()]
    assert got == [(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "b"), (3, 1, ""), (4, 1, "a"), (4, 2, "")]


def test_wc_counts_newlines(spark):
    r = text.wc(frame(spark, "a b\ncé")).first()
    assert (r.newlines, r.words, r.chars, r.bytes) == (1, 3, 6, 7)


def test_uniq_is_adjacent_only(spark):
    rows = text.run_lengths(frame(spark, "a\na\nb\na")).orderBy("run").collect()
    assert [(r.line, r.n) for r in rows] == [("a", 2), ("b", 1), ("a", 1)]


def test_context_groups(spark):
    rows = text.context(frame(spark, "1\nx\n3\n4\n5\n6\nx\nx\n9"), "x", 1, 1).orderBy("ln").collect()
    assert [(r.ln, r.hit, r.grp) for r in rows] == [(1, False, 1), (2, True, 1), (3, False, 1), (6, False, 2), (7, True, 2), (8, True, 2), (9, False, 2)]


def test_grep_count_zero_rows(spark):
    df = frame(spark, "a\nb", "c")
    assert [r.n for r in text.grep_count(df, "a").orderBy("doc_id").collect()] == [1, 0]
    assert text.grep_count(df, "a", zeros=False).count() == 1


def test_word_and_whole_line(spark):
    df = frame(spark, "cat\nconcat\na cat b")
    assert column(text.grep(df, "cat", word=True), "ln") == [1, 3]
    assert column(text.grep(df, "cat", whole=True), "ln") == [1]


def test_basic_and_posix_patterns():
    assert patterns.java_pattern(r"a\(b\|c\)\{2\}+", basic=True) == r"a(b|c){2}\+"
    assert patterns.java_pattern("[[:alpha:]_]+") == r"[\p{Alpha}_]+"
    assert patterns.java_pattern("*a", basic=True) == r"\*a"
    assert patterns.is_literal("abc") and not patterns.is_literal("a.c")


@pytest.mark.parametrize(("glob", "path", "cross", "hit"), [("*.txt", "a/b.txt", True, True), ("*.txt", "a/b.txt", False, False), ("**.txt", "a/b.txt", False, True), ("a/[!b]*", "a/b", True, False), ("a.b", "axb", True, False)])
def test_glob(spark, glob, path, cross, hit):
    assert one(spark, F.lit(path).rlike(patterns.glob_pattern(glob, cross))) is hit


def test_cut(spark):
    line = F.lit("a:b:c:d")
    assert one(spark, text.cut_fields(line, "4,2-3", ":")) == "b:c:d"
    assert one(spark, text.cut_fields(line, "2", ":", complement=True, out="-")) == "a-c-d"
    assert one(spark, text.cut_fields(F.lit("abc"), "2", ":")) == "abc"
    assert one(spark, text.cut_fields(F.lit("abc"), "2", ":", only_delimited=True)) is None
    assert text.ranges("5-,1-2,2-3") == [(1, 3), (5, None)]


def test_tr(spark):
    assert one(spark, text.tr(F.lit("hello"), "a-y", "b-z")) == "ifmmp"
    assert one(spark, text.tr(F.lit("abcd"), "abcd", "xy")) == "xyyy"
    assert one(spark, text.tr(F.lit("abcd"), "abcd", "xy", truncate=True)) == "xycd"
    assert one(spark, text.tr(F.lit("aabbcc"), "a-b", squeeze=True)) == "abcc"
    assert one(spark, text.tr(F.lit("A1 b2"), "[:digit:]", delete=True)) == "A b"


@pytest.mark.parametrize(("args", "want"), [({}, "X.bab"), ({"everywhere": True}, "X.bX"), ({"nth": 2}, "ab.bX")])
def test_substitute(spark, args, want):
    assert one(spark, text.substitute(F.lit("ab.bab"), "ab", "X", **args)) == want


def test_substitute_groups(spark):
    assert one(spark, text.substitute(F.lit("key=val"), r"\(.*\)=\(.*\)", r"\2=\1 [&] $")) == "val=key [key=val] $"


def test_numeric_sort_keys(spark):
    rows = ["10", "9", "-2", ".5", "abc", "007", "20000000000000000001", "20000000000000000000"]
    df = frame(spark, "\n".join(rows))
    got = [r.line for r in lines(df, "doc_id").orderBy(text.leading_number(F.col("line")), "line").collect()]
    assert got == ["-2", "abc", ".5", "007", "9", "10", "20000000000000000000", "20000000000000000001"]


def test_human_sort(spark):
    df = frame(spark, "1K\n2\n-1K\n1.5K\n1M\n900")
    got = [r.line for r in lines(df, "doc_id").orderBy(*text.human_number(F.col("line"))).collect()]
    assert got == ["-1K", "2", "900", "1K", "1.5K", "1M"]


def test_version_sort(spark):
    want = ["1.0~rc1", "1.0", "1.0a", "1.0.1", "1.2", "1.10", "a1", "a02", "a10"]
    df = frame(spark, "\n".join(random.Random(1).sample(want, len(want))))
    assert [r.line for r in lines(df, "doc_id").orderBy(text.version_key(F.col("line")), "line").collect()] == want


def test_paragraph_records(spark):
    df = frame(spark, "\n\na\nb\n\n\nc\n")
    assert column(records(df, "doc_id"), "record", ("nr",)) == ["a\nb", "c"]


def test_sequence(spark):
    assert [r.value for r in sequence_rows(spark, "1", "0.5", "2.6", 1).orderBy("n").collect()] == ["1.0", "1.5", "2.0", "2.5"]


def test_pairing_is_one_to_one(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "k string, v int")
    b = spark.createDataFrame([("k", 9), ("z", 8)], "k string, v int")
    got = sorted((r.k, r.l_v or 0, r.r_v or 0) for r in relational.pair_sorted(a, b, "k", ["v"]).collect())
    assert got == [("k", 1, 9), ("k", 2, 0), ("k", 3, 0), ("z", 0, 8)]


def test_comm(spark):
    a = spark.createDataFrame([(x,) for x in "aab"], "k string")
    b = spark.createDataFrame([(x,) for x in "abb"], "k string")
    assert sorted((r.k, r.side, r.n) for r in relational.comm(a, b, "k").collect()) == [("a", 1, 1), ("a", 3, 1), ("b", 2, 1), ("b", 3, 1)]


def test_prefix_traps(spark):
    df = spark.createDataFrame([(p,) for p in ("dir/x", "dir-extra/x", "dir0", "dir")], "path string")
    assert [r.path for r in df.where(relational.below(F.col("path"), "dir")).collect()] == ["dir/x"]
    got = {r.path: r.root for r in relational.longest_prefix(df, spark.createDataFrame([("dir",), ("dir/x",)], "root string")).collect()}
    assert got == {"dir/x": "dir/x", "dir-extra/x": None, "dir0": None, "dir": "dir"}


def test_closure_with_cycle_and_shared_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (3, 4)], "child long, parent long")
    got = sorted((r.node, r.depth) for r in graph.closure(edges, spark.createDataFrame([(0, 1)], "seed int, node long")).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_merge_base_of_a_fork(spark):
    edges = spark.createDataFrame([(4, 2, 0), (3, 2, 0), (2, 1, 0)], "child long, parent long, pos int")
    assert [r.node for r in graph.merge_bases(edges, 3, 4).collect()] == [2]
    got = graph.ahead_behind(edges, spark.createDataFrame([(1, 4, 2), (2, 3, 4), (3, 1, 1)], "pair int, a long, b long"))
    assert {r.pair: r.verdict for r in got.collect()} == {1: "ahead", 2: "diverged", 3: "identical"}


def test_tree_cycle_is_an_error(spark):
    entries = spark.createDataFrame([("t", "d", "40000", "t")], "tree string, name string, mode string, oid string")
    with pytest.raises(ValueError, match="contains itself"):
        graph.walk_tree(entries, spark.createDataFrame([("t",)], "root string"))


def test_tree_diff_rows(spark):
    entries = spark.createDataFrame([("b", "deleted", "100644", "1"), ("b", "mode", "100644", "2"), ("b", "modified", "100644", "3"), ("a", "added", "100644", "4"), ("a", "mode", "100755", "2"), ("a", "modified", "100644", "5")], "tree string, name string, mode string, oid string")
    got = sorted((r.path, r.before_oid, r.after_oid) for r in graph.diff_trees(entries, "b", "a").collect())
    assert got == [("added", None, "4"), ("deleted", "1", None), ("mode", "2", "2"), ("modified", "3", "5")]


def test_renames_prefer_base_names(spark):
    d = spark.createDataFrame([("a/x", "1"), ("a/y", "1"), ("a/z", "2")], "path string, oid string")
    a = spark.createDataFrame([("b/y", "1"), ("b/q", "1"), ("b/w", "3")], "path string, oid string")
    assert sorted((r.source, r.destination) for r in version.pair_renames(d, a).collect()) == [("a/x", "b/q"), ("a/y", "b/y")]


def test_edit_script_is_minimal_and_right():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        script = version.edit_script(a, b)
        out = []
        for kind, p, q, s, t in script:
            out += a[p:q] if kind == "=" else b[s:t] if kind == "+" else []
        assert out == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(q - p for kind, p, q, _, _ in script if kind == "=") == table[-1][-1]
        assert version.apply_patch(a, version.unified(a, b)) == (b, 0) or not script


def test_merge_texts():
    base = list("abcdef")
    assert version.merge_texts(base, list("aXcdef"), list("abcdeY")) == (list("aXcdeY"), 0)
    merged, n = version.merge_texts(base, list("aXcdef"), list("aZcdef"))
    assert n == 1 and merged[1:6] == ["<<<<<<< ours", "X", "=======", "Z", ">>>>>>> theirs"]


def test_listing_forms():
    assert version.normal_diff(list("abcd"), list("axd")) == "2,3c2\n< b\n< c\n---\n> x"
    assert version.normal_diff(list("ab"), list("abcd")) == "2a3,4\n> c\n> d"
    assert version.normal_diff(list("abc"), list("c")) == "1,2d0\n< a\n< b"
    assert version.normal_diff([], ["x"]) == "0a1\n> x" and version.normal_diff(["x"], ["x"]) == ""


def test_combined_diff_rebuilds_every_side():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.choice((2, 3))
        *parents, result = [[rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(n + 1)]
        out = version.combined_diff(parents, result, around=1000)
        if any(p == result for p in parents):
            assert out == ""
            continue
        head, *rows = out.split("\n")
        sides = [[], *([] for _ in parents)]
        for row in rows:
            marks, line = row[:n], row[n:]
            if "-" not in marks:
                sides[0].append(line)
            for k, m in enumerate(marks, 1):
                if m == "-" or (m == " " and "-" not in marks):
                    sides[k].append(line)
        assert sides == [result, *parents]
        assert [int(x.split(",")[1]) for x in head.strip("@ ").split()] == [*(len(p) for p in parents), len(result)]


def test_combined_diff_leaves_one_sided_hunks_out():
    base = [str(i) for i in range(30)]
    ours, theirs, merged = list(base), list(base), list(base)
    ours[3] = merged[3] = "ours"
    theirs[20], merged[20] = "theirs", "both"
    assert version.combined_diff([ours, theirs], merged) == "@@@ -18,7 -18,7 +18,7 @@@\n  17\n  18\n  19\n- 20\n -theirs\n++both\n  21\n  22\n  23"


def test_virtual_base():
    origin = list("abcdefg")
    assert version.virtual_base(origin, []) == origin and version.virtual_base(origin, [list("xbcdefg")]) == list("xbcdefg")
    assert version.virtual_base(origin, [list("xbcdefg"), list("abcdefy")]) == list("xbcdefy")
    assert "=======" in version.virtual_base(origin, [list("xbcdefg"), list("ybcdefg")])


def test_log_line(spark):
    c = {"H": F.lit("0123456789"), "B": F.lit("subject\nbody"), "an": F.lit(None).cast("string")}
    assert one(spark, version.log_line("%h|%s|%B|%an%%%n", c)) == "0123456|subject|subject\nbody|%\n"
    with pytest.raises(ValueError):
        version.log_line("%Z", c)


def test_jaro_and_closest():
    assert round(version.jaro("martha", "marhta"), 4) == 0.9444 and version.jaro("", "") == 1 and version.jaro("a", "") == 0
    assert version.closest("gerp", ["grep", "sort"]) == "grep" and version.closest("zzz", ["grep"]) is None and version.closest("x", []) is None


def test_tree_lines(spark):
    df = spark.createDataFrame([("a/b/x",), ("a/c",), ("z",), ("a/b/y",), ("a/c",), (None,)], "path string")
    rows = relational.tree_lines(df).collect()
    assert [r.line for r in sorted(rows, key=lambda r: r.path.split("/"))] == ["├── a", "│   ├── b", "│   │   ├── x", "│   │   └── y", "│   └── c", "└── z"]
    assert relational.tree_lines(df.limit(0)).count() == 0


def test_closure_can_be_resumed(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(7, 3)], "child long, parent long")
    state, done, calls = spark.createDataFrame([(0, 0, 0)], "seed int, node long, depth int"), False, 0
    while not done:
        state, done = graph.advance(edges, state, 3)
        calls += 1
    assert calls == 3 and sorted((r.node, r.depth) for r in state.collect()) == [(i, i) for i in range(8)]
    assert graph.advance(edges, state.limit(0))[1]


def test_epochs(spark):
    cached = spark.createDataFrame([(1, 5, "kept"), (2, 5, "old")], "k int, epoch int, v string")
    epochs = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "k int, epoch int")
    out = incremental.revalidated(cached, epochs, ["k"], "epoch", lambda keys: epochs.join(keys, "k", "left_semi").withColumn("v", F.lit("new")))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, "kept"), (2, 6, "new"), (3, 1, "new")]


def test_sinks(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([("b",), ("a",)], "line string")
    assert sorted(r.line for r in sinks.tee(df, f"{at}/one", f"{at}/two").collect()) == ["a", "b"] and spark.read.parquet(f"{at}/two").count() == 2
    sinks.edit_in_place(spark, f"{at}/one", lambda t: t.where("line = 'a'"))
    assert [r.line for r in spark.read.parquet(f"{at}/one").collect()] == ["a"] and not [p.name for p in tmp_path.iterdir() if p.name.endswith((".old", ".new"))]
    sinks.append_lines(df, f"{at}/log")
    sinks.append_lines(df, f"{at}/log")
    assert spark.read.text(f"{at}/log").count() == 4
    for _ in range(2):
        sinks.append_stream(spark.readStream.schema("line string").parquet(f"{at}/two"), f"{at}/out", f"{at}/cp").awaitTermination()
    assert spark.read.parquet(f"{at}/out").count() == 2


def test_blob_id(spark):
    assert one(spark, version.blob_id(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_ignore_rules(spark):
    rules = ["*.log", "!keep.log", "/build/", "docs/*.txt"]
    got = {p: one(spark, version.ignored(F.lit(p), rules)) for p in ("a.log", "x/keep.log", "build/x", "src/build/x", "docs/a.txt", "x/docs/a.txt")}
    assert got == {"a.log": True, "x/keep.log": False, "build/x": True, "src/build/x": False, "docs/a.txt": True, "x/docs/a.txt": False}


def test_jq_functions(spark):
    assert one(spark, F.array_join(jq.split(F.lit("a, b"), ", "), "|")) == "a|b"
    assert one(spark, F.size(jq.split(F.lit(""), ","))) == 0
    assert one(spark, jq.slice_text(F.lit("abc"), -2, None)) == "bc"
    assert one(spark, F.array_join(jq.indices(F.lit("aaaa"), "aa").cast("array<string>"), ",")) == "0,1,2"
    assert one(spark, jq.uri(F.lit("a b~*+/é"))) == "a%20b~%2A%2B%2F%C3%A9"
    assert one(spark, jq.modulo(F.lit(-5), F.lit(3))) == -2
    assert one(spark, jq.modulo(F.lit(5), F.lit(0))) is None
    assert one(spark, jq.round_half_away(F.lit(-2.5))) == -3
    assert one(spark, jq.shell(F.lit("it's"))) == "'it'\\''s'"
    left = F.array(F.lit(1), F.lit(1), F.lit(2), F.lit(3), F.lit(3))
    assert one(spark, jq.without(left, F.array(F.lit(1)))) == [2, 3, 3]


def test_awk_functions(spark):
    assert one(spark, awk.number(F.lit(" 12.5abc"))) == 12.5
    assert one(spark, awk.number(F.lit("0x10"))) == 0
    assert one(spark, awk.compare(F.lit("10"), F.lit("9"))) == 1
    assert one(spark, awk.compare(F.lit("10"), F.lit("9"), left_is_text=True)) == -1
    assert one(spark, awk.substr(F.lit("hello"), F.lit(0.0), F.lit(3.0))) == "he"
    assert [one(spark, awk.to_text(F.lit(x))) for x in (3.0, 0.1, 1234.5678)] == ["3", "0.1", "1234.57"]


def test_numbers(spark):
    assert [one(spark, numbers.human_size(F.lit(x))) for x in (0, 1023, 1024, 10240, 1025)] == ["0", "1023", "1.0K", "10K", "1.1K"]
    assert one(spark, numbers.change_mode(F.lit(0o644), "u+x")) == 0o744
    assert one(spark, numbers.equal_width(F.lit(-5), 4)) == "-005"


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("sort | uniq -c | sort -rn | head -n 1", ["      2 b"]),
        ("grep -v b | tr a-z A-Z", ["A", "C"]),
        ("sed s/b/X/ | tail -n 2", ["X", "c"]),
        ("wc -l", ["4"]),
        ("tac | nl | cut -f 2", ["c", "b", "a", "b"]),
        ("grep -c b", ["2"]),
    ],
)
def test_pipelines(spark, command, want):
    df = lines(frame(spark, "b\na\nb\nc"), "doc_id")
    assert column(shell.run(df, command), "line") == want


def test_unknown_command_is_named(spark):
    with pytest.raises(ValueError, match="did you mean 'grep'"):
        shell.run(lines(frame(spark, "a"), "doc_id"), "gerp a")


def test_upsert_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, g int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.read_changes(spark, str(tmp_path / "in"), rows.schema)
    for _ in range(2):
        incremental.upsert_stream(stream, f"file://{tmp_path}/out", ["k"], "g", str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/v=0").orderBy("k").collect()
    assert [(r.k, r.v) for r in got] == [(1, "b"), (2, "c")]


def test_pushdown_reaches_the_scan(spark, sf):
    from weft.sources.tables import load

    plan = load(spark, sf, "documents").where((F.col("lang") == "en") & F.col("source").startswith("src1")).select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "StringStartsWith(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_queries_survive_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['weft.llm'] = None; sys.modules['corpus_pipeline'] = None; import weft.plans; print(len(weft.plans.registered()[0]))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0]).stdout) > 150


def _least_edits(a, b):
    """Lines inserted and deleted by a shortest edit script: a table over all pairs of places."""
    above = [0] * (len(b) + 1)
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(above[j] + 1 if x == y else max(above[j + 1], here[j]))
        above = here
    return len(b) - above[-1], len(a) - above[-1]


def test_line_diffs_and_merges_of_the_tables(spark, sf):
    """dif_02, dif_03, agg_12 and dif_12 against tables over all pairs of lines, and against the edit itself."""
    import collections
    import hashlib
    import os

    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    from weft.plans import registered

    queries = registered()[0]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, edited = {}, {}
    for d, r in docs.items():
        a = r.text.split("\n")
        b = [x + " edited" if (i + 1) % 7 == 0 else x for i, x in enumerate(a) if (i + 1) % 5] + ["the end"]
        want[d], edited[d] = _least_edits(a, b), "\n".join(b)
    assert {r.doc_id: (r.inserted, r.deleted) for r in queries["dif_02_line_diff"](spark, sf).collect()} == want
    total = collections.Counter()
    for d, (i, e) in want.items():
        total.update({(docs[d].source, "files"): 1, (docs[d].source, "i"): i, (docs[d].source, "d"): e})
    assert {r.source: (r.files, r.insertions, r.deletions) for r in queries["agg_12_diff_summary"](spark, sf).collect()} == {s: (total[s, "files"], total[s, "i"], total[s, "d"]) for s in {r.source for r in docs.values()}}
    for r in queries["dif_03_unified_hunks"](spark, sf).collect():
        body = [line for line in r.hunks.split("\n") if line]
        assert sum(x[0] == "+" for x in body) == want[r.doc_id][0] and sum(x[0] == "-" for x in body) == want[r.doc_id][1]
    for r in queries["dif_12_text_merge"](spark, sf).collect():
        assert r.conflicts or r.sha1 == hashlib.sha1(("preface\n" + edited[r.doc_id]).encode()).hexdigest()
    assert {r.doc_id: r.sha1 for r in queries["dif_16_patch"](spark, sf).collect()} == {d: hashlib.sha1(t.encode()).hexdigest() for d, t in edited.items()}


def test_links_that_never_end_are_told(spark):
    from weft.operators.graph import follow_links, levels

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "src long, dst long")
    got = {r.start: (r.target, r.looped) for r in follow_links(spark.createDataFrame([(0,), (30,), (100,), (200,)], "start long"), links).collect()}
    assert got == {0: (None, True), 30: (60, False), 100: (None, True), 200: (200, False)}
    with pytest.raises(ValueError):
        levels(links.select(links.src.alias("child"), links.dst.alias("parent")), links.select(links.src.alias("node")).distinct())


def test_a_broken_publish_is_put_back(spark, tmp_path):
    import os

    from weft.sources.sinks import publish, recover

    path = str(tmp_path / "table")
    publish(spark.range(3), path)
    os.rename(path, path + ".old")  # as if the program ended between the two moves
    assert recover(spark, path) and spark.read.parquet(path).count() == 3
    publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["table"]


def test_latest_does_not_depend_on_order(spark):
    from weft.streaming.incremental import latest

    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, 1, "d")]
    one, two = (sorted(map(tuple, latest(spark.createDataFrame(r, "k int, g int, v string"), ["k"], "g").collect())) for r in (rows, rows[::-1]))
    assert one == two and one[0][2] in "ab"


def test_min_max_by_of_keys_beyond_a_million(spark, tmp_path):
    """agg_16 orders by the sum of its SQL, in which a large key outweighs its remainder; a null key is passed over."""
    duckdb = pytest.importorskip("duckdb")
    from weft.plans import registered

    rows = [(1, 6), (1, 7_000_000), (1, 7_000_001), (2, None), (2, 9), (2, 5_000_001), (3, None), (None, -8), (None, 2_000_000), (4, 13), (4, 14)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    queries, sql = registered()
    got = sorted((tuple(r[c] for c in ("o_custkey", "low", "high")) for r in queries["agg_16_min_max_by"](spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.sql(sql["agg_16_min_max_by"]).fetchall(), key=repr)
    assert got == sorted([(1, 6, 7_000_001), (2, 9, 5_000_001), (3, None, None), (4, 14, 13), (None, -8, 2_000_000)], key=repr)
