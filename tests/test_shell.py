"""The command front end against the tools of the system, in byte order."""

import os
import shutil
import subprocess

import pytest

from weft.plans import shell
from weft.plans.sed import evaluate, parse

FILES = {
    "a.txt": "pear 10 x\nplum 2 y\n\n\nkiwi 30 Z\nplum 2 y\nfig\t7 TODO q\nApple 1.5K x\n",
    "src/b.ts": "// TODO one\nlet a = 1\nlet b = 2\n// todo two\nTODO three\nend\n",
    "src/deep/c.ts": "nothing\n",
    "src/d.md": "# TODO list\nitem 10\nitem 9\nv1.10 b\nv1.9 a\n",
}
ONE = [
    "head -3", "tail -2", "head -n -2", "tail -n +3", "head -c 13", "tail -c 9", "cat -n", "cat -b", "cat -s", "cat -A", "cat -sn", "nl", "nl -v 5 -i 2 -w 3 -b a", "nl -s :",
    "sort", "sort -r", "sort -f", "sort -k2,2n", "sort -k2.2,2.2 -k1,1r", "sort -t ' ' -k 3 -k 2nr", "sort -u", "sort -k1,1 -u", "sort -n", "sort -h", "sort -b -k2", "sort -s -k3,3", "sort -V", "sort -d", "sort --reverse --key=1,1",
    "grep -n plum", "grep -c x", "grep -v plum", "grep -i todo", "grep -m 1 plum", "grep -A 1 kiwi", "grep -n -C 1 fig", "grep -nB 1 plum", "grep -o -n '[0-9]'", "grep -E 'kiwi|fig'", "grep -w x", "grep -x fig", "grep -e pear -e kiwi",
    "sed 2p", "sed -n 2p", "sed -n s/p/P/p", "sed -n '/plum/,/kiwi/p'", "sed '2,4d'", "sed '$d'", "sed '/^$/d'", "sed 's/[a-z]*/<&>/2'", "sed -E 's/([a-z]+) ([0-9]+)/\\2 \\1/g'", "sed 3q", "sed -n '$='", "sed -e 2d -e s/x/X/", "sed '1~3d'", "sed '/kiwi/,+1d'", "sed '2!d'", "sed 'y/abc/xyz/'", "sed -n '/plum/{=;p}'", "sed 's/a/b/2g;s/z/y/I'", "sed 'n;d'",
    "sort | uniq -c", "sort | uniq -d", "cut -d ' ' -f 1,3", "tr a-z A-Z", "tr -d aeiou", "tr -s p", "wc -l", "rev", "tac", "sort -k2,2n | head -2 | cut -c 1-3",
]
MANY = ["find . -name '*.ts' | xargs grep -n TODO | head -20", "find . -type f | sort", "find src -name '*.ts' -o -name '*.md' | sort", "find . -not -name '*.ts' -a -type f | sort", "find . ( -name 'a*' -o -name 'd*' ) -type f | sort", "find . -maxdepth 1 -type f | sort", "find . -type f -size -1k | sort", "find . -path './src/*' -type f | sort", "find . -type f | sort | xargs grep -l TODO", "find . -type f | sort | xargs grep -c TODO", "find . -type f | sort | xargs grep -h -i todo", "find . -type f | sort | xargs cat"]
REFUSED = ["head -z", "cat a.txt > out", "sort -k x", "nl -q", "cat --wat", "grep", "tac -x", "sed 2w", "find . -wat", "sort -o f", "cut -d ,", "xargs frobnicate", "grep a 2> b", "tail -f", "uniq a b"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, i + 1, line) for p, t in FILES.items() for i, line in enumerate(t.removesuffix("\n").split("\n"))]
    return spark.createDataFrame(rows, "path string, ln long, line string").cache()


def lines_of(df):
    return [r.line for r in sorted(df.collect(), key=lambda r: (r.path or "", r.ln))]


def system(command, cwd):
    done = subprocess.run(["sh", "-c", command], cwd=cwd, capture_output=True, text=True, env={**os.environ, "LC_ALL": "C"})
    return done.stdout.removesuffix("\n").split("\n") if done.stdout else []


@pytest.mark.parametrize("command", ONE)
def test_one_file(spark, files, tmp_path, command):
    if not shutil.which(command.split()[0]):
        pytest.skip("no such tool here")
    (tmp_path / "a.txt").write_text(FILES["a.txt"])
    got = lines_of(shell.run(files.where("path = 'a.txt'"), command, ("path",)))
    assert got == system(f"cat a.txt | {command}", tmp_path)


@pytest.mark.parametrize("command", MANY)
def test_many_files(files, tmp_path, command):
    if not shutil.which("find") or not shutil.which("xargs"):
        pytest.skip("no such tool here")
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    want = system(command.replace("(", "\\(").replace(")", "\\)"), tmp_path)
    got = lines_of(shell.run(files, command, ("path",)))
    plain = lambda rows: [r.removeprefix("./") for r in rows]
    assert sorted(plain(got)) == sorted(plain(want))


def test_pipelines_in_a_row(files):
    one = files.where("path = 'a.txt'")
    run = lambda c: lines_of(shell.run(one, c, ("path",)))
    assert run("grep kiwi ; head -1") == ["kiwi 30 Z", "pear 10 x"]
    assert run("grep -q kiwi && head -1") == ["pear 10 x"]
    assert run("grep nowhere && head -1") == []
    assert run("grep nowhere || head -1") == ["pear 10 x"]
    assert run("grep kiwi || head -1") == ["kiwi 30 Z"]
    assert run("rg -S KIWI ; rg -S kiwi") == ["kiwi 30 Z"]


@pytest.mark.parametrize("command", REFUSED)
def test_what_is_not_known_is_an_error(files, command):
    with pytest.raises(ValueError):
        shell.run(files, command, ("path",))


def test_sed_scripts():
    text = "one two three four five".split()
    for script, quiet, want in [("3i\\\nins", False, "one two ins three four five"), ("2a after", False, "one two after three four five"), ("2,3c changed", False, "one changed four five"), ("2,1p", True, "two")]:
        assert evaluate(parse(script), text, quiet) == want.split()
    for script in ("{p", "p}", "s/a/b", "y/ab/c/", "2,d", "s/a/b/w", "k"):
        with pytest.raises(ValueError):
            parse(script)
