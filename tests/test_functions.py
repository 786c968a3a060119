"""Text, shell, redaction, digests, references and globs, by example and by property."""

import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import digests, globs, references, text
from threadloom.functions.redaction import redact
from threadloom.functions.shell import shell_access, tool_call_access
from threadloom.operators import chunks

#: What a script writes when it runs in /srv/app.
SCRIPTS = {
    "redirections": [
        ("date >> logs/run.log; wc -l < data.csv | sort > counts.txt", ["/srv/app/logs/run.log", "/srv/app/counts.txt"]),
        ("build 2> errors.txt 1>/tmp/out", ["/srv/app/errors.txt", "/tmp/out"]),
        ("build >/dev/null 2>&1", []),
        ("build &> both.txt; build >&- ; build >| forced", ["/srv/app/both.txt", "/srv/app/forced"]),
        ("cat <<END > /etc/motd\nrm /srv/precious\nEND\ntouch after", ["/etc/motd", "/srv/app/after"]),
        ("tr a b <<< 'rm x' > y", ["/srv/app/y"]),
        ("diff <(sort one) <(sort two) > three", ["/srv/app/three"]),
    ],
    "quotes": [
        ("touch 'a file' \"b \\\"c\\\"\" d\\ e", ["/srv/app/a file", '/srv/app/b "c"', "/srv/app/d e"]),
        ("echo 'rm all; touch none'", []),
        ("touch 'never closed", ["/srv/app/never closed"]),
    ],
    "files": [
        ("mkdir -p ~/new && chmod 600 key", ["/home/user/new", "/srv/app/600", "/srv/app/key"]),
        ("install -m 755 tool /usr/local/bin/tool; ln -s a b; cp only", ["/usr/local/bin/tool", "/srv/app/b"]),
        ("mv -t ../attic p q", ["/srv/attic"]),
        ("rsync -a here/ backup.host:there/", []),
        ("perl -pi -e 's/x/y/' m.pl n.pl; sed 's/x/y/' m.pl; sed --in-place=.bak s/x/y/ k.txt", ["/srv/app/m.pl", "/srv/app/n.pl", "/srv/app/k.txt"]),
    ],
    "git": [
        ("git log; git diff; git stash list; git checkout dev; git worktree prune", []),
        ("git stash; git tag v1", ["/srv/app", "/srv/app"]),
        ("git -C ../lib pull", ["/srv/lib"]),
        ("git -c user.name=x --git-dir=/srv/bare.git push", ["/srv/bare.git"]),
        ("git checkout -- a.txt && git worktree remove ../tree", ["/srv/app", "/srv/tree", "/srv/app"]),
    ],
    "runners": [
        ("npm ci && npm audit; yarn upgrade", ["/srv/app", "/srv/app"]),
        ("cd sub || exit; LEVEL=2 nohup make all", ["/srv/app/sub"]),
        ("cd /srv/other\npnpm exec lint\n", ["/srv/other"]),
    ],
    "github": [
        ("gh issue close 3", ["/srv/app"]),
        ("gh pr list; gh issue view 3", []),
        ("gh api -X POST repos/{owner}/{repo}/labels", ["/srv/app"]),
    ],
}


@pytest.mark.parametrize(("script", "writes"), [case for cases in SCRIPTS.values() for case in cases])
def test_what_a_script_writes(script, writes):
    assert shell_access(script, "/srv/app").writes == writes


def test_what_a_script_names():
    found = shell_access("grep -r x src/lib ./a.txt ~ plain --file=in/put 10% | tee log", "/srv/app")
    assert found.paths == ["/srv/app/src/lib", "/srv/app/a.txt", "/home/user", "/srv/app/in/put"]
    assert shell_access("cat a/b", None).paths == [] and shell_access("cat /a/b", None).paths == ["/a/b"]


def test_repositories_that_a_script_changes():
    named = ["gh issue comment 9 -R Team/Web", "gh issue comment 9 --repo=git@github.com:team/web.git", "gh pr merge https://github.com/team/Web/pull/9", "gh api --method=PATCH /repos/team/WEB/pulls/9", "gh api repos/Team/web/labels --field name=x"]
    for script in named:
        found = shell_access(script, "/srv/app")
        assert (found.writes, found.repositories) == ([], ["team/web"]), script
    for script in ("gh issue list -R team/web", "gh api repos/team/web", "gh api --method GET repos/team/web -f page=2"):
        assert shell_access(script, "/srv/app").repositories == []


@pytest.mark.parametrize(("value", "slug"), [("https://www.github.com/A/B.git", "a/b"), ("ssh://git@github.com/a/b", "a/b"), ("a/b#3", "a/b"), ("a/b@main", "a/b"), ("a/.git", "a/.git"), ("a", None), ("a b/c", None), ("https://example.org/a/b", None), ("", None)])
def test_repository_names(spark, value, slug):
    assert references.repository_of(value) == slug
    assert spark.range(1).select(references.repository_slug(F.lit(value)).alias("s")).first()["s"] == slug


def test_tool_calls():
    call = lambda name, given, key="input": json.dumps({"name": name, key: given})
    assert tool_call_access(call("write_file", {"path": "notes/n.md"}), "/srv/app").writes == ["/srv/app/notes/n.md"]
    looked = tool_call_access(call("Grep", {"path": "/srv/lib", "pattern": "x"}), "/srv/app")
    assert (looked.paths, looked.writes) == (["/srv/lib"], [])
    ran = tool_call_access(call("shell", json.dumps({"command": ["touch", "a b"], "workdir": "tmp/"}), "arguments"), "/srv/app")
    assert ran.writes == ["/srv/app/tmp/a b"]
    cell = """await tools.exec_command({"cmd": "npm install", workdir: '/srv/web'}); tools.apply_patch(`*** Add File: new.py\n+x\n*** Move to: /srv/old.py`); tools.exec_command({cmd: "head docs/c.md"})"""
    found = tool_call_access(call("exec", cell, "arguments"), "/srv/app")
    assert found.writes == ["/srv/web", "/srv/app/new.py", "/srv/old.py"]
    assert {"/srv/app/docs/c.md", "/srv/web"} <= set(found.paths)
    assert tool_call_access("no json").paths == []
    assert tool_call_access(None).paths == []
    assert tool_call_access("[1]").paths == []


@given(st.text(max_size=200))
def test_shell_takes_any_text(script):
    shell_access(script, "/w")


def test_typed_prompt():
    assert text.typed_prompt("<system-reminder>x</system-reminder>hi") == "hi"
    assert text.typed_prompt("<a-b>x</a-b> <c_d y>z</c_d>") is None
    assert text.typed_prompt("<b>bold</b>") == "<b>bold</b>"
    assert text.typed_prompt("# User Message\nhello\n# Assistant Message\nno") == "hello"
    assert text.typed_prompt("[Request interrupted by user]") is None
    assert text.typed_prompt("# AGENTS.md instructions for /w\nrest") == "rest"
    assert text.typed_prompt("") is None


def test_tag_blocks():
    for whole in ("<my-tag>x</my-tag>", " <a_b c='d'>\n<e-f></a_b>\n<g-h></g-h> ", "<a-b><a-b></a-b>"):
        assert text.only_tag_blocks(whole), whole
    for other in ("", " ", "<b>x</b>", "<a-b>x</a-b> y", "x <a-b></a-b>", "<a-b>x</c-d>", "<a-b>x</a-b><c-d>"):
        assert not text.only_tag_blocks(other), other


def test_tag_blocks_take_linear_time():
    import time

    times = []
    for n in (20_000, 80_000):
        start = time.process_time()
        assert text.only_tag_blocks("<some-tag>body</some-tag>\n" * n)
        assert not text.only_tag_blocks("<some-tag>" * n) and not text.only_tag_blocks("<some-tag>body</some-tag>" * n + "end")
        times.append(time.process_time() - start)
    assert times[1] < 2 and times[1] < 12 * times[0] + 0.1


def test_quoted_origins(spark):
    cases = [
        ('<agent-message from="a1">x</agent-message>', ["root/agent-a1"]),
        ("<agent-message>x</agent-message>", ["unknown"]),
        ("<task-notification><task-id>t</task-id></task-notification>", ["root/agent-t"]),
        ("<task-notification>none</task-notification>", ["unknown"]),
        ("<teammate-message x>", ["unknown"]),
        ("plain", None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select(text.quoted_origins(F.col("t"), F.lit("root")).alias("o"))
    assert [r["o"] for r in df.collect()] == [c[1] for c in cases]


def test_redaction():
    said = [{"text": "abc def", "reason": "secret"}]
    assert redact("x abc def y", said) == "x [redacted: secret] y"
    assert redact("x ABC   def y", said) == "x [redacted: secret] y"
    assert redact("aaa", [{"text": "aa", "reason": "other"}]) == "[redacted: other]"
    run = [{"text": "one two three four five", "reason": "career"}]
    assert redact("say two three four five now", run) == "say [redacted: career] now"
    both = [{"text": "ab", "reason": "secret"}, {"text": "bc", "reason": "career"}]
    assert redact("abc", both) == "[redacted: secret, career]"
    roster = [{"text": "Dana is late", "reason": "coworker"}]
    assert redact("Fine. Dana did it; ok", roster, ["Dana"]) == "Fine. [redacted: coworker]; ok"
    assert redact("keep abc", [{"text": "abc", "reason": "other", "echoOnly": True}]) == "keep [redacted: other]"
    assert redact(None, said) is None


@given(st.text(alphabet="ab \n", max_size=60), st.text(alphabet="ab ", min_size=1, max_size=6))
def test_redaction_removes_every_span(whole, span):
    assert span not in re.sub(r"\[redacted: other\]", "\0", redact(whole, [{"text": span, "reason": "other"}]))


@given(st.text(max_size=3000), st.integers(16, 64))
def test_chunks_are_lossless_and_within_budget(whole, budget):
    cut = list(chunks.pieces(whole, budget))
    assert "".join(whole[a:b] for a, b, _ in cut) == whole
    assert all(n <= budget or b - a == 1 for a, b, n in cut)


def test_canonical_json():
    value = {"b": 1.0, "a": None, "timestamp": None, "c": "é\n\x1f"}
    assert digests.canonical_json(value) == '{"b":1,"timestamp":null,"c":"é\\n\\u001f"}'


def test_session_key(spark):
    import hashlib

    row = spark.range(1).select(digests.session_key(F.lit("s"), F.lit("codex"), F.lit('a"b')).alias("k")).first()
    assert row["k"] == hashlib.sha256(b'["s","codex","a\\"b"]').hexdigest()


def test_references(spark):
    cases = {
        "(http://github.com/Team/Web.js/issues/7), github.com/a/b/pull/10/files": ["team/web.js#7", "a/b#10"],
        "github.com/a/b/commit/feedc0de99 then github.com/a/b/pull/1": ["a/b#1", "a/b@feedc0d"],
        "github.com/a/b/commit/FEEDC0DE github.com/a/b/commit/fee github.com/a/b/commit/feedc0dexyz": [],
        "github.com/a/b/pull/x github.com/a b/pull/1 github.com/a/b": [],
        "see linear.app/acme-co/issue/web2-31/title and linear.app/acme/project/x": ["WEB2-31"],
        "https://x.test/item/k-1/#top... or https://x.test/item/": ["k-1/#top"],
    }
    known = (*references.INTEGRATIONS, references.Integration("own", "https://x.test/item/"))
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(F.transform(references.references(F.col("t"), known), lambda r: r["ref"]).alias("r"))
    assert [r["r"] for r in df.collect()] == list(cases.values())
    p = spark.range(1).select(references.provenance(F.lit("git@github.com:O/R.git"), F.lit("main")).alias("p")).first()["p"]
    assert [x["ref"] for x in p] == ["o/r", "o/r/tree/main"]


def test_globs():
    home = "/home/u"
    assert globs.folder_glob("~/code/**", home) == "/home/u/code"
    assert globs.folder_glob("./a/", home) == "**/a"
    for bad in ("", ".", "a/../b", "/**"):
        with pytest.raises(ValueError):
            globs.folder_glob(bad, home)
    for bad in ("~", "/home", "**"):
        with pytest.raises(ValueError):
            globs.exclude_glob(bad, home)
    assert re.match(globs.pattern("**/a"), "/x/a/b")
    assert not re.match(globs.pattern("**/a"), "/x/ab")


def test_clip_and_terms(spark):
    row = spark.createDataFrame([("  a \n b c  ",)], "t string").select(text.clip(F.col("t"), 3).alias("c"), text.clip(F.col("t"), 30).alias("d")).first()
    assert (row["c"], row["d"]) == ("a b…", "a b c")
    assert text.terms_of("Foo bar-baz foo_1 ü") == ["foo", "bar-baz", "foo_1", "ü"]
