import json

from tracemill.sources import gitlog
from tracemill.sources.lines import read_lines

LOG = """\
aaa1|aaa|fix: a | b|Ann|ann@x.org|2026-01-03T10:00:00+02:00|p1 p2

3\t0\tnew.ts
0\t4\told.ts
-\t-\timg|1.png
bbb2|bbb|no files|Bob|bob@x.org|2026-01-02T10:00:00Z|
ccc3|ccc|edit|Ann|ann@x.org|2026-01-01T10:00:00Z|p3

1\t2\tsrc/a b.ts
"""
REFLOG = """\
0a 0b Ann <ann@x.org> 1767348000 +0100\tcheckout: moving from main to dev
0b 0c Ann <ann@x.org> 1767348001 +0100\tcommit: something
0c 0d Ann <ann@x.org> 1767434400 +0100\tcheckout: moving from dev to main
"""


def lines(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return read_lines(spark, str(tmp_path / name))


def test_commits(spark, tmp_path):
    rows = gitlog.commits(lines(spark, tmp_path, "log", LOG)).orderBy("commit_no").collect()
    assert [(r.sha, r.message, r.author_name, r.insertions, r.deletions, len(r.files)) for r in rows] == [
        ("aaa1", "fix: a | b", "Ann", 3, 4, 3),
        ("bbb2", "no files", "Bob", 0, 0, 0),
        ("ccc3", "edit", "Ann", 1, 2, 1),
    ]
    assert [(f.path, f.status) for f in rows[0].files] == [("new.ts", "A"), ("old.ts", "D"), ("img|1.png", "M")]
    assert rows[0].parents == ["p1", "p2"] and rows[1].parents == []


def test_filters(spark, tmp_path):
    log = lines(spark, tmp_path, "log", LOG)
    assert gitlog.commits(log, since="2026-01-02T00:00:00Z", author="Ann").count() == 1
    reflog = lines(spark, tmp_path, "reflog", REFLOG)
    assert gitlog.switches(reflog).count() == 2
    assert gitlog.switches(reflog, since="2026-01-03T00:00:00Z").count() == 1


def test_events(spark, tmp_path):
    commits = gitlog.commits(lines(spark, tmp_path, "log", LOG))
    switches = gitlog.switches(lines(spark, tmp_path, "reflog", REFLOG))
    events = gitlog.normalize(commits, switches, "s", "d", "p", "now").orderBy("source_seq").collect()
    assert [e.source_seq for e in events] == [0, 1, 2, 3, 4]
    assert events[2].text_redacted == 'git commit ccc: "edit"\nFiles: src/a b.ts (+1 -2)'
    assert events[1].text_redacted == 'git commit bbb: "no files"\nFiles: '
    assert events[0].git.insertions == 3 and events[0].git.files_changed == 3
    assert events[0].file_paths == ["new.ts", "old.ts", "img|1.png"] and events[1].file_paths is None
    assert events[3].text_redacted == "git checkout: main → dev"
    assert events[3].event_ts == "2026-01-02T10:00:00.000Z" and events[3].git.to_branch == "dev"
    assert json.loads(events[0].meta_json)["author_email"] == "ann@x.org"
    assert events[0].event_date == "2026-01-03" and events[0].event_time.hour == 8
