"""Publication interrupted at every step ends with all of the new state or all of the old."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from seedquorum.operators.relational import ValidationError
from seedquorum.sources import files, journal


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(5).withColumn("v", F.lit("old"))


@pytest.fixture(scope="module")
def template(spark, frame, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("home") / "h")
    journal.publish(spark, home, {"table": frame, "note": b"old note"})
    return home


def state(spark, home):
    out = {n: open(f"{home}/{n}", "rb").read() for n in ("note", "extra", "gate") if os.path.exists(f"{home}/{n}")}
    if os.path.exists(f"{home}/table"):
        out["table"] = {r["v"] for r in spark.read.parquet(f"{home}/table").collect()}
    return out


OLD = {"note": b"old note", "table": {"old"}}
NEW = {"note": b"new note", "extra": b"e", "gate": b"g", "table": {"new"}}
WRITES = ("create", "rename", "replace", "delete")


class Crash(BaseException):
    """Like the process's end: nothing but recovery may see it."""


def crash_before(monkeypatch, n):
    """The n-th change to the store, and so all after it, never happens: also what a crash after the one before leaves."""
    seen = [0]
    for name in WRITES:

        def wrapped(self, *args, _f=getattr(journal.Store, name)):
            seen[0] += 1
            if seen[0] == n:
                raise Crash
            return _f(self, *args)

        monkeypatch.setattr(journal.Store, name, wrapped)
    return seen


def renew(spark, frame, home):
    journal.publish(spark, home, {"note": b"new note", "extra": b"e", "table": frame.withColumn("v", F.lit("new")), "gate": b"g"}, replace=("note", "table"))


def test_every_interruption(spark, frame, template, tmp_path):
    ends, n = [], 0
    while True:
        n += 1
        home = f"{tmp_path}/{n}"
        shutil.copytree(template, home)
        with pytest.MonkeyPatch.context() as m:
            seen = crash_before(m, n)
            try:
                renew(spark, frame, home)
                ended = True
            except Crash:
                ended = False
        if ended and seen[0] < n:
            break
        complete = ended or journal.recover(spark, home)
        assert state(spark, home) == (NEW if complete or os.path.exists(f"{home}/gate") else OLD), n
        assert not os.path.exists(f"{home}/_publication") and journal.published(spark, home) == [], n
        assert journal.recover(spark, home) is False
        ends.append(os.path.exists(f"{home}/gate"))
    assert True in ends and False in ends and len(ends) > 12


def overwrite(path, content):
    """By something that isn't Hadoop, and so leaves no checksum file."""
    folder, name = os.path.split(path)
    if os.path.exists(f"{folder}/.{name}.crc"):
        os.remove(f"{folder}/.{name}.crc")
    with open(path, "wb") as f:
        f.write(content)


def test_foreign_content_is_kept(spark, frame, template, tmp_path):
    home = f"{tmp_path}/h"
    shutil.copytree(template, home)
    with pytest.MonkeyPatch.context() as m:
        real = journal.Store.rename

        def crash(self, old, new):
            real(self, old, new)
            if new == "extra":
                raise Crash

        m.setattr(journal.Store, "rename", crash)
        with pytest.raises(Crash):
            renew(spark, frame, home)
    overwrite(f"{home}/extra", b"someone else's")
    with pytest.raises(ValidationError, match="other content"):
        journal.recover(spark, home)
    assert state(spark, home)["extra"] == b"someone else's" and os.path.isdir(f"{home}/_publication")
    with pytest.raises(ValidationError, match="other content"):
        renew(spark, frame, home)
    text = json.loads(open(f"{home}/_publication/journal.json").read())
    for broken in ("{", json.dumps(text | {"version": 2}), json.dumps(text | {"entries": text["entries"] * 2})):
        overwrite(f"{home}/_publication/journal.json", broken.encode())
        with pytest.raises(ValidationError, match="damaged"):
            journal.recover(spark, home)


def test_refusals_and_checks(spark, frame, template, tmp_path):
    home = f"{tmp_path}/h"
    shutil.copytree(template, home)
    with pytest.raises(ValidationError, match="exist"):
        journal.publish(spark, home, {"note": b"x"})
    with pytest.raises(ValidationError, match="stays closed"):
        journal.publish_gate(spark, home, {"more": frame}, "gate", {"none": frame.limit(0), "some": frame})
    assert state(spark, home) == OLD and not os.path.exists(f"{home}/more")
    journal.publish_gate(spark, home, {"more": frame}, "gate", {"none": frame.limit(0)})
    assert json.loads(open(f"{home}/gate").read())["covers"] == ["more"]
    os.remove(f"{home}/gate")
    shutil.rmtree(f"{home}/more")
    frame.limit(2).write.parquet(f"{home}/more")
    assert sorted(journal.published(spark, home)) == [("gate", "absent"), ("more", "changed")]


def test_digests_of_folders(spark, frame, tmp_path):
    for name, n in (("a", 3), ("b", 3), ("c", 4)):
        spark.range(n).coalesce(1).write.csv(f"{tmp_path}/x/{name}")
    shutil.copytree(f"{tmp_path}/x", f"{tmp_path}/y")
    shutil.rmtree(f"{tmp_path}/y/a")
    spark.range(9).coalesce(1).write.mode("append").csv(f"{tmp_path}/y/b")
    shutil.copytree(f"{tmp_path}/x/c", f"{tmp_path}/y/d")
    got = files.compare_baseline(files.folder_digests(spark, f"{tmp_path}/x"), files.folder_digests(spark, f"{tmp_path}/y"))
    assert {tuple(r) for r in got.collect()} == {("a", "removed"), ("b", "changed"), ("c", "same"), ("d", "added")}
    alike = files.folder_digests(spark, f"{tmp_path}/x", names=False).collect()
    assert len({r["sha256"] for r in alike}) == 2 and {r["n_files"] for r in alike} == {1}
