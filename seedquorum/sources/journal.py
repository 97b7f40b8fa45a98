"""Publication of several tables and documents together: all of them, or none.

Everything is staged beside the targets first. A journal then names each target with the digest of what will be there and of what is
there now; only after it is written do renames install the staged state, in the given order, so that a gate document comes last. A receipt
tells later readers which digests were published. Whatever ended the process, ``recover`` finds from the journal and the targets'
digests how far it came: a complete set gets its receipt, anything less is rolled back, and a target with other content is left as it is, with an error.

Files are hashed by Spark on the executors and renamed by Hadoop's FileSystem, so any store does that renames folders at once (an object store
that copies instead isn't safe between two renames, only after recovery). Files of over 2 GB can't be hashed.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedquorum.operators.relational import ValidationError
from seedquorum.sources.files import folder_digests

PLACE, JOURNAL, RECEIPT, OWNER = "_publication", "journal.json", "_receipt.json", "owner"


class Store:
    """The few file operations that publication needs, in any store that Spark knows."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.at(name)).isDirectory()

    def create(self, name: str, content: bytes) -> None:
        """Fails if it is there."""
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(content))
        out.hflush()
        out.close()

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self.fs.rename(self.at(old), self.at(new)):
            raise ValidationError(f"{new} appeared, or {old} could not be moved there")

    def replace(self, name: str, content: bytes) -> None:
        """A document that is there whole or not at all."""
        if self.exists(f"{name}.new"):
            self.delete(f"{name}.new")
        self.create(f"{name}.new", content)
        self.rename(f"{name}.new", name)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def digest(self, name: str) -> str | None:
        """SHA-256 of a document, or of a folder's sorted (path, digest) lines; None if nothing is there."""
        if not self.exists(name):
            return None
        if not self.is_folder(name):
            return hashlib.sha256(self.read(name)).hexdigest().upper()
        one = folder_digests(self.spark, f"{self.home}/{name}", depth=0).select("sha256").first()
        return one["sha256"] if one else hashlib.sha256(b"").hexdigest().upper()


def _receipt(journal: dict) -> dict:
    return {"kind": journal["kind"], "published": {e["target"]: e["planned"] for e in journal["entries"]}}


def _valid(journal: object) -> dict:
    """The journal, if recovery can trust it; an error else, and nothing is touched."""
    names = [e.get("target") for e in journal.get("entries", [])] if isinstance(journal, dict) and journal.get("version") == 1 else []
    digests = [e.get(k) for e in journal["entries"] for k in ("planned", "prior") if k == "planned" or e.get(k) is not None] if names else []
    hexes = all(isinstance(d, str) and len(d) == 64 and set(d) <= set("0123456789ABCDEF") for d in digests)
    if not names or len(set(names)) != len(names) or not hexes or any(not isinstance(n, str) or not n or "/" in n or n.startswith(("_", ".")) for n in names):
        raise ValidationError("the journal is damaged; nothing was changed")
    return journal


def recover(spark: SparkSession, home: str) -> bool:
    """Ends an interrupted publication. True: its set is complete and has its receipt. False: there was none, or it is rolled back."""
    store = Store(spark, home)
    if not store.exists(PLACE):
        return False
    if not store.exists(f"{PLACE}/{JOURNAL}"):  # nothing is installed before the journal is there
        store.delete(PLACE)
        return False
    try:
        text = json.loads(store.read(f"{PLACE}/{JOURNAL}"))
    except ValueError:
        text = None
    entries = (journal := _valid(text))["entries"]
    now = {e["target"]: store.digest(e["target"]) for e in entries}
    if strange := [e["target"] for e in entries if now[e["target"]] not in (None, e["planned"], e["prior"])]:
        raise ValidationError(f"other content in {strange}; nothing was changed")
    if all(now[e["target"]] == e["planned"] for e in entries):
        wanted = _receipt(journal)
        had = json.loads(store.read(RECEIPT)) if store.exists(RECEIPT) else None
        if had != wanted:
            if had is not None and had != journal["receipt_before"]:
                raise ValidationError("a receipt of another publication; nothing was changed")
            if had is not None:
                store.delete(RECEIPT)
            store.replace(RECEIPT, json.dumps(wanted, indent=2).encode())
        store.delete(PLACE)
        return True
    for e in reversed(entries):
        name, backup = e["target"], f"{PLACE}/old/{e['target']}"
        if e["prior"] is None:
            if now[name] is not None:
                store.delete(name)
        elif store.exists(backup):
            if now[name] is not None:
                store.delete(name)
            store.rename(backup, name)
    if journal["receipt_before"] is not None and not store.exists(RECEIPT):
        store.replace(RECEIPT, json.dumps(journal["receipt_before"], indent=2).encode())
    store.delete(PLACE)
    return False


def publish(spark: SparkSession, home: str, content: dict[str, DataFrame | bytes], replace: tuple[str, ...] = (), kind: str = "tables", writer=None) -> dict[str, str]:
    """Tables (folders of Parquet, or what ``writer(df, path)`` writes) and documents (bytes) under ``home``; name -> digest.

    Installed in their order. A target that exists has to be in ``replace``. An interrupted publication is ended first.
    """
    store = Store(spark, home)
    store.fs.mkdirs(store.at(""))
    recover(spark, home)
    if there := [n for n in content if n not in replace and store.exists(n)]:
        raise ValidationError(f"{there} exist")
    try:
        store.create(f"{PLACE}/{OWNER}", kind.encode())  # one publication at a time: only one creates it
    except Exception as e:
        raise ValidationError("another publication is under way") from e
    try:
        entries = []
        for name, what in content.items():
            staged = f"{PLACE}/new/{name}"
            if isinstance(what, DataFrame):
                (writer or (lambda df, path: df.write.parquet(path)))(what, f"{store.home}/{staged}")
            else:
                store.create(staged, what)
            entries.append({"target": name, "planned": store.digest(staged), "prior": store.digest(name)})
        before = json.loads(store.read(RECEIPT)) if store.exists(RECEIPT) else None
        journal = _valid({"version": 1, "kind": kind, "entries": entries, "receipt_before": before})
        store.fs.mkdirs(store.at(f"{PLACE}/old"))
        store.replace(f"{PLACE}/{JOURNAL}", json.dumps(journal, indent=2).encode())
        if late := [e["target"] for e in entries if store.digest(e["target"]) != e["prior"]]:
            raise ValidationError(f"{late} changed while the publication was staged")
        for e in entries:
            if e["prior"] is not None:
                store.rename(e["target"], f"{PLACE}/old/{e['target']}")
            store.rename(f"{PLACE}/new/{e['target']}", e["target"])
        if before is not None:
            store.delete(RECEIPT)
        store.replace(RECEIPT, json.dumps(_receipt(journal), indent=2).encode())
        store.delete(PLACE)
    except Exception:
        if not recover(spark, home):
            raise
    return {e["target"]: e["planned"] for e in entries}


def publish_gate(spark: SparkSession, home: str, content: dict[str, DataFrame | bytes], gate: str, checks: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> dict[str, str]:
    """``content``, and last the document ``gate``, which says that all ``checks`` (tables of violations) were empty; with a violation nothing is published."""
    found = {name: rows.limit(1).count() for name, rows in checks.items()}
    if failed := [n for n, c in found.items() if c]:
        raise ValidationError(f"the gate stays closed: {failed}")
    stated = json.dumps({"gate": gate, "checks": sorted(checks), "covers": sorted(content)}, indent=2).encode()
    return publish(spark, home, {**content, gate: stated}, replace, kind="gate")


def published(spark: SparkSession, home: str) -> list[tuple[str, str]]:
    """(name, problem) of a receipt's targets that are absent or hold other content; an error without a receipt."""
    store = Store(spark, home)
    if not store.exists(RECEIPT):
        raise ValidationError(f"{home} has no receipt")
    wanted = json.loads(store.read(RECEIPT))["published"]
    now = {n: store.digest(n) for n in wanted}
    return [(n, "absent" if now[n] is None else "changed") for n in wanted if now[n] != wanted[n]]


def tables_of(spark: SparkSession, home: str) -> DataFrame:
    """name, digest of a receipt."""
    wanted = json.loads(Store(spark, home).read(RECEIPT))["published"]
    return spark.createDataFrame(sorted(wanted.items()), "name string, digest string").orderBy(F.col("name"))
