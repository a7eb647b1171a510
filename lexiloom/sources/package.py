"""Deck packages: a zip with a SQLite database of notes and cards."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MEMBER = "collection.anki2"
#: Tag that carries a note's gloss key.
KEY_TAG = "gloss::"


def package_id(name: str) -> int:
    """A number for a model or deck name, the same in every run: 2^30 and a 30-bit hash."""
    return (1 << 30) + int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big") % (1 << 30)


def write_package(cards: DataFrame, path: str, name: str) -> int:
    """Write cards (place, kind, gloss_key, front, back) as a package; gives the number of notes.

    The one place where a deck comes to the driver: a package is a file for one learner. Rows stream partition by
    partition into the database.
    """
    with tempfile.TemporaryDirectory() as folder:
        base = Path(folder) / MEMBER
        con = sqlite3.connect(base)
        con.execute("create table col (id integer primary key, models text, decks text)")
        con.execute("create table notes (id integer primary key, guid text, mid integer, tags text, flds text)")
        con.execute("create table cards (id integer primary key, nid integer, did integer, type integer, due integer)")
        model, deck = package_id(name + " model"), package_id(name)
        con.execute("insert into col values (1, ?, ?)", (json.dumps({model: {"name": name}}), json.dumps({deck: {"name": name}})))
        n = 0
        for n, row in enumerate(cards.select("place", "kind", "gloss_key", "front", "back").orderBy("place", "kind").toLocalIterator(), 1):
            guid = hashlib.sha256(f"{row.kind}\n{row.front}\n{row.back}".encode()).hexdigest()[:16]
            tags = f" {row.kind} " + (f"{KEY_TAG}{row.gloss_key} " if row.gloss_key else "")
            con.execute("insert into notes values (?, ?, ?, ?, ?)", (n, guid, model, tags, f"{row.front}\x1f{row.back}"))
            con.execute("insert into cards values (?, ?, ?, 0, ?)", (n, n, deck, row.place))
        con.commit()
        con.close()
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.write(base, MEMBER)
            archive.writestr("media", "{}")
    return n


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Cards of all packages under ``path``, a file each task: package, card_id, gloss_key, kind, due, card_type, guid."""

    def cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    whole = Path(folder) / "package"
                    whole.write_bytes(content)
                    with zipfile.ZipFile(whole) as archive:
                        archive.extract(MEMBER, folder)
                    con = sqlite3.connect(Path(folder) / MEMBER)
                    rows = con.execute("select c.id, n.tags, c.due, c.type, n.guid from cards c join notes n on c.nid = n.id order by c.id").fetchall()
                    con.close()
                split = [(r[1] or "").split() for r in rows]
                columns = [
                    [name] * len(rows), [r[0] for r in rows], [next((t[len(KEY_TAG):] for t in s if t.startswith(KEY_TAG)), None) for s in split],
                    [next((t for t in s if t in ("recognition", "production")), "") for s in split], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows],
                ]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["package", "card_id", "gloss_key", "kind", "due", "card_type", "guid"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cards, "package string, card_id bigint, gloss_key string, kind string, due bigint, card_type bigint, guid string")
